import math

import pytest
from pyspark.sql import functions as F

from voltlake.operators import faults

FIELD = faults.Field("v", limit="top", above="floor")
SCHEMA = "key long, series string, source string, t double, v double, top double, floor double, hour int"


def brute(rows):
    """(key -> fault) by the definitions."""
    ok = [r for r in rows if r[4] is not None and not math.isnan(r[4])]

    def bad(r):
        v, top, floor = r[4], r[5], r[6]
        return v < 0 or math.isinf(v) or (top is not None and v > top) or (floor is not None and v <= floor)

    out = {}
    p90 = {}
    for s in {r[2] for r in ok}:
        xs = sorted(r[4] for r in ok if r[2] == s and not bad(r))
        if xs:
            k = 0.9 * (len(xs) - 1)
            p90[s] = xs[int(k)] + (xs[math.ceil(k)] - xs[int(k)]) * (k - int(k))
    for s in {r[1] for r in ok}:
        line = sorted((r for r in ok if r[1] == s), key=lambda r: (r[3], r[0]))
        i = 0
        while i < len(line):
            j = i
            while j < len(line) and line[j][4] == line[i][4]:
                j += 1
            for r in line[i:j]:
                if bad(r):
                    out[r[0]] = "impossible"
                elif j - i >= 8:
                    out[r[0]] = "stuck"
                elif r[2] in p90 and r[4] > 4 * p90[r[2]]:
                    out[r[0]] = "spike"
            i = j
    return out


def make_rows():
    rows, key = [], 0
    for series, source, n in (("a", "s", 400), ("b", "s", 30), ("c", None, 40), (None, "z", 9), ("one", "solo", 1)):
        for i in range(n):
            v = 1.0 + ((i * 7919) % 101) / 100
            if 50 <= i < 75:
                v = 1.5
            if series == "b" and i >= 20:
                v = 1.25
            if series is None:
                v = 3.0
            if i == 90:
                v = 500.0
            if i == 95:
                v = -1.0
            if i == 96:
                v = math.inf
            if i == 97:
                v = math.nan
            if i in (60, 98):
                v = None
            if i == 99:
                v = 20.0
            rows.append((key, series, source, float(i // 2), v, 100.0 if source == "s" else None, 0.5 if i % 2 else None, i % 24))
            key += 1
    return rows


@pytest.mark.parametrize("chunk", [50_000, 11, 3])
def test_faults_against_definition(spark, chunk):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = faults.flag_faults(df, "source", "series", ["t", "key"], F.col("hour"), [FIELD], chunk_rows=chunk)
    assert got.count() == len(rows)
    found = {r["key"]: r["fault_v"] for r in got.collect() if r["fault_v"]}
    assert found == brute(rows)
    assert set(found.values()) == {"impossible", "stuck", "spike"}


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert faults.flag_faults(empty, "source", "series", ["t", "key"], F.col("hour"), [FIELD]).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None, None)], SCHEMA)
    got = faults.flag_faults(nulls, "source", "series", ["t", "key"], F.col("hour"), [FIELD]).collect()
    assert [r["fault_v"] for r in got] == [None]


def cutoffs(df, season, risk):
    long = faults.possible_readings(df, "source", season, [FIELD])
    return faults.tail_cutoffs(long, faults.tail_percentiles(long, "source"), "source", risk)


def test_tail_cutoff_follows_the_risk(spark):
    rows = [(i, "a", "s", float(i), 1.0 + (i % 997) / 100, None, None, i % 24) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    low, high = cutoffs(df, F.lit(0), 1e-2).first(), cutoffs(df, F.lit(0), 1e-4).first()
    assert low["u"] * low["level"] <= low["cutoff"] < high["cutoff"]
    above = sum(r[4] > low["cutoff"] for r in rows) / len(rows)
    assert above < 0.03


def test_spikes_do_not_move_the_cutoff(spark):
    clean = [(i, "a", "s", float(i), math.exp(((i * 7919) % 1000) / 500), None, None, i % 24) for i in range(4000)]
    dirty = [(*r[:4], r[4] * 200 if i % 80 == 0 else r[4], *r[5:]) for i, r in enumerate(clean)]
    one, two = (max(r["cutoff"] for r in cutoffs(spark.createDataFrame(rows, SCHEMA), F.col("hour"), 1e-2).collect()) for rows in (clean, dirty))
    assert two == pytest.approx(one, rel=0.2)


def test_a_burst_is_cut_into_chunks(spark):
    rows = [(i, "a", "s", 1000.0 + i / 1e6 if i else 0.0, 1.0, None, None, 0) for i in range(1000)]
    got = faults.with_chunks(spark.createDataFrame(rows, SCHEMA), "series", "t", 100).groupBy("_chunk").count().collect()
    assert len(got) >= 8 and max(r["count"] for r in got) <= 250
