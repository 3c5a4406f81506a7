import random

import pytest
from pyspark.sql import functions as F

from voltlake.operators import events


def greedy(xs, sep):
    kept = []
    for x in sorted(set(xs)):
        if not kept or x - kept[-1] >= sep:
            kept.append(x)
    return kept


def make(seed=3, n=400):
    rng = random.Random(seed)
    rows = []
    for ch in ("a", "b", None):
        for _ in range(n):
            rows.append((ch, rng.randrange(6000), rng.choice([None, rng.random()]), rng.random() * 400 - 20, len(rows)))
    rows += [("one", 5, 1.0, 0.0, 9000), ("a", None, 1.0, 0.0, 9001)]
    return rows


SCHEMA = "ch string, i long, amp double, phase double, id long"


@pytest.mark.parametrize(("sep", "chunk"), [(7, 1 << 22), (30, 128), (1, 64), (500, 1 << 22)])
def test_dead_time_is_the_greedy_walk(spark, monkeypatch, sep, chunk):
    monkeypatch.setattr(events, "CHUNK", chunk)
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in events.dead_time(df, "ch", "i", sep).collect():
        got.setdefault(r["ch"], []).append(r["i"])
    for ch in ("a", "b", None, "one"):
        want = greedy([r[1] for r in rows if r[0] == ch and r[1] is not None], sep)
        assert sorted(got[ch]) == want


@pytest.mark.parametrize("chunk", [1 << 22, 50])
def test_merge(spark, monkeypatch, chunk):
    monkeypatch.setattr(events, "CHUNK", chunk)
    rows = make(5, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for ch in ("a", "b", None, "one"):
        line = sorted((r for r in rows if r[0] == ch and r[1] is not None), key=lambda r: (r[1], r[4]))
        chain = []
        for r in [*line, None]:
            if chain and (r is None or r[1] - chain[-1][1] > 20):
                best = min(chain, key=lambda e: (-e[2] if e[2] is not None else float("inf"), e[1], e[4]))
                want.add((ch, best[4], len(chain)))
                chain = []
            if r is not None:
                chain.append(r)
    got = {(r["ch"], r["id"], r["n_merged"]) for r in events.merge_nearby(df, "ch", "i", "amp", "id", 20).collect()}
    assert got == want


def test_match(spark):
    left = [("a", 100, 1), ("a", 500, 2), ("a", 900, 3), ("b", 100, 4), ("a", None, 5)]
    right = [("a", 130, 10), ("a", 60, 11), ("a", 600, 12), ("a", 601, 13), ("b", 201, 14)]
    a = spark.createDataFrame(left, "ch string, i long, id long")
    b = spark.createDataFrame(right, "ch string, i long, id long")
    got = {r["left_key"]: (r["right_key"], r["offset"]) for r in events.match_within(a, b, "ch", "i", "id", 100).collect()}
    assert got == {1: (11, -40), 2: (12, 100), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_hotspots_wrap_around(spark):
    bins = [(0, b, 10.0 if b in (34, 35, 0, 1, 10, 11, 12) else 1.0 + b % 2 * 0.01) for b in range(36)]
    df = spark.createDataFrame(bins, "ch int, bin int, mean double")
    got = {(r["lo"], r["hi"], r["n_bins"]) for r in events.hotspots(df, "ch", sigma=1.0, min_bins=3, merge_gap=1, bins=36).collect()}
    assert got == {(34, 37, 4), (10, 12, 3)}


def test_sync_average_has_every_bin(spark):
    df = spark.createDataFrame([("a", 5.0, -2.0), ("a", 365.0, 4.0), ("a", None, 1.0), ("a", 90.0, None), ("a", -1.0, 1.0)], "ch string, p double, v double")
    rows = {r["bin"]: r for r in events.sync_average(df, "ch", "p", "v", 36).collect()}
    assert len(rows) == 36
    assert rows[0]["n"] == 2 and rows[0]["mean"] == 3.0 and rows[0]["highest"] == 4.0
    assert rows[35]["n"] == 1 and rows[9]["n"] == 0 and rows[9]["mean"] == 0.0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert events.dead_time(df, "ch", "i", 5).count() == 0
    assert events.merge_nearby(df, "ch", "i", "amp", "id", 5).count() == 0
    assert events.quadrant_kurtosis(df, "ch", "phase", "amp").count() == 0
    assert events.robust_thresholds(df.where(F.col("amp").isNotNull()), "ch", "amp").count() == 0
