import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import bisection
from voltlake.operators.quantiles import long_measures

PROBS = (0.0, 0.05, 0.5, 0.9, 0.999, 1.0)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    rows = []
    for g, size in (("a", 4000), ("b", 1), ("c", 300), (None, 50), ("hot", 9000)):
        x = np.exp(rng.normal(-20, 5, size))
        if g == "c":
            x = np.round(x * 1e9) / 1e9 * rng.choice([-1, 0, 1], size)
        if g == "hot":
            x = rng.choice([1.0, 1.0 + 1e-12, 2.5], size)
        rows += [(g, i % 3, float(v)) for i, v in enumerate(x)]
    rows += [("a", 0, None), ("a", 1, math.nan), ("a", 2, math.inf), ("none", 0, None)]
    return rows


@pytest.mark.parametrize(("splits", "leaf"), [(256, 4096), (4, 20)])
def test_exact_against_numpy(spark, values, splits, leaf):
    df = spark.createDataFrame(values, "g string, d int, x double").repartition(5)
    got = bisection.exact_percentiles(df, [["g"], ["d"], ["g", "d"]], ["x"], PROBS, splits=splits, leaf_rows=leaf).collect()
    found = {(r["grouping"], r["g"], r["d"], r["prob"]): r for r in got}
    assert len(found) == len(got)
    want = {}
    for which, key in enumerate((lambda g, d: (g, None), lambda g, d: (None, d), lambda g, d: (g, d))):
        groups = {}
        for g, d, x in values:
            if x is not None and math.isfinite(x):
                groups.setdefault(key(g, d), []).append(x)
        for k, xs in groups.items():
            for p in PROBS:
                want[(which, *k, p)] = (len(xs), float(np.quantile(xs, p)))
    assert set(found) == set(want)
    for k, (n, q) in want.items():
        assert found[k]["n_values"] == n
        assert found[k]["value"] == pytest.approx(q, rel=1e-12, abs=1e-300), k


def test_merged_counts_bound_the_value(spark, values):
    df = spark.createDataFrame(values, "g string, d int, x double")
    days = bisection.bucket_counts(long_measures(df, ["g", "d"], ["x"]), ["g", "d"])
    placed = bisection.approx_percentiles(bisection.merge_counts(days, ["g"]), ["g"], [0.5]).collect()
    for r in placed:
        xs = sorted(x for g, _, x in values if g == r["g"] and x is not None and math.isfinite(x))
        true = xs[r["_k"]]
        assert r["lo"] <= true <= r["hi"]
        if r["lo"] > 0:
            assert abs(math.sqrt(r["lo"] * r["hi"]) / true - 1) <= bisection.RELATIVE_ERROR + 1e-12


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert bisection.exact_percentiles(df, [["g"]], ["x"], PROBS).count() == 0


def test_buckets_rise_with_values(spark):
    xs = [-math.inf, -5.0, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 0.5, 1.0, 2.0, 1e308]
    df = spark.createDataFrame([(x,) for x in xs[1:]], "x double").select("x", bisection.value_bucket(F.col("x")).alias("b"))
    buckets = [r["b"] for r in df.orderBy("x").collect()]
    assert buckets == sorted(buckets)
