import math

import numpy as np
import pytest

from voltlake.operators import quantiles

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
        rows += [(g, float(v), "clash") for v in x]
    rows += [("a", None, ""), ("a", math.nan, ""), ("a", math.inf, ""), ("none", None, "")]
    return rows


@pytest.mark.parametrize(("steps", "leaf"), [(128, 4096), (16, 40)])
def test_exact_against_numpy(spark, values, steps, leaf):
    df = spark.createDataFrame(values, "g string, x double, v string").repartition(5)
    got = quantiles.exact_percentiles(df, ["g"], ["x"], PROBS, leaf, steps).collect()
    found = {(r["g"], r["prob"]): r for r in got}
    assert len(found) == len(got)
    groups = {}
    for g, x, _ in values:
        if x is not None and math.isfinite(x):
            groups.setdefault(g, []).append(x)
    want = {(g, p): (len(xs), float(np.quantile(xs, p))) for g, xs in groups.items() for p in PROBS}
    assert set(found) == set(want)
    for k, (n, q) in want.items():
        assert found[k]["n_values"] == n
        assert found[k]["value"] == pytest.approx(q, rel=1e-12, abs=1e-300), k


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert quantiles.exact_percentiles(df, ["g"], ["x"], PROBS).count() == 0
