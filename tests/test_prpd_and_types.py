import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import classify, prpd


def bins(spark, rows):
    df = spark.createDataFrame(rows, "g string, p double, a double, t double")
    return prpd.prpd_features(prpd.binned(df, ["g"], "p", "a", "t"), ["g"])


def test_uniform_and_focused(spark):
    rows = [("uniform", i + 0.5, 1.0, i / 360) for i in range(360)]
    rows += [("focused", 45.0, 2.0 + i % 2, float(i)) for i in range(40)]
    rows += [("single", 359.9, -3.0, 0.0), ("odd", None, 1.0, 0.0), ("odd", -10.0, math.nan, 1.0), ("odd", 370.0, 1.0, 2.0)]
    got = {r["g"]: r for r in bins(spark, rows).collect()}
    u, f, s, o = got["uniform"], got["focused"], got["single"], got["odd"]
    assert u["phase_entropy"] == pytest.approx(1.0)
    assert u["discharge_asymmetry"] == 0 and u["skewness_Hn_positive"] == 0 and u["cross_correlation"] == 0
    assert sum(u[f"quadrant_{i}_percentage"] for i in range(1, 5)) == pytest.approx(100)
    assert f["phase_entropy"] == 0 and f["phase_spread"] == pytest.approx(0, abs=1e-3) and f["phase_of_max_activity"] == 45
    assert f["inception_phase"] == f["extinction_phase"] == 45
    assert f["coefficient_of_variation"] == pytest.approx(0.2)
    assert f["repetition_rate"] == pytest.approx(40 / 39)
    assert s["phase_spread"] == 0 and s["max_amplitude_negative"] == 3.0 and s["pulses_per_cycle"] == 1
    assert o["total_pulse_count"] == 2 and o["phase_of_max_activity"] == 5


def test_peaks_and_moments(spark):
    counts = [0, 5, 1, 3, 3, 0, 9, 0, 0, 2, 1, 1, 2, 0, 0, 0, 0, 4]
    rows = [("x", b * 10 + 5.0, 1.0, 0.0) for b, n in enumerate(counts) for _ in range(n)]
    r = bins(spark, rows).first()
    assert r["number_of_peaks_Hn_positive"] == 5
    h = np.array(counts, dtype=float)
    z = (h - h.mean()) / h.std()
    assert r["skewness_Hn_positive"] == pytest.approx((z**3).mean())
    assert r["kurtosis_Hn_positive"] == pytest.approx((z**4).mean() - 3)


def test_weibull(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in 2.5 * rng.weibull(1.7, 4000)] + [("b", float(x)) for x in 1e-6 * rng.weibull(6.0, 4000)]
    rows += [("few", 1.0)] * 4 + [("same", 3.0)] * 9 + [("a", 0.0), ("a", None), ("a", math.nan)]
    got = {r["g"]: r for r in prpd.weibull_fit(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["a"]["weibull_alpha"] == pytest.approx(2.5, rel=0.05) and got["a"]["weibull_beta"] == pytest.approx(1.7, rel=0.05)
    assert got["b"]["weibull_alpha"] == pytest.approx(1e-6, rel=0.05) and got["b"]["weibull_beta"] == pytest.approx(6.0, rel=0.05)
    assert (got["few"]["weibull_alpha"], got["few"]["weibull_beta"]) == (0, 0)
    assert got["same"]["weibull_alpha"] == pytest.approx(3.0) and got["same"]["weibull_beta"] == 0


def test_trimmed_mean_with_ties(spark):
    xs = [1.0] * 4 + [2.0] * 10 + [3.0] * 3 + [1000.0] * 4
    rows = [("a", x) for x in xs] + [("b", 5.0), ("b", None), ("b", math.inf)]
    got = {r["g"]: r for r in prpd.feature_means(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"]).collect()}
    cut = int(len(xs) * 0.1)
    assert got["a"]["trimmed_mean"] == pytest.approx(np.mean(sorted(xs)[cut:-cut]))
    assert got["b"]["n"] == 3 and got["b"]["trimmed_mean"] == pytest.approx(5 / 3)


BASE = {
    "phase_spread": 20.0, "phase_entropy": 0.7, "discharge_asymmetry": 0.0, "cross_correlation": 0.35, "coefficient_of_variation": 0.2, "phase_of_max_activity": 120.0,
    "amplitude_phase_correlation": 0.4, "quadrant_3_percentage": 40.0, "repetition_rate": 60.0, "pulses_per_cycle": 1.0, "mean_absolute_amplitude": 1.0,
    "mean_slew_rate": 2e7, "mean_dominant_frequency": 1e7, "mean_pulse_count": 1.0, "mean_is_multi_pulse": 0.0, "mean_signal_to_noise_ratio": 8.0,
}

CASES = {
    "NOISE_MULTIPULSE": {"mean_is_multi_pulse": 0.8},
    "NOISE": {"mean_signal_to_noise_ratio": 2.0, "mean_slew_rate": 1e5, "cross_correlation": 0.2},
    "SURFACE": {"phase_spread": 50.0},
    "CORONA": {"discharge_asymmetry": -0.95, "phase_of_max_activity": 260.0, "amplitude_phase_correlation": 0.1, "mean_slew_rate": 9e7, "mean_dominant_frequency": 4e7, "quadrant_3_percentage": 90.0},
    "INTERNAL": {"phase_of_max_activity": 60.0, "amplitude_phase_correlation": 0.8, "discharge_asymmetry": 0.1},
}


def test_each_type_is_reached(spark):
    names = list(BASE)
    rows = [(kind, *[{**BASE, **change}[n] for n in names]) for kind, change in CASES.items()]
    df = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{n} double" for n in names))
    got = {r["kind"]: r["pd_type"] for r in classify.classified(df).collect()}
    assert got == {k: k for k in CASES}


@pytest.mark.parametrize("rule", range(len(classify.RULES)))
def test_every_rule_can_hold_and_fail(spark, rule):
    r = classify.RULES[rule]
    features = {}
    for t in r.tests:
        lo, hi = t.low, t.high
        mid = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else hi - abs(hi) / 2 - 0.01 if math.isfinite(hi) else lo + abs(lo) / 2 + 0.01
        out = hi + abs(hi) + 1 if math.isfinite(hi) else lo - abs(lo) - 1
        features[t.feature] = (0.0 if t.size and not math.isfinite(lo) else mid, 0.0 if t.size and math.isfinite(lo) else out)
    names = list(features)
    text = classify.score_texts(names, [r])[r.score]
    df = spark.createDataFrame([tuple(v[i] for v in features.values()) for i in (0, 1)], ", ".join(f"{n} double" for n in names))
    assert [x[0] for x in df.select(F.expr(text)).collect()] == [r.points, 0.0]


def test_unclustered_pulses_are_noise(spark):
    rows = spark.createDataFrame([(-1, 10.0), (0, 10.0)], "cluster int, phase_spread double")
    got = {r["cluster"]: (r["pd_type"], r["confidence"], r["code"]) for r in classify.classified(rows).withColumn("code", classify.type_code(F.col("pd_type"))).collect()}
    assert got[-1] == ("NOISE", 0.95, 0)
    assert got[0][0] != "NOISE" or got[0][1] != 0.95
    other = spark.createDataFrame([("SURFACE",), ("else",), (None,)], "t string").select(classify.type_code(F.col("t")).alias("c"))
    assert [r["c"] for r in other.collect()] == [3, 4, 4]
