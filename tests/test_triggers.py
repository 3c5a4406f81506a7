import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import analytics, classify, triggers, waveforms


def stream(spark, channels):
    rows = [(c, i, None if x is None else float(x)) for c, xs in channels.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "ch string, i long, x double")


def levels(spark, channels, baseline=0.0):
    return spark.createDataFrame([(c, baseline) for c in channels], "ch string, baseline double")


def walked(xs, found, search, to, factor, least):
    """The refinement one trigger at a time."""
    out = set()
    for t in found:
        region = xs[t : t + search]
        p = t + int(np.argmax(region) if xs[t] >= 0 else np.argmin(region))
        at = p
        if to == "onset":
            for j in range(p - 1, max(0, t - search // 2) - 1, -1):
                if abs(xs[j]) < abs(xs[p]) * factor:
                    at = j + 1
                    break
        out.add(at)
    kept = []
    for t in sorted(out):
        if not kept or t - kept[-1] >= least:
            kept.append(t)
    return kept


@pytest.mark.parametrize("to", ["peak", "onset"])
def test_refinement_equals_a_walk(spark, to):
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 0.2, 900)
    for at in (3, 100, 104, 350, 600, 895):
        noise[at : at + 25] += np.exp(-np.arange(25)[: 900 - at] / 6) * (8 if at != 350 else -8)
    steps = np.round(rng.normal(0, 2, 300))  # many equal peaks
    xs = {"a": noise, None: steps}
    found = {"a": [3, 100, 112, 351, 601, 896], None: [0, 7, 50, 51, 299]}
    df = spark.createDataFrame([(c, t, 1.0) for c, ts in found.items() for t in ts], "ch string, i long, extra double")
    got = triggers.refined_triggers(stream(spark, xs), df, "ch", "i", "x", levels(spark, xs), 10, 20, to, 0.1)
    by = {}
    for r in got.collect():
        by.setdefault(r["ch"], []).append(r["i"])
    for c in xs:
        assert sorted(by[c]) == walked(xs[c], found[c], 20, to, 0.1, 10)


def test_refinement_of_odd_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 40), ("a", None), ("gone", 5)], "ch string, i long")
    rows = stream(spark, {"a": [0, None, math.nan, 4, 9, 1] + [0] * 50})
    got = triggers.refined_triggers(rows, df, "ch", "i", "x", levels(spark, ["a"]), 2, 10)
    # no sample at 1 and no channel "gone": both stay; silent samples have their peak first
    assert sorted((r["ch"], r["i"]) for r in got.collect()) == [("a", 1), ("a", 40), ("gone", 5)]
    assert triggers.refined_triggers(rows, df.limit(0), "ch", "i", "x", levels(spark, ["a"]), 2, 10).count() == 0
    with pytest.raises(ValueError):
        triggers.refined_triggers(rows, df, "ch", "i", "x", levels(spark, ["a"]), 2, 10, to="middle")


def test_noise_floor(spark):
    xs = np.random.default_rng(5).normal(3, 2, 501)
    rows = stream(spark, {"a": list(xs) + [None, math.nan, math.inf], "flat": [2.0] * 8})
    got = {r["ch"]: r for r in triggers.noise_floors(rows, "ch", "x").collect()}
    off = np.abs(xs - np.median(xs))
    a = got["a"]
    assert a["n_values"] == 501 and a["baseline"] == pytest.approx(np.median(xs)) and a["sigma"] == pytest.approx(1.4826 * np.median(off))
    near = off[off < np.percentile(off, 25)]
    assert a["rms_noise"] == pytest.approx(np.sqrt((near**2).mean())) and a["peak_to_noise"] == pytest.approx(off.max() / a["sigma"])
    assert got["flat"]["sigma"] == 0 and got["flat"]["rms_noise"] == 0 and got["flat"]["peak_to_noise"] is None
    assert triggers.noise_floors(rows.limit(0), "ch", "x").count() == 0


def test_methods_side_by_side(spark):
    xs = [0, 5, 0, 0, -5, 0, 2, 0, 0, 9, 0, 0]
    named = [("a", "low", 0.0, 1.0, 12), ("a", "high", 0.0, 6.0, 12), ("a", "never", 0.0, 50.0, 12), ("b", "low", 0.0, 1.0, 3)]
    lv = spark.createDataFrame(named, "ch string, method string, baseline double, threshold double, n_values long")
    got = {(r["ch"], r["method"]): r for r in triggers.compare_methods(stream(spark, {"a": xs, "b": [0, 0, 0]}), "ch", "i", "x", lv, 6, 3).collect()}
    assert {k: r["n_triggers"] for k, r in got.items()} == {("a", "low"): 3, ("a", "high"): 1, ("a", "never"): 0, ("b", "low"): 0}
    assert got["a", "low"]["per_cycle"] == pytest.approx(3 / 2)


def test_choices_by_phase(spark):
    df = spark.createDataFrame([(float(p),) for p in (0, 10, 29, 30, 31, 180, 330, 355, 359)] + [(None,)], "p double")
    pick = lambda c: sorted(r["p"] for r in df.where(c).collect())
    assert pick(triggers.in_phase_range(F.col("p"), 330, 30)) == [0, 10, 29, 30, 330, 355, 359]
    assert pick(triggers.in_phase_range(F.col("p"), 10, 30)) == [10, 29, 30]
    assert pick(triggers.near_phase(F.col("p"), 358, 3)) == [0, 355, 359]


def test_hilbert_phase_whole_and_in_blocks(spark):
    n, period = 4000, 50
    t = np.arange(n)
    x = 3 + np.cos(2 * np.pi * t / period + 0.4) + np.random.default_rng(1).normal(0, 0.02, n)
    rows = stream(spark, {"a": x, "short": x[:7], "one": [1.0], "none": [None]})

    def whole(v):
        v = v - v.mean()
        gain = np.zeros(len(v))
        gain[0] = 1
        gain[1 : (len(v) + 1) // 2] = 2
        if len(v) % 2 == 0:
            gain[len(v) // 2] = 1
        return np.degrees(np.angle(np.fft.ifft(np.fft.fft(v) * gain))) % 360

    def run(block):
        got = {}
        for r in triggers.hilbert_phase(rows, "ch", "i", "x", period, block, 8).collect():
            got.setdefault(r["ch"], {})[r["i"]] = r["phase"]
        return got

    got = run(1 << 15)
    assert sorted(got) == ["a", "one", "short"] and len(got["a"]) == n
    turn = lambda a, b: np.abs((np.asarray(a) - b + 180) % 360 - 180)
    assert turn([got["a"][i] for i in range(n)], whole(x)).max() < 1e-6
    assert turn([got["short"][i] for i in range(7)], whole(x[:7])).max() < 1e-6
    cut = run(1000)
    assert len(cut["a"]) == n
    off = turn([cut["a"][i] for i in range(n)], whole(x))
    assert off.max() < 5 and np.median(off) < 1


def test_rule_outcomes_add_up_to_scores(spark):
    rows = [(1, 50.0, 0.9, -0.7, None), (2, 10.0, 0.2, 0.1, 3.0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "g int, phase_spread double, phase_entropy double, discharge_asymmetry double, mean_signal_to_noise_ratio double")
    scores = {r["g"]: r for r in classify.classified(df).collect()}
    got = classify.rule_outcomes(df, ["g"]).groupBy("g", "score").agg(F.sum("points").alias("p")).collect()
    assert len(got) == 3 * len({r.score for r in classify.RULES})
    assert all(scores[r["g"]][r["score"]] == pytest.approx(r["p"]) for r in got)


def test_recall_by_type(spark):
    rows = [("CORONA", "CORONA", 3), ("CORONA", "NOISE", 1), ("NOISE", "NOISE_MULTIPULSE", 5), ("SURFACE", None, 2), (None, "NOISE", 4), ("INTERNAL", "INTERNAL", 0)]
    df = spark.createDataFrame(rows, "e string, p string, n long")
    got = {r["e"]: (r["n"], r["hits"], r["recall"]) for r in classify.recall_by_type(df, "e", "p", F.col("n")).collect()}
    assert got == {"CORONA": (4, 3, 0.75), "NOISE": (5, 5, 1.0), "SURFACE": (2, 0, 0.0), None: (4, 0, 0.0), "INTERNAL": (0, 0, None)}


def test_best_windows(spark):
    rows = [("a", "original", 0.5), ("a", "smart3x", 0.2), ("a", "energy90", 0.2), ("a", "padded0.5us", 0.3), ("b", "original", 0.0), ("b", "smart3x", 0.0), (None, "original", 0.4), (None, "smart3x", 0.4)]
    got = {r["g"]: (r["method"], r["multi_pulse_reduction"]) for r in waveforms.best_windows(spark.createDataFrame(rows, "g string, method string, multi_pulse_share double"), "g").collect()}
    assert got["a"] == ("energy90", pytest.approx(0.6)) and got["b"] == (None, 0) and got[None] == (None, 0)


def test_loadings():
    x = np.random.default_rng(6).normal(size=(400, 3))
    x[:, 1] += 2 * x[:, 0]
    matrix = np.zeros((4, 4))
    matrix[:3, :3] = np.cov(x.T, bias=True)
    got = analytics.loadings(["a", "b", "c", "constant"], matrix)
    assert {r[1] for r in got} == {"a", "b", "c"} and got[-1][4] == pytest.approx(1)
    value = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert [r[3] for r in got[::3]] == pytest.approx(list(value / 3))
    assert analytics.loadings(["a"], np.zeros((1, 1))) == []
