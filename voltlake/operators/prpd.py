"""Phase-resolved statistics of groups of pulses.

Pulses are counted once per 10-degree bin with mergeable sums; everything else is column
arithmetic on the 36 bins of a group, so a group of any size is 36 rows after the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.operators.quantiles import order_statistics
from voltlake.runtime import materialize, small_side

BINS = 36
WIDTH = 360 / BINS


def phase_of(column: str) -> Column:
    """Degrees in [0, 360); a missing phase counts as 0."""
    p = F.col(column)
    return F.pmod(F.when(p.isNull() | F.isnan(p), F.lit(0.0)).otherwise(p), F.lit(360.0))


def phase_bin(phase: Column) -> Column:
    return F.least(F.floor(phase / WIDTH), F.lit(BINS - 1)).cast("int")


def binned(pulses: DataFrame, keys: Sequence[str], phase: str, amplitude: str, time: str | None = None) -> DataFrame:
    """One row per group and occupied bin with the sums that all statistics are made of.
    Pulses without a finite amplitude do not count."""
    a = F.abs(F.col(amplitude))
    ok = a.isNotNull() & ~F.isnan(a) & (a < F.lit(float("inf")))
    angle = F.radians("_p")
    rows = pulses.where(ok).withColumn("_p", phase_of(phase)).withColumn("_a", a).withColumn("_w", F.abs(F.sin(angle)))
    times = [F.min(time).alias("t0"), F.max(time).alias("t1")] if time else [F.lit(None).cast("double").alias("t0"), F.lit(None).cast("double").alias("t1")]
    return rows.groupBy(*keys, phase_bin(F.col("_p")).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("_a").alias("a"), F.sum(F.col("_a") * F.col("_a")).alias("aa"), F.max("_a").alias("top"),
        F.sum(F.sin(angle)).alias("sin"), F.sum(F.cos(angle)).alias("cos"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_w")).alias("ww"),
        F.sum(F.col("_a") * F.col("_w")).alias("aw"), *times,
    )


def _sum(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))


def shape_moments(xs: Column) -> tuple[Column, Column]:
    """Population skewness and excess kurtosis of an array; 0 where it is constant."""
    n = F.size(xs)
    mean = _sum(xs) / n
    m2, m3, m4 = (_sum(xs, lambda x, k=k: F.pow(x - mean, F.lit(float(k)))) / n for k in (2, 3, 4))
    flat = m2 <= 1e-24
    safe = F.when(flat, F.lit(1.0)).otherwise(m2)
    return F.when(flat, 0.0).otherwise(m3 / F.pow(safe, F.lit(1.5))), F.when(flat, 0.0).otherwise(m4 / (safe * safe) - 3)


def pearson(xs: Column, ys: Column) -> Column:
    n = F.size(xs)
    mx, my = _sum(xs) / n, _sum(ys) / n
    sxy = _sum(F.zip_with(xs, ys, lambda x, y: (x - mx) * (y - my)))
    sxx, syy = _sum(xs, lambda x: (x - mx) * (x - mx)), _sum(ys, lambda y: (y - my) * (y - my))
    return F.when((sxx > 1e-24) & (syy > 1e-24), sxy / F.sqrt(sxx * syy)).otherwise(0.0)


def local_peaks(xs: Column) -> Column:
    """Inner peaks of at least a tenth of the maximum; a plateau is one peak."""
    steps = F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1)))
    top = F.array_max(xs) * 0.1
    inner = F.filter(steps, lambda x, i: (i > 0) & (i < F.size(steps) - 1) & (x > F.get(steps, i - 1)) & (x > F.get(steps, i + 1)) & (x >= top))
    return F.size(inner)


def _variance(n: Column, s: Column, ss: Column) -> Column:
    return F.when(n > 0, F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0))).otherwise(0.0)


def prpd_features(bins: DataFrame, keys: Sequence[str], ac_frequency: float = 60.0) -> DataFrame:
    """The phase-resolved statistics of each group, from :func:`binned` rows.

    Statistics without a basis (empty half cycle, constant histogram, one pulse) are 0.
    With trigger times the repetition rate and pulses per cycle follow from the duration;
    without them they are the count-based stand-ins.
    """
    half = F.col("bin") < BINS // 2

    def over(name: str, which: Column | None = None) -> Column:
        v = F.col(name) if which is None else F.when(which, F.col(name))
        return F.coalesce(F.sum(v), F.lit(0))

    cell = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "a"))))  # at most 36 entries
    sums = {x: over(x) for x in ("n", "a", "aa", "sin", "cos", "w", "ww", "aw")}
    split = {f"{x}_{s}": over(x, half if s == "pos" else ~half) for x in ("n", "a", "aa") for s in ("pos", "neg")}
    tops = {f"top_{s}": F.coalesce(F.max(F.when(half if s == "pos" else ~half, F.col("top"))), F.lit(0.0)) for s in ("pos", "neg")}
    quads = {f"q{i + 1}": over("n", F.floor(F.col("bin") / 9) == i) for i in range(4)}
    wide = bins.groupBy(*keys).agg(
        cell.alias("_m"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), *[v.alias(k) for k, v in {**sums, **split, **tops, **quads}.items()]
    )
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    wide = wide.withColumn("hn", F.transform(every, lambda b: F.coalesce(F.try_element_at("_m", b)["n"], F.lit(0)).cast("double")))
    wide = wide.withColumn("hq", F.transform(every, lambda b: F.coalesce(F.try_element_at("_m", b)["a"], F.lit(0.0))))
    n = F.col("n")
    hn_pos, hn_neg = F.slice("hn", 1, BINS // 2), F.slice("hn", BINS // 2 + 1, BINS // 2)
    hq_pos, hq_neg = F.slice("hq", 1, BINS // 2), F.slice("hq", BINS // 2 + 1, BINS // 2)
    out = {"pulses_per_positive_halfcycle": F.col("n_pos"), "pulses_per_negative_halfcycle": F.col("n_neg"), "total_pulse_count": n}
    for name, xs in (("Hn_positive", hn_pos), ("Hn_negative", hn_neg), ("Hqn_positive", hq_pos), ("Hqn_negative", hq_neg)):
        out[f"skewness_{name}"], out[f"kurtosis_{name}"] = shape_moments(xs)
    out["cross_correlation"] = pearson(hn_pos, hn_neg)
    out["discharge_asymmetry"] = (F.col("n_pos") - F.col("n_neg")) / n
    for side, s in (("positive", "pos"), ("negative", "neg")):
        count = F.col(f"n_{s}")
        out[f"mean_amplitude_{side}"] = F.when(count > 0, F.col(f"a_{s}") / count).otherwise(0.0)
        out[f"max_amplitude_{side}"] = F.col(f"top_{s}")
        out[f"variance_amplitude_{side}"] = _variance(count, F.col(f"a_{s}"), F.col(f"aa_{s}"))
    mean, spread = F.col("a") / n, F.sqrt(_variance(n, F.col("a"), F.col("aa")))
    out["coefficient_of_variation"] = F.when(mean > 0, spread / F.when(mean > 0, mean)).otherwise(0.0)
    out["number_of_peaks_Hn_positive"], out["number_of_peaks_Hn_negative"] = local_peaks(hn_pos), local_peaks(hn_neg)
    most = F.array_max("hn")
    out["phase_of_max_activity"] = (F.array_position("hn", most) - 1) * WIDTH + WIDTH / 2
    r = F.sqrt(F.pow(F.col("sin") / n, F.lit(2.0)) + F.pow(F.col("cos") / n, F.lit(2.0)))
    inside = (r > 0) & (r < 1)
    out["phase_spread"] = F.when(n <= 1, 0.0).when(inside, F.degrees(F.sqrt(-2 * F.ln(F.when(inside, r))))).when(r >= 1, 0.0).otherwise(180.0)
    active = F.filter(F.transform("hn", lambda x, i: F.when(x > most * 0.05, i)), lambda i: i.isNotNull())
    out["inception_phase"] = F.array_min(active) * WIDTH + WIDTH / 2
    out["extinction_phase"] = F.array_max(active) * WIDTH + WIDTH / 2
    for i in range(1, 5):
        out[f"quadrant_{i}_percentage"] = F.col(f"q{i}") / n * 100
    duration = F.col("t1") - F.col("t0")
    timed = (n > 1) & duration.isNotNull()
    out["repetition_rate"] = F.when(timed, F.when(duration > 0, n / F.when(duration > 0, duration)).otherwise(0.0)).otherwise(n * ac_frequency / 360.0)
    cycles = F.when(timed & (duration > 0), duration * ac_frequency)
    out["pulses_per_cycle"] = F.coalesce(n / cycles, n.cast("double"))
    cov = F.col("aw") / n - mean * (F.col("w") / n)
    va, vw = _variance(n, F.col("a"), F.col("aa")), _variance(n, F.col("w"), F.col("ww"))
    steady = (va > mean * mean * 1e-20) & (vw > 1e-20)
    out["amplitude_phase_correlation"] = F.when((n > 10) & steady, cov / F.sqrt(F.when(steady, va * vw))).otherwise(0.0)
    out["phase_entropy"] = -_sum(F.transform("hn", lambda x: x / n), lambda p: F.when(p > 0, p * F.log2(F.when(p > 0, p))).otherwise(0.0)) / math.log2(BINS)
    out["amplitude_coefficient_of_variation"] = out["coefficient_of_variation"]
    return wide.select(*keys, *[c.cast("double").alias(k) for k, c in out.items()])


def weibull_fit(rows: DataFrame, keys: Sequence[str], value: str, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(keys..., weibull_alpha, weibull_beta): scale and shape by maximum likelihood over
    the positive finite values; groups of fewer than five have (0, 0), groups of one value
    that value and shape 0. Each Newton step is one aggregation of all groups; steps are
    taken until no shape moves by more than ``tolerance``, and if ``rounds`` of them do
    not suffice, that is an error."""
    v = F.col(value)
    logs = rows.where((v > 0) & (v < F.lit(float("inf")))).select(*keys, F.ln(v).alias("l"))
    logs = materialize(logs, "logs")
    start = logs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("l").alias("mean"), F.stddev_pop("l").alias("sd"))
    start = start.withColumn("k", F.when((F.col("n") >= 5) & (F.col("sd") > 1e-9), math.pi / math.sqrt(6) / F.col("sd")))
    state = materialize(start.drop("sd"), "weibull")

    def with_state(frame: DataFrame) -> DataFrame:
        side = small_side(frame.where(F.col("k").isNotNull()).withColumnsRenamed({k: f"_{k}" for k in keys}))
        on = None
        for k in keys:
            same = logs[k].eqNullSafe(side[f"_{k}"])
            on = same if on is None else on & same
        return logs.join(side, on)

    y = F.col("l") - F.col("mean")
    e = F.exp(F.col("k") * y)
    for _ in range(rounds):
        sums = with_state(state).groupBy(*keys).agg(
            F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("k").alias("k"), F.sum(e).alias("s0"), F.sum(y * e).alias("s1"), F.sum(y * y * e).alias("s2")
        )
        f = F.col("s1") / F.col("s0") - 1 / F.col("k")
        slope = F.col("s2") / F.col("s0") - F.pow(F.col("s1") / F.col("s0"), F.lit(2.0)) + 1 / (F.col("k") * F.col("k"))
        nxt = F.greatest(F.col("k") - f / slope, F.col("k") / 3)
        state = materialize(sums.select(*keys, "n", "mean", nxt.alias("k"), F.abs(nxt / F.col("k") - 1).alias("step")), "weibull")
        if not (state.agg(F.max("step")).first()[0] or 0.0) > tolerance:
            break
    else:
        raise ArithmeticError(f"no shape found in {rounds} rounds")
    fitted = with_state(state).groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("k").alias("k"), F.sum(e).alias("s0"))
    fitted = fitted.select(*keys, (F.exp("mean") * F.pow(F.col("s0") / F.col("n"), 1 / F.col("k"))).alias("weibull_alpha"), F.col("k").alias("weibull_beta"))
    rest = start.where(F.col("k").isNull()).select(*keys, F.when(F.col("n") >= 5, F.exp("mean")).otherwise(0.0).alias("weibull_alpha"), F.lit(0.0).alias("weibull_beta"))
    return fitted.unionByName(rest)


def feature_means(rows: DataFrame, keys: Sequence[str], features: Sequence[str], trim: float = 0.1) -> DataFrame:
    """(keys..., feature, n, mean, trimmed_mean): missing and infinite values count as 0;
    the trimmed mean leaves out the lowest and highest ``trim`` of the values of groups
    of five or more. Ties are cut by count, so the result is that of sorted values."""
    clean = [F.when(F.col(f).isNull() | F.isnan(f) | (F.abs(f) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.col(f)).alias(f) for f in features]
    base = materialize(rows.select(*keys, *clean), "clean")

    def cut(n: Column) -> Column:
        return F.when(n >= 5, F.floor(n * trim)).otherwise(F.lit(0))

    stats, totals = order_statistics(base, list(keys), list(features), lambda n: F.array_distinct(F.array(cut(n), n - 1 - cut(n))))
    ends = stats.groupBy(*keys, "measure").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = materialize(ends, "ends")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features]))
    long = base.select(*keys, cells.alias("c")).select(*keys, "c.feature", "c.v")
    side = small_side(ends.withColumnsRenamed({**{k: f"_{k}" for k in keys}, "measure": "_f"}))
    on = long["feature"] == side["_f"]
    for k in keys:
        on = on & long[k].eqNullSafe(side[f"_{k}"])
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    agg = long.join(side, on).groupBy(*keys, "feature").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        F.coalesce(F.sum(F.when((v > lo) & (v < hi), v)), F.lit(0.0)).alias("mid"),
        F.count(F.when(v <= lo, 1)).alias("upto"), F.count(F.when(v >= hi, 1)).alias("from"),
    )
    k = cut(F.col("n"))
    kept = F.col("mid") + (F.col("upto") - k) * F.col("lo") + (F.col("from") - k) * F.col("hi")
    trimmed = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(kept / (F.col("n") - 2 * k))
    return agg.select(*keys, "feature", "n", "mean", trimmed.alias("trimmed_mean"))
