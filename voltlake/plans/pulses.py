"""Queries over pulses: phase-resolved statistics, noise floors, scaling, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators import classify, prpd
from voltlake.runtime import materialize, once_per_key, read_table

KEYS = ["acquisition_id", "cluster"]
FEATURES = (
    "absolute_amplitude", "rise_time", "fall_time", "pulse_width", "slew_rate", "energy", "charge", "dominant_frequency", "center_frequency", "spectral_entropy", "pulse_count", "is_multi_pulse",
)
SCALED = ("absolute_amplitude", "rise_time", "slew_rate", "dominant_frequency")

NUDGE = 1 + 2e-12


def digits(c: Column, n: int = 9) -> Column:
    """The value with ``n`` digits after the first, so that sums in any order agree; the
    factor keeps halves of the last digit from depending on the engine."""
    return F.format_string(f"%.{n}e", c * F.lit(NUDGE) + F.lit(0.0)).try_cast("double")


def pulses(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each pulse once. Its cluster is its polarity, its amplitude the peak of that sign."""
    base = ["pulse_key", "acquisition_id", "sensor_id", "phase_angle", "polarity", "peak_amplitude_positive", "peak_amplitude_negative", "trigger_time"]
    rows = once_per_key(read_table(spark, sf_dir, "pulse_features").select(*dict.fromkeys([*base, *columns])), ["pulse_key"])
    up = F.col("polarity") > 0
    return rows.withColumn("cluster", F.when(F.isnan("polarity") | F.col("polarity").isNull(), -1).when(up, 1).otherwise(0)).withColumn(
        "signed_amplitude", F.when(up, F.col("peak_amplitude_positive")).otherwise(F.col("peak_amplitude_negative"))
    )


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prpd.binned(pulses(spark, sf_dir), KEYS, "phase_angle", "signed_amplitude", "trigger_time")


def phase_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses per acquisition, cluster and 10-degree bin."""
    return _bins(spark, sf_dir).select(*KEYS, "bin", F.col("n").alias("n_pulses"))


def prpd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-resolved statistics of each acquisition and cluster."""
    found = prpd.prpd_features(_bins(spark, sf_dir), KEYS)
    return found.select(*KEYS, *[F.round(c, 5).alias(c) if c not in ROUGH else digits(F.col(c), 6).alias(c) for c in found.columns if c not in KEYS])


#: Statistics in volts or per second, compared by digits rather than decimals.
ROUGH = {
    *(f"{s}_amplitude_{h}" for s in ("mean", "max", "variance") for h in ("positive", "negative")), "repetition_rate", "pulses_per_cycle",
}


def weibull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weibull scale and shape of the amplitudes of each acquisition and cluster."""
    rows = pulses(spark, sf_dir).withColumn("size", F.abs("signed_amplitude"))
    got = prpd.weibull_fit(rows, KEYS, "size")
    return got.select(*KEYS, *[digits(F.col(c), 6).alias(c) for c in ("weibull_alpha", "weibull_beta")])


def cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and trimmed mean of each pulse feature by acquisition and cluster."""
    got = prpd.feature_means(pulses(spark, sf_dir, *FEATURES), KEYS, FEATURES)
    return got.select(*KEYS, "feature", "n", digits(F.col("mean")).alias("mean"), digits(F.col("trimmed_mean")).alias("trimmed_mean"))


def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise threshold of each acquisition: the least amplitude less one converter step."""
    return _floors(spark, sf_dir).select(
        "acquisition_id", "n_pulses", digits(F.col("least")).alias("min_absolute_amplitude"), digits(F.col("mean")).alias("mean_amplitude"),
        digits(F.col("sd")).alias("std_amplitude"), digits(F.greatest(F.lit(0.0), F.col("least") - F.col("adc_step_v"))).alias("noise_threshold"),
    )


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once_per_key(read_table(spark, sf_dir, "pulse_features").select("pulse_key", "acquisition_id", "sensor_id", "absolute_amplitude"), ["pulse_key"])
    a = F.col("absolute_amplitude")
    ok = rows.where(a.isNotNull() & ~F.isnan(a) & (a >= 0) & (a < F.lit(float("inf"))))
    stats = ok.groupBy("acquisition_id").agg(
        F.max("sensor_id").alias("sensor_id"), F.count("*").alias("n_pulses"), F.min(a).alias("least"), F.avg(a).alias("mean"), F.stddev_pop(a).alias("sd")
    )
    steps = read_table(spark, sf_dir, "sensors").select("sensor_id", "adc_step_v")
    return stats.join(F.broadcast(steps.dropDuplicates(["sensor_id"])), "sensor_id")  # 48 sensors at every scale


def normalized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse features relative to the acquisition's noise floor and sampling."""
    need = ("absolute_amplitude", "rise_time", "fall_time", "pulse_width", "slew_rate", "dominant_frequency", "center_frequency")
    rows = pulses(spark, sf_dir, *need)
    floor = F.greatest(F.col("adc_step_v"), F.col("least") - F.col("adc_step_v"))
    floors = _floors(spark, sf_dir).select("acquisition_id", floor.alias("floor"))
    setup = read_table(spark, sf_dir, "acquisitions").select("acquisition_id", F.coalesce("sample_interval", F.lit(4e-9)).alias("dt"))
    facts = floors.join(setup.dropDuplicates(["acquisition_id"]), "acquisition_id", "left")
    width = F.col("pulse_width")
    share = lambda c: F.when((width != 0) & ~F.isnan(width), F.col(c) / F.when(width != 0, width)).otherwise(0.0)
    out = {
        "signal_to_noise_ratio": F.col("absolute_amplitude") / F.col("floor"), "norm_peak_amplitude_positive": F.col("peak_amplitude_positive") / F.col("floor"),
        "norm_peak_amplitude_negative": F.col("peak_amplitude_negative") / F.col("floor"), "norm_slew_rate": F.col("slew_rate") * F.col("dt") / F.col("floor"),
        "norm_rise_time": share("rise_time"), "norm_fall_time": share("fall_time"),
        "norm_dominant_frequency": F.col("dominant_frequency") * 2 * F.col("dt"), "norm_center_frequency": F.col("center_frequency") * 2 * F.col("dt"),
    }
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    return rows.join(facts, "acquisition_id").select("pulse_key", "acquisition_id", *[digits(clean(v)).alias(k) for k, v in out.items()])


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population z-scores within each acquisition; missing and infinite values count as
    0, constant columns give 0."""
    rows = pulses(spark, sf_dir, *SCALED)
    clean = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in SCALED]
    base = materialize(rows.select("pulse_key", "acquisition_id", *clean), "clean")
    stats = base.groupBy("acquisition_id").agg(*[f(c).alias(f"{n}_{c}") for c in SCALED for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = base.join(stats, "acquisition_id")
    z = [F.when(F.col(f"s_{c}") > 0, F.round((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")), 5) + 0.0).otherwise(0.0).alias(f"z_{c}") for c in SCALED]
    return joined.select("pulse_key", "acquisition_id", *z)


def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of each pair of features within each acquisition; 0 where a
    feature is constant. All pairs come from one aggregation."""
    rows = pulses(spark, sf_dir, *SCALED)
    ok = None
    for c in SCALED:
        one = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        ok = one if ok is None else ok & one
    pairs = [(a, b) for i, a in enumerate(SCALED) for b in SCALED[i + 1 :]]
    logs = rows.where(ok).where(" AND ".join(f"{c} > 0" for c in SCALED)).select("acquisition_id", *[F.ln(c).alias(c) for c in SCALED])
    stats = logs.groupBy("acquisition_id").agg(
        F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], *[F.stddev_pop(c).alias(f"s_{c}") for c in SCALED]
    )
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("c"), (F.col(f"s_{a}") * F.col(f"s_{b}")).alias("s")) for i, (a, b) in enumerate(pairs)]))
    r = F.when(F.col("x.s") > 1e-12, F.round(F.col("x.c") / F.when(F.col("x.s") > 1e-12, F.col("x.s")), 6) + 0.0).otherwise(0.0)
    return stats.select("acquisition_id", "n", cells.alias("x")).select("acquisition_id", F.col("x.feature_a").alias("feature_a"), F.col("x.feature_b").alias("feature_b"), "n", r.alias("correlation"))


_TYPE_MEANS = ("absolute_amplitude", "slew_rate", "dominant_frequency", "pulse_count", "is_multi_pulse")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_groups(spark, sf_dir, materialize(pulses(spark, sf_dir, *_TYPE_MEANS), "pulses"))


def typed_groups(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Statistics, mean features and scores of each acquisition and cluster of ``rows``.
    The means are rounded before they meet a threshold, so that the order of summation
    cannot."""
    stats = prpd.prpd_features(prpd.binned(rows, KEYS, "phase_angle", "signed_amplitude", "trigger_time"), KEYS)
    stats = stats.select(*KEYS, *[F.round(c, 5).alias(c) for c in stats.columns if c not in KEYS])
    clean = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.col(c))
    means = rows.groupBy(*KEYS).agg(*[digits(F.avg(clean(c)), 6).alias(f"mean_{c}") for c in _TYPE_MEANS])
    floor = F.greatest(F.col("adc_step_v"), F.col("least") - F.col("adc_step_v"))
    floors = _floors(spark, sf_dir).select("acquisition_id", floor.alias("floor"))
    joined = stats.join(means, KEYS).join(floors, "acquisition_id")
    with_snr = joined.withColumn("mean_signal_to_noise_ratio", digits(F.col("mean_absolute_amplitude") / F.col("floor"), 6)).drop("floor")
    return classify.classified(with_snr)


def discharge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, type and confidence of each acquisition and cluster."""
    scores = list(dict.fromkeys(r.score for r in classify.RULES))
    return _typed(spark, sf_dir).select(*KEYS, *[F.round(s, 6).alias(s) for s in scores], "pd_type", F.round("confidence", 6).alias("confidence"))


def type_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule saw in each cluster of an acquisition, and the points it gave."""
    got = classify.rule_outcomes(_typed(spark, sf_dir), KEYS)
    return got.select(*KEYS, "rule", "score", "features", (F.round("value", 6) + 0.0).alias("value"), "points")


def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, pulses and mean confidence per type, with a total."""
    typed = _typed(spark, sf_dir)
    got = typed.rollup("pd_type").agg(F.count("*").alias("n_clusters"), F.sum("total_pulse_count").cast("long").alias("n_pulses"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return got.withColumn("pd_type", F.coalesce("pd_type", F.lit("all")))


QUERIES = {
    "phase_histogram": phase_histogram, "prpd_features": prpd_features, "weibull": weibull, "cluster_means": cluster_means, "noise_floor": noise_floor,
    "normalized_features": normalized_features, "scaled_features": scaled_features, "feature_correlation": feature_correlation,
    "discharge_types": discharge_types, "type_diagnosis": type_diagnosis, "type_summary": type_summary,
}

# ---- the same in SQL


def _once(columns: tuple[str, ...]) -> str:
    base = ("acquisition_id", "sensor_id", "phase_angle", "polarity", "peak_amplitude_positive", "peak_amplitude_negative", "trigger_time")
    mins = ", ".join(f"min({c}) AS {c}" for c in dict.fromkeys((*base, *columns)))
    return f"""raw AS (SELECT pulse_key, {mins} FROM pulse_features GROUP BY pulse_key),
once AS (SELECT *, CASE WHEN polarity IS NULL OR isnan(polarity) THEN -1 WHEN polarity > 0 THEN 1 ELSE 0 END AS cluster,
  CASE WHEN polarity > 0 THEN peak_amplitude_positive ELSE peak_amplitude_negative END AS signed_amplitude FROM raw)"""


_BINS_SQL = """p AS (SELECT acquisition_id, cluster, abs(signed_amplitude) AS a, trigger_time AS t,
  ((CASE WHEN phase_angle IS NULL OR isnan(phase_angle) THEN 0 ELSE phase_angle END % 360) + 360) % 360 AS ph FROM once WHERE isfinite(signed_amplitude)),
b AS (SELECT *, least(floor(ph / 10), 35)::INTEGER AS bin, abs(sin(radians(ph))) AS w FROM p)"""


def _dig(e: str, n: int = 9) -> str:
    return f"CAST(printf('%.{n}e', ({e}) * {NUDGE!r}::DOUBLE + 0.0) AS DOUBLE)"


def _moment(xs: str, k: int) -> str:
    mean = f"(list_sum({xs}) / 18.0)"
    return f"(list_sum(list_transform({xs}, lambda x: pow(x - {mean}, {k}))) / 18.0)"


def _shape(xs: str) -> tuple[str, str]:
    m2, m3, m4 = (_moment(xs, k) for k in (2, 3, 4))
    return f"CASE WHEN {m2} <= 1e-24 THEN 0 ELSE {m3} / pow({m2}, 1.5) END", f"CASE WHEN {m2} <= 1e-24 THEN 0 ELSE {m4} / pow({m2}, 2) - 3 END"


def _prpd_sql() -> tuple[str, dict[str, str]]:
    hn = ", ".join(f"count(*) FILTER (WHERE bin = {i})::DOUBLE" for i in range(36))
    hq = ", ".join(f"coalesce(sum(a) FILTER (WHERE bin = {i}), 0)" for i in range(36))
    base = f"""g AS (SELECT acquisition_id, cluster, count(*) AS n, list_value({hn}) AS hn, list_value({hq}) AS hq,
  avg(a) AS mean, avg(a * a) AS aa, avg(w) AS mw, avg(w * w) AS ww, avg(a * w) AS aw, max(t) - min(t) AS dur,
  avg(sin(radians(ph))) AS ms, avg(cos(radians(ph))) AS mc,
  count(*) FILTER (WHERE bin < 18) AS n_pos, count(*) FILTER (WHERE bin >= 18) AS n_neg,
  coalesce(avg(a) FILTER (WHERE bin < 18), 0) AS m_pos, coalesce(avg(a) FILTER (WHERE bin >= 18), 0) AS m_neg,
  coalesce(avg(a * a) FILTER (WHERE bin < 18), 0) AS aa_pos, coalesce(avg(a * a) FILTER (WHERE bin >= 18), 0) AS aa_neg,
  coalesce(max(a) FILTER (WHERE bin < 18), 0) AS x_pos, coalesce(max(a) FILTER (WHERE bin >= 18), 0) AS x_neg,
  {", ".join(f"count(*) FILTER (WHERE bin // 9 = {i}) AS q{i + 1}" for i in range(4))}
  FROM b GROUP BY acquisition_id, cluster),
h AS (SELECT *, hn[1:18] AS hp, hn[19:36] AS hm, hq[1:18] AS kp, hq[19:36] AS km, sqrt(ms * ms + mc * mc) AS r, list_max(hn) AS most,
  greatest(aa - mean * mean, 0) AS va, greatest(ww - mw * mw, 0) AS vw FROM g)"""
    out = {"pulses_per_positive_halfcycle": "n_pos", "pulses_per_negative_halfcycle": "n_neg", "total_pulse_count": "n"}
    for name, xs in (("Hn_positive", "hp"), ("Hn_negative", "hm"), ("Hqn_positive", "kp"), ("Hqn_negative", "km")):
        out[f"skewness_{name}"], out[f"kurtosis_{name}"] = _shape(xs)
    dot = "list_sum(list_transform(range(1, 19), lambda i: (hp[i] - list_sum(hp) / 18) * (hm[i] - list_sum(hm) / 18))) / 18"
    out["cross_correlation"] = f"CASE WHEN {_moment('hp', 2)} > 1e-20 AND {_moment('hm', 2)} > 1e-20 THEN {dot} / sqrt({_moment('hp', 2)} * {_moment('hm', 2)}) ELSE 0 END"
    out["discharge_asymmetry"] = "(n_pos - n_neg) / n"
    for side, s in (("positive", "pos"), ("negative", "neg")):
        out[f"mean_amplitude_{side}"], out[f"max_amplitude_{side}"] = f"m_{s}", f"x_{s}"
        out[f"variance_amplitude_{side}"] = f"greatest(aa_{s} - m_{s} * m_{s}, 0)"
    out["coefficient_of_variation"] = "CASE WHEN mean > 0 THEN sqrt(va) / mean ELSE 0 END"
    for side, xs in (("positive", "hp"), ("negative", "hm")):
        steps = f"list_filter({xs}, lambda x, i: i = 1 OR x <> {xs}[i - 1])"
        out[f"number_of_peaks_Hn_{side}"] = f"len(list_filter(range(2, len({steps})), lambda i: ({steps})[i] > ({steps})[i - 1] AND ({steps})[i] > ({steps})[i + 1] AND ({steps})[i] >= list_max({xs}) * 0.1))"
    out["phase_of_max_activity"] = "(list_position(hn, most) - 1) * 10 + 5"
    out["phase_spread"] = "CASE WHEN n <= 1 OR r >= 1 THEN 0 WHEN r > 0 THEN degrees(sqrt(-2 * ln(r))) ELSE 180 END"
    active = "list_filter(range(0, 36), lambda i: hn[i + 1] > most * 0.05)"
    out["inception_phase"], out["extinction_phase"] = f"list_min({active}) * 10 + 5", f"list_max({active}) * 10 + 5"
    for i in range(1, 5):
        out[f"quadrant_{i}_percentage"] = f"q{i} / n * 100"
    out["repetition_rate"] = "CASE WHEN n > 1 AND dur IS NOT NULL THEN CASE WHEN dur > 0 THEN n / dur ELSE 0 END ELSE n * 60.0 / 360 END"
    out["pulses_per_cycle"] = "CASE WHEN n > 1 AND dur > 0 THEN n / (dur * 60) ELSE n END"
    out["amplitude_phase_correlation"] = "CASE WHEN n > 10 AND va > mean * mean * 1e-20 AND vw > 1e-20 THEN (aw - mean * mw) / sqrt(va * vw) ELSE 0 END"
    out["phase_entropy"] = "-list_sum(list_transform(hn, lambda x: CASE WHEN x > 0 THEN x / n * log2(x / n) ELSE 0 END)) / log2(36)"
    out["amplitude_coefficient_of_variation"] = out["coefficient_of_variation"]
    return base, {k: f"CAST({v} AS DOUBLE)" for k, v in out.items()}


_PRPD_BASE, _PRPD = _prpd_sql()
_OK = "isfinite({0}) AND {0} IS NOT NULL"


def _zero(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 0 ELSE {c} END"


_FLOORS_SQL = """fl AS (SELECT acquisition_id, max(sensor_id) AS sensor_id, count(*) AS n_pulses, min(a) AS least, avg(a) AS mean, stddev_pop(a) AS sd
  FROM (SELECT pulse_key, min(acquisition_id) AS acquisition_id, min(sensor_id) AS sensor_id, min(absolute_amplitude) AS a FROM pulse_features GROUP BY pulse_key)
  WHERE a >= 0 AND isfinite(a) GROUP BY acquisition_id),
floors AS (SELECT fl.*, adc_step_v, greatest(adc_step_v, least - adc_step_v) AS floor FROM fl JOIN sensors USING (sensor_id))"""


#: Newton steps from the first shape; the operator stops by itself, in far fewer.
_STEPS = 40

_WEIBULL = f"""WITH RECURSIVE {_once(())}, l AS (SELECT acquisition_id, cluster, ln(abs(signed_amplitude)) AS l FROM once WHERE abs(signed_amplitude) > 0 AND isfinite(signed_amplitude)),
g AS (SELECT acquisition_id, cluster, count(*) AS n, avg(l) AS mean, stddev_pop(l) AS sd, list(l) AS ls FROM l GROUP BY ALL),
y AS (SELECT *, list_transform(ls, lambda v: v - mean) AS ys FROM g WHERE n >= 5 AND sd > 1e-9),
k AS (SELECT acquisition_id, cluster, n, mean, ys, 0 AS step, pi() / sqrt(6) / sd AS k FROM y UNION ALL
  SELECT acquisition_id, cluster, n, mean, ys, step + 1, greatest(k - (s1 / s0 - 1 / k) / (s2 / s0 - pow(s1 / s0, 2) + 1 / (k * k)), k / 3) FROM (
    SELECT *, list_sum(list_transform(ys, lambda v: exp(k * v))) AS s0, list_sum(list_transform(ys, lambda v: v * exp(k * v))) AS s1,
      list_sum(list_transform(ys, lambda v: v * v * exp(k * v))) AS s2 FROM k WHERE step < {_STEPS})),
r AS (SELECT acquisition_id, cluster, exp(mean) * pow(list_sum(list_transform(ys, lambda v: exp(k * v))) / n, 1 / k) AS a, k AS b FROM k WHERE step = {_STEPS}
  UNION ALL SELECT acquisition_id, cluster, CASE WHEN n >= 5 THEN exp(mean) ELSE 0 END, 0 FROM g WHERE n < 5 OR sd <= 1e-9)
SELECT acquisition_id, cluster, {_dig("a", 6)} AS weibull_alpha, {_dig("b", 6)} AS weibull_beta FROM r"""


def _diagnosis_sql() -> str:
    columns = [*KEYS, *_PRPD, *(f"mean_{c}" for c in _TYPE_MEANS), "mean_signal_to_noise_ratio"]
    parts = [
        f"""SELECT acquisition_id, cluster, {i}::INTEGER AS rule, '{r.score}' AS score, '{" ".join(t.feature for t in r.tests)}' AS features,
  CAST(round({classify.value_text(r.tests[0], columns)}, 6) + 0.0 AS DOUBLE) AS value, CASE WHEN {classify.held_text(r, columns)} THEN {classify.num(r.points)} ELSE 0e0 END AS points FROM al"""
        for i, r in enumerate(classify.RULES)
    ]
    return _types_sql() + " UNION ALL ".join(parts)


def _types_sql() -> str:
    stats = ", ".join(f"round({v}, 5) AS {k}" for k, v in _PRPD.items())
    means = ", ".join(f"{_dig(f'avg({_zero(c)})', 6)} AS mean_{c}" for c in _TYPE_MEANS)
    columns = [*KEYS, *_PRPD, *(f"mean_{c}" for c in _TYPE_MEANS), "mean_signal_to_noise_ratio"]
    scores = ", ".join(f"{v} AS {k}" for k, v in classify.score_texts(columns).items())
    decisions = ", ".join(f"{v} AS {k}" for k, v in classify.decision_texts(columns).items())
    return f"""WITH {_once(_TYPE_MEANS)}, {_BINS_SQL}, {_PRPD_BASE}, {_FLOORS_SQL},
st AS (SELECT acquisition_id, cluster, {stats} FROM h),
me AS (SELECT acquisition_id, cluster, {means} FROM once GROUP BY acquisition_id, cluster),
al AS (SELECT st.*, me.* EXCLUDE (acquisition_id, cluster), {_dig("mean_absolute_amplitude / floor", 6)} AS mean_signal_to_noise_ratio
  FROM st JOIN me USING (acquisition_id, cluster) JOIN floors USING (acquisition_id)),
sc AS (SELECT *, {scores} FROM al),
ty AS (SELECT *, {decisions} FROM sc) """


_SCORES = list(dict.fromkeys(r.score for r in classify.RULES))
_PAIRS = [(a, b) for i, a in enumerate(SCALED) for b in SCALED[i + 1 :]]

SQL = {
    "weibull": _WEIBULL,
    "type_diagnosis": _diagnosis_sql(),
    "phase_histogram": f"WITH {_once(())}, {_BINS_SQL} SELECT acquisition_id, cluster, bin, count(*) AS n_pulses FROM b GROUP BY ALL",
    "prpd_features": f"WITH {_once(())}, {_BINS_SQL}, {_PRPD_BASE} SELECT acquisition_id, cluster, "
    + ", ".join((f"round({v}, 5)" if k not in ROUGH else _dig(v, 6)) + f" AS {k}" for k, v in _PRPD.items()) + " FROM h",
    "cluster_means": f"""WITH {_once(FEATURES)},
l AS ({" UNION ALL ".join(f"SELECT acquisition_id, cluster, '{f}' AS feature, {_zero(f)} AS v FROM once" for f in FEATURES)}),
o AS (SELECT *, row_number() OVER (PARTITION BY acquisition_id, cluster, feature ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY acquisition_id, cluster, feature) AS n FROM l)
SELECT acquisition_id, cluster, feature, max(n) AS n, {_dig("avg(v)")} AS mean,
  {_dig("avg(v) FILTER (WHERE n < 5 OR (k >= floor(n * 0.1) AND k < n - floor(n * 0.1)))")} AS trimmed_mean FROM o GROUP BY ALL""",
    "noise_floor": f"""WITH {_FLOORS_SQL} SELECT acquisition_id, n_pulses, {_dig("least")} AS min_absolute_amplitude, {_dig("mean")} AS mean_amplitude,
  {_dig("sd")} AS std_amplitude, {_dig("greatest(0, least - adc_step_v)")} AS noise_threshold FROM floors""",
    "normalized_features": f"""WITH {_once(("absolute_amplitude", "rise_time", "fall_time", "pulse_width", "slew_rate", "dominant_frequency", "center_frequency"))}, {_FLOORS_SQL},
n AS (SELECT o.pulse_key, o.acquisition_id, absolute_amplitude / floor AS signal_to_noise_ratio, peak_amplitude_positive / floor AS norm_peak_amplitude_positive,
  peak_amplitude_negative / floor AS norm_peak_amplitude_negative, slew_rate * coalesce(a.sample_interval, 4e-9) / floor AS norm_slew_rate,
  CASE WHEN pulse_width <> 0 AND NOT isnan(pulse_width) THEN rise_time / pulse_width ELSE 0 END AS norm_rise_time,
  CASE WHEN pulse_width <> 0 AND NOT isnan(pulse_width) THEN fall_time / pulse_width ELSE 0 END AS norm_fall_time,
  dominant_frequency * 2 * coalesce(a.sample_interval, 4e-9) AS norm_dominant_frequency, center_frequency * 2 * coalesce(a.sample_interval, 4e-9) AS norm_center_frequency
  FROM once o JOIN floors USING (acquisition_id) LEFT JOIN acquisitions a ON a.acquisition_id = o.acquisition_id)
SELECT pulse_key, acquisition_id, {", ".join(f"{_dig(_zero(c))} AS {c}" for c in ("signal_to_noise_ratio", "norm_peak_amplitude_positive", "norm_peak_amplitude_negative", "norm_slew_rate", "norm_rise_time", "norm_fall_time", "norm_dominant_frequency", "norm_center_frequency"))} FROM n""",
    "scaled_features": f"""WITH {_once(SCALED)}, c AS (SELECT pulse_key, acquisition_id, {", ".join(f"{_zero(f)} AS {f}" for f in SCALED)} FROM once),
s AS (SELECT acquisition_id, {", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in SCALED)} FROM c GROUP BY acquisition_id)
SELECT pulse_key, acquisition_id, {", ".join(f"CAST(CASE WHEN s_{f} > 0 THEN round(({f} - m_{f}) / s_{f}, 5) + 0.0 ELSE 0 END AS DOUBLE) AS z_{f}" for f in SCALED)} FROM c JOIN s USING (acquisition_id)""",
    "feature_correlation": f"""WITH {_once(SCALED)}, c AS (SELECT acquisition_id, {", ".join(f"ln({f}) AS {f}" for f in SCALED)} FROM once WHERE {" AND ".join(f"{f} > 0 AND isfinite({f})" for f in SCALED)}),
s AS ({" UNION ALL ".join(f"SELECT acquisition_id, '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, covar_pop({a}, {b}) AS c, stddev_pop({a}) * stddev_pop({b}) AS s FROM c GROUP BY acquisition_id" for a, b in _PAIRS)})
SELECT acquisition_id, feature_a, feature_b, n, CAST(CASE WHEN s > 1e-12 THEN round(c / s, 6) + 0.0 ELSE 0 END AS DOUBLE) AS correlation FROM s""",
    "discharge_types": _types_sql() + "SELECT acquisition_id, cluster, " + ", ".join(f"CAST(round({s}, 6) AS DOUBLE) AS {s}" for s in _SCORES) + ", pd_type, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM ty",
    "type_summary": _types_sql() + """SELECT coalesce(pd_type, 'all') AS pd_type, count(*) AS n_clusters, CAST(sum(total_pulse_count) AS BIGINT) AS n_pulses, CAST(round(avg(confidence), 6) AS DOUBLE) AS mean_confidence
FROM ty GROUP BY ROLLUP (pd_type)""",
}
