"""Queries that cluster pulses, weigh features and calibrate thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators import analytics, classify, clustering, labels
from voltlake.plans import pulses as p
from voltlake.plans.pulses import digits
from voltlake.runtime import materialize, read_table

AXES = ("z_amplitude", "z_rise", "z_frequency")
_OF = {"z_amplitude": "absolute_amplitude", "z_rise": "rise_time", "z_frequency": "dominant_frequency"}
#: Patterns for the names of these data sets; the usual ones are in operators.labels.
LABELS = (("SURFACE", "surface|insulator|bushing|termination"), ("CORONA", "corona|needle|busbar"), ("INTERNAL", "internal|void|joint|stator"), ("NOISE", "noise|background"))


def label_of(name: Column) -> Column:
    return labels.label_of(name, [(kind, (pattern,)) for kind, pattern in LABELS])


def log_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(acquisition_id, pulse_key, axes): logs of the usable pulses, scaled per acquisition."""
    rows = p.pulses(spark, sf_dir, *_OF.values())
    for c in _OF.values():
        rows = rows.where((F.col(c) > 0) & (F.col(c) < F.lit(float("inf"))))
    logs = materialize(rows.select("acquisition_id", "pulse_key", *[F.ln(c).alias(a) for a, c in _OF.items()]), "logs")
    stats = logs.groupBy("acquisition_id").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = logs.join(stats, "acquisition_id")
    z = [F.coalesce(F.try_divide(F.col(a) - F.col(f"m_{a}"), F.col(f"s_{a}")), F.lit(0.0)).alias(a) for a in AXES]
    return materialize(joined.select("acquisition_id", "pulse_key", *z), "scaled")


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five centre-based clusters per acquisition."""
    return clustering.kmeans(log_scaled(spark, sf_dir), "acquisition_id", "pulse_key", AXES)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled pulses, their k-means clusters, statistics and means of each cluster, and
    its type. Pulses that cannot be scaled are in no cluster (-1)."""
    labels = materialize(clustering.kmeans(log_scaled(spark, sf_dir), "acquisition_id", "pulse_key", AXES).select("pulse_key", F.col("cluster").alias("label")), "labels")
    rows = p.pulses(spark, sf_dir, *p._TYPE_MEANS, *SUMMARY).join(labels, "pulse_key", "left")
    rows = materialize(rows.withColumn("cluster", F.coalesce("label", F.lit(classify.NO_CLUSTER))).drop("label"), "clustered")
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(F.col(c))
    means = rows.groupBy(*p.KEYS).agg(*[digits(f(clean(c)), 6).alias(f"{n}_{c}") for c in SUMMARY for n, f in (("avg", F.avg), ("std", F.stddev))])
    typed = p.typed_groups(spark, sf_dir, rows).join(means, p.KEYS)
    return materialize(typed.withColumn("pd_type_code", classify.type_code(F.col("pd_type"))), "typed")


#: Features that the summary of clusters describes.
SUMMARY = ("absolute_amplitude", "rise_time", "fall_time", "energy", "dominant_frequency")


def pipeline_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each k-means cluster of an acquisition with its size, features, type and confidence."""
    facts = [f"{n}_{c}" for c in SUMMARY for n in ("avg", "std")]
    return _pipeline(spark, sf_dir).select(*p.KEYS, F.col("total_pulse_count").cast("long").alias("n_pulses"), "phase_spread", "phase_of_max_activity", *facts, "pd_type", "pd_type_code", F.round("confidence", 6).alias("confidence"))


def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each acquisition with its clusters by type, and the type that most of its pulses have."""
    typed = _pipeline(spark, sf_dir).select("acquisition_id", "cluster", "pd_type", F.col("total_pulse_count").cast("long").alias("n"), "confidence")
    by_type = typed.groupBy("acquisition_id", "pd_type").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("confidence")).alias("c"))
    main = F.max_by("pd_type", F.struct("n", "pd_type"))
    return by_type.groupBy("acquisition_id").agg(
        F.sum("clusters").alias("n_clusters"), F.sum("n").alias("n_pulses"), main.alias("main_type"), (F.max("n") / F.sum("n")).alias("main_share"), (F.sum("c") / F.sum("n")).alias("mean_confidence")
    )


def neighbour_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood radius of each acquisition: 60th percentile of 5-th neighbours."""
    rows = log_scaled(spark, sf_dir)
    near = materialize(clustering.neighbour_distances(rows, "acquisition_id", "pulse_key", AXES), "near")
    return clustering.estimate_eps(near, "acquisition_id").select("acquisition_id", digits(F.col("eps"), 6).alias("eps"))


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = log_scaled(spark, sf_dir)
    near = materialize(clustering.neighbour_distances(rows, "acquisition_id", "pulse_key", AXES), "near")
    eps = materialize(clustering.estimate_eps(near, "acquisition_id"), "eps")
    return rows, clustering.dbscan(rows, "acquisition_id", "pulse_key", AXES, eps)


def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters per acquisition with the estimated radius; noise is null."""
    return _dense(spark, sf_dir)[1]


def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of the density clusters of each acquisition."""
    rows, labels = _dense(spark, sf_dir)
    return clustering.silhouette(rows.join(labels.select("pulse_key", "cluster"), "pulse_key"), "acquisition_id", "cluster", AXES)


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pulse on the first two principal components of its scaled features."""
    return analytics.project(log_scaled(spark, sf_dir), ["pulse_key"], AXES)


def feature_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each pulse feature and whether it is among the five recommended."""
    rows = p.pulses(spark, sf_dir, *p.FEATURES)
    zero = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.col(c))
    clean = rows.select(*[zero(c).alias(c) for c in p.FEATURES])
    _, _, matrix = analytics.covariance(clean, p.FEATURES)
    return spark.createDataFrame(analytics.recommended(p.FEATURES, matrix), "feature string, importance double, recommended boolean")


def component_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading of each pulse feature on each principal component, with the variance that
    the component and all before it explain."""
    rows = p.pulses(spark, sf_dir, *p.FEATURES)
    zero = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.col(c))
    clean = rows.select(*[zero(c).alias(c) for c in p.FEATURES])
    _, _, matrix = analytics.covariance(clean, p.FEATURES)
    return spark.createDataFrame(analytics.loadings(p.FEATURES, matrix), "component int, feature string, loading double, explained double, cumulative double")


def feature_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F value of each log feature over the polarity clusters of an acquisition."""
    rows = p.pulses(spark, sf_dir, *p.SCALED)
    logs = rows.select("acquisition_id", "cluster", *[F.when(F.col(c) > 0, F.ln(F.when(F.col(c) > 0, F.col(c)))).alias(c) for c in p.SCALED])
    got = analytics.anova(logs, "acquisition_id", "cluster", p.SCALED)
    return got.select("acquisition_id", "feature", "n", "labels", digits(F.col("f_value"), 5).alias("f_value"))


def feature_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information between each log feature and the polarity clusters."""
    rows = p.pulses(spark, sf_dir, *p.SCALED)
    logs = rows.select("acquisition_id", "cluster", *[F.when(F.col(c) > 0, F.round(F.ln(F.when(F.col(c) > 0, F.col(c))), 9)).alias(c) for c in p.SCALED])
    got = analytics.mutual_information(logs, "acquisition_id", "cluster", p.SCALED)
    return got.select("acquisition_id", "feature", "n", (F.round("information", 6) + 0.0).alias("information"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_table(spark, sf_dir, "acquisitions").select("acquisition_id", label_of(F.col("dataset")).alias("expected"))
    typed = p._typed(spark, sf_dir)
    return typed.join(names.dropDuplicates(["acquisition_id"]), "acquisition_id")


def type_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses by expected and found type, with totals."""
    got = classify.confusion(_judged(spark, sf_dir), "expected", "pd_type", F.col("total_pulse_count").cast("long"))
    return got.select(F.coalesce("expected", F.lit("all")).alias("expected"), F.coalesce("pd_type", F.lit("all")).alias("pd_type"), "n")


def type_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses of each expected type and the share that was found as it."""
    got = classify.recall_by_type(_judged(spark, sf_dir), "expected", "pd_type", F.col("total_pulse_count").cast("long"))
    return got.select("expected", "n", "hits", F.round("recall", 6).alias("recall"))


GRID = [(a / 100, float(b), float(c)) for a in (25, 35, 45) for b in (6, 8, 10) for c in (10, 12, 15, 18)]


def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by pulses of every combination of the least scores."""
    rows = materialize(_judged(spark, sf_dir).drop("pd_type", "confidence"), "judged")
    grid = spark.createDataFrame(GRID, "noise_limit double, surface_limit double, pair_limit double")
    got = analytics.grid_search(rows, "expected", "total_pulse_count", grid)
    return got.select("noise_limit", "surface_limit", "pair_limit", F.col("n").cast("long").alias("n"), F.round("accuracy", 6).alias("accuracy"))


QUERIES = {
    "kmeans_clusters": kmeans_clusters, "pipeline_clusters": pipeline_clusters, "pipeline_summary": pipeline_summary, "neighbour_eps": neighbour_eps, "dbscan_clusters": dbscan_clusters, "cluster_quality": cluster_quality,
    "principal_components": principal_components, "feature_recommendation": feature_recommendation, "feature_anova": feature_anova, "feature_information": feature_information,
    "component_loadings": component_loadings, "type_confusion": type_confusion, "type_recall": type_recall, "threshold_search": threshold_search,
}

_EXPECTED = "CASE " + " ".join(f"WHEN regexp_matches(lower(dataset), '{pattern}') THEN '{kind}'" for kind, pattern in LABELS) + " ELSE 'UNKNOWN' END"
_JUDGED = p._types_sql() + f", ju AS (SELECT ty.*, {_EXPECTED} AS expected FROM ty JOIN acquisitions USING (acquisition_id))"
_GRID_COLUMNS = [*p.KEYS, *p._PRPD, *(f"mean_{c}" for c in p._TYPE_MEANS), "mean_signal_to_noise_ratio"]
_GRID_TYPE = classify.decision_texts(_GRID_COLUMNS, noise="noise_limit", surface="surface_limit", pair="pair_limit")["pd_type"]

SQL = {
    "neighbour_eps": f"""WITH {p._once(tuple(_OF.values()))}, l AS (SELECT acquisition_id, pulse_key, {", ".join(f"ln({c}) AS {a}" for a, c in _OF.items())} FROM once
  WHERE {" AND ".join(f"{c} > 0 AND isfinite({c})" for c in _OF.values())}),
m AS (SELECT acquisition_id, {", ".join(f"avg({a}) AS m_{a}, stddev_pop({a}) AS s_{a}" for a in AXES)} FROM l GROUP BY acquisition_id),
z AS (SELECT acquisition_id, pulse_key, {", ".join(f"CASE WHEN s_{a} > 0 THEN ({a} - m_{a}) / s_{a} ELSE 0 END AS {a}" for a in AXES)} FROM l JOIN m USING (acquisition_id)),
d AS (SELECT a.acquisition_id, a.pulse_key, list_sort(min({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in AXES)}, 5)) AS near FROM z a JOIN z b USING (acquisition_id) GROUP BY a.acquisition_id, a.pulse_key)
SELECT acquisition_id, {p._dig("quantile_cont(sqrt(near[5]), 0.6)", 6)} AS eps FROM d WHERE len(near) = 5 GROUP BY acquisition_id""",
    "type_recall": _JUDGED
    + """ SELECT expected, CAST(sum(total_pulse_count) AS BIGINT) AS n, CAST(sum(h) AS BIGINT) AS hits, CAST(round(sum(h) / sum(total_pulse_count), 6) AS DOUBLE) AS recall
FROM (SELECT *, CASE WHEN pd_type = expected OR (expected = 'NOISE' AND pd_type = 'NOISE_MULTIPULSE') THEN total_pulse_count ELSE 0 END AS h FROM ju) GROUP BY expected""",
    "feature_anova": f"""WITH {p._once(p.SCALED)}, l AS ({" UNION ALL ".join(f"SELECT acquisition_id, cluster, '{c}' AS feature, ln({c}) AS v FROM once WHERE {c} > 0 AND isfinite({c})" for c in p.SCALED)}),
g AS (SELECT acquisition_id, feature, cluster, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY ALL),
w AS (SELECT acquisition_id, feature, sum(n)::BIGINT AS n, count(*) AS labels, sum(n * m) AS t, sum(n * m * m) AS q, sum(n * s) AS wi FROM g GROUP BY ALL)
SELECT acquisition_id, feature, n, labels, {p._dig("CASE WHEN labels > 1 AND n > labels AND wi > 0 THEN ((q - t * t / n) / (labels - 1)) / (wi / (n - labels)) ELSE 0 END", 5)} AS f_value FROM w""",
    "feature_information": f"""WITH {p._once(p.SCALED)}, l AS ({" UNION ALL ".join(f"SELECT acquisition_id AS g, cluster AS y, '{c}' AS feature, round(ln({c}), 9) AS v FROM once WHERE {c} > 0 AND isfinite({c})" for c in p.SCALED)}),
r AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM l WINDOW w AS (PARTITION BY g, feature)),
b AS (SELECT g, feature, y, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 0 END AS b, count(*) AS n FROM r GROUP BY ALL),
f AS (SELECT *, sum(n) OVER (PARTITION BY g, feature, b) AS nb, sum(n) OVER (PARTITION BY g, feature, y) AS ny, sum(n) OVER (PARTITION BY g, feature) AS nn FROM b)
SELECT g AS acquisition_id, feature, CAST(max(nn) AS BIGINT) AS n, CAST(round(sum(n / nn * log2(n * nn / (nb * ny))), 6) + 0.0 AS DOUBLE) AS information FROM f GROUP BY g, feature""",
    "type_confusion": _JUDGED + " SELECT coalesce(expected, 'all') AS expected, coalesce(pd_type, 'all') AS pd_type, CAST(sum(total_pulse_count) AS BIGINT) AS n FROM ju GROUP BY CUBE (expected, pd_type)",
    "threshold_search": _JUDGED
    + f""", gr AS (SELECT * FROM (VALUES {", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in GRID)}) v(noise_limit, surface_limit, pair_limit)),
de AS (SELECT ju.* EXCLUDE (pd_type), gr.*, {_GRID_TYPE} AS pd_type FROM ju CROSS JOIN gr)
SELECT noise_limit, surface_limit, pair_limit, CAST(sum(total_pulse_count) AS BIGINT) AS n,
  CAST(round(sum(CASE WHEN pd_type = expected OR (expected = 'NOISE' AND pd_type = 'NOISE_MULTIPULSE') THEN total_pulse_count ELSE 0 END) / sum(total_pulse_count), 6) AS DOUBLE) AS accuracy FROM de GROUP BY ALL""",
}
