"""Feature analytics: principal components, recommended features, importance, calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators import classify


def covariance(rows: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population covariance): one aggregation; the driver gets one row of
    numbers whatever the size of the data."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = rows.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    n, d = one[0], len(columns)
    means = np.array([x or 0.0 for x in one[1 : d + 1]], dtype=float)
    matrix = np.zeros((d, d))
    for (i, j), v in zip(pairs, one[d + 1 :], strict=True):
        matrix[i, j] = matrix[j, i] = v or 0.0
    return n, means, matrix


def correlation(matrix: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(matrix))
    outer = np.outer(sd, sd)
    return np.divide(matrix, outer, out=np.zeros_like(matrix), where=outer > 1e-20)


def components(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(explained share, loadings by component) of the scaled features; each component's
    largest loading is positive."""
    value, vector = np.linalg.eigh(correlation(matrix))
    order = np.argsort(value)[::-1]
    value, vector = np.maximum(value[order], 0), vector[:, order]
    vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))] < 0, -1.0, 1.0)
    return value / value.sum() if value.sum() > 0 else value, vector


def project(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int = 2) -> DataFrame:
    """(keys..., pc1, pc2...): scaled rows on the first principal components; constant
    columns count as 0."""
    _, means, matrix = covariance(rows, columns)
    _, vector = components(matrix)
    sd = np.sqrt(np.diag(matrix))
    z = [F.lit(0.0) if sd[i] <= 1e-12 else (F.col(c) - float(means[i])) / float(sd[i]) for i, c in enumerate(columns)]
    out = [sum((z[i] * float(vector[i, k]) for i in range(len(columns))), F.lit(0.0)).alias(f"pc{k + 1}") for k in range(n)]
    return rows.select(*keys, *out)


def recommended(columns: Sequence[str], matrix: np.ndarray, wanted: int = 5, limit: float = 0.85) -> list[tuple[str, float, bool]]:
    """(feature, importance up to 100, chosen): by summed loadings weighted with the
    explained share; features that correlate above ``limit`` with a chosen one are passed
    over, and fill the list only if too few remain."""
    live = [i for i in range(len(columns)) if matrix[i, i] > 1e-20]
    if not live:
        return [(c, 0.0, False) for c in columns]
    sub = matrix[np.ix_(live, live)]
    share, vector = components(sub)
    weight = (np.abs(vector) * share).sum(axis=1)
    weight = weight / weight.max() * 100
    corr = np.abs(correlation(sub))
    chosen: list[int] = []
    for i in sorted(range(len(live)), key=lambda i: (-weight[i], i)):
        if len(chosen) < wanted and all(corr[i, j] <= limit for j in chosen):
            chosen.append(i)
    for i in sorted(range(len(live)), key=lambda i: (-weight[i], i)):
        if len(chosen) < wanted and i not in chosen:
            chosen.append(i)
    of = {live[i]: (float(weight[i]), i in chosen) for i in range(len(live))}
    return [(c, *of.get(i, (0.0, False))) for i, c in enumerate(columns)]


def loadings(columns: Sequence[str], matrix: np.ndarray, most: int = 10) -> list[tuple[int, str, float, float, float]]:
    """(component from 1, feature, loading, explained share, share of it and all before) of
    the first ``most`` components; constant features are left out."""
    live = [i for i in range(len(columns)) if matrix[i, i] > 1e-20]
    if not live:
        return []
    share, vector = components(matrix[np.ix_(live, live)])
    upto = np.cumsum(share)
    return [(k + 1, columns[i], float(vector[j, k]), float(share[k]), float(upto[k])) for k in range(min(most, len(live))) for j, i in enumerate(live)]


def anova(rows: DataFrame, group: str, label: str, columns: Sequence[str]) -> DataFrame:
    """(group, feature, n, labels, f_value): one-way analysis of variance of each feature
    over the labels within a group; 0 where it is not defined."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns]))
    long = rows.select(group, label, cells.alias("c")).select(group, label, "c.feature", "c.v").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    parts = long.groupBy(group, "feature", label).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    whole = parts.groupBy(group, "feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("labels"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("s")).alias("within")
    )
    between = F.col("q") - F.col("t") * F.col("t") / F.col("n")
    ok = (F.col("labels") > 1) & (F.col("n") > F.col("labels")) & (F.col("within") > 0)
    f = (between / (F.col("labels") - 1)) / (F.when(ok, F.col("within")) / F.when(ok, F.col("n") - F.col("labels")))
    return whole.select(group, "feature", "n", "labels", F.coalesce(F.when(ok, f), F.lit(0.0)).alias("f_value"))


def mutual_information(rows: DataFrame, group: str, label: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(group, feature, n, information): mutual information in bits between a feature in
    ``bins`` equal steps of its range within the group and the label; missing and infinite
    values do not count, constant features have 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns]))
    long = rows.select(F.col(group).alias("g"), F.col(label).alias("y"), cells.alias("c")).select("g", "y", "c.feature", "c.v")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    span = long.groupBy("g", "feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumnsRenamed({"g": "_g", "feature": "_f"})
    joined = long.join(span, long["g"].eqNullSafe(span["_g"]) & (long["feature"] == span["_f"]))
    step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins))
    counts = joined.groupBy("g", "feature", "y", F.least(F.coalesce(step, F.lit(0)), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"))
    by = lambda *k: Window.partitionBy("g", "feature", *k)
    full = counts.withColumn("nb", F.sum("n").over(by("b"))).withColumn("ny", F.sum("n").over(by("y"))).withColumn("nn", F.sum("n").over(by()))
    part = F.col("n") / F.col("nn") * F.log2(F.col("n") * F.col("nn") / (F.col("nb") * F.col("ny")))
    return full.groupBy("g", "feature").agg(F.max("nn").alias("n"), F.sum(part).alias("information")).withColumnRenamed("g", group)


def grid_search(groups: DataFrame, expected: str, weight: str, grid: DataFrame) -> DataFrame:
    """(grid columns, n, accuracy): every threshold combination judged over all groups;
    NOISE accepts NOISE_MULTIPULSE. ``groups`` has the score columns; ``grid`` the limits
    noise_limit, surface_limit and pair_limit, a bounded table of combinations."""
    columns = groups.columns
    texts = classify.decision_texts(columns, noise="noise_limit", surface="surface_limit", pair="pair_limit")
    judged = groups.crossJoin(F.broadcast(grid)).select("*", F.expr(texts["pd_type"]).alias("_type"))  # the grid is a parameter, not data
    right = (F.col("_type") == F.col(expected)) | ((F.col(expected) == "NOISE") & (F.col("_type") == "NOISE_MULTIPULSE"))
    hits = F.sum(F.when(right, F.col(weight)).otherwise(0))
    return judged.groupBy(*grid.columns).agg(F.sum(weight).alias("n"), (hits / F.sum(weight)).alias("accuracy"))
