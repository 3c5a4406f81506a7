"""Exact bisection: order statistics of grouped columns by counting below midpoints.

A first pass counts values per group in buckets of fixed relative width. These counts
add up over partitions, days and groups. Further passes narrow the bucket that holds a
wanted rank: rows are counted below many midpoints at once, until the rank is resolved
or the interval is small enough to number its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.quantiles import finite, long_measures
from voltlake.runtime import materialize, row_count_up_to, small_side

#: Buckets per unit of natural logarithm in the first pass: a bucket's ends differ by a
#: factor of exp(1/RESOLUTION).
RESOLUTION = 32
#: Midpoints counted at once in each later pass, and rows below which an interval is numbered.
SPLITS = 256
LEAF_ROWS = 4096

#: Largest relative distance of a value from the geometric middle of its first-pass bucket.
RELATIVE_ERROR = math.exp(0.5 / RESOLUTION) - 1


def value_bucket(v: Column, resolution: int = RESOLUTION) -> Column:
    """A bucket number that never falls when ``v`` rises; zero has its own bucket."""
    shift = 746 * resolution
    magnitude = F.floor(F.ln(F.abs(v)) * resolution) + shift
    return F.when(v > 0, magnitude).when(v < 0, -magnitude).otherwise(F.lit(0)).cast("int")


def bucket_counts(rows: DataFrame, keys: Sequence[str], resolution: int = RESOLUTION) -> DataFrame:
    """The mergeable summary: rows, smallest and largest value per group, measure and bucket."""
    return (
        rows.withColumn("bucket", value_bucket(F.col("v"), resolution))
        .groupBy(*keys, "measure", "bucket")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )


def merge_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of fewer keys (or of several days) from finer ones, without the rows."""
    return counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def approx_percentiles(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles from summaries alone: per group, measure and probability the bucket that
    holds the rank and its ends; the true order statistic lies between ``lo`` and ``hi``."""
    placed = _place_ranks(counts, [*keys, "measure"], "bucket", _lower_ranks(probs))
    return placed.select(*keys, "measure", F.explode("_hits").alias("_k"), "lo", "hi", F.col("_total").alias("n_values")).distinct()


def _lower_ranks(probs: Sequence[float]):
    return lambda total: F.array_distinct(F.array(*[F.floor(F.lit(p) * (total - 1)) for p in probs]))


def _both_ranks(probs: Sequence[float]):
    def ranks(total: Column) -> Column:
        return F.array_distinct(F.array(*[f(F.lit(p) * (total - 1)) for p in probs for f in (F.floor, F.ceil)]))

    return ranks


def _place_ranks(counts: DataFrame, group: list[str], order: str, ranks) -> DataFrame:
    """Each bucket with the wanted ranks (from 0) that fall into it as ``_hits``."""
    upto = Window.partitionBy(*group).orderBy(order)
    all_ = Window.partitionBy(*group)
    counted = counts.withColumn("_cum", F.sum("n").over(upto)).withColumn("_total", F.sum("n").over(all_))
    before = F.col("_cum") - F.col("n")
    hits = F.filter(ranks(F.col("_total")), lambda k: (k >= F.col("_cum") - F.col("n")) & (k < F.col("_cum")))
    return counted.withColumn("_before", before).withColumn("_hits", hits).where(F.size("_hits") > 0)


def order_statistics(
    df: DataFrame,
    groupings: Sequence[Sequence[str]],
    measures: Sequence[str],
    ranks,
    resolution: int = RESOLUTION,
    splits: int = SPLITS,
    leaf_rows: int = LEAF_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(statistics, totals): per grouping, group and measure the values ``x`` of the ranks
    ``k`` (from 0) that ``ranks`` makes of the number of values, and that number."""
    keys = list(dict.fromkeys(k for g in groupings for k in g))
    rows = long_measures(df, keys, measures).withColumn("bucket", value_bucket(F.col("v"), resolution))
    finest = (
        rows.groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    finest = materialize(finest, "counts")
    types = dict(rows.dtypes)

    def blank(frame: DataFrame, number: int, grouping: Sequence[str]) -> DataFrame:
        for k in keys:
            if k not in grouping:
                frame = frame.withColumn(k, F.lit(None).cast(types[k]))
        return frame.withColumn("grouping", F.lit(number))

    levels = [blank(finest if set(g) == set(keys) else merge_counts(finest, g), i, g) for i, g in enumerate(groupings)]
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    group = ["grouping", *keys, "measure"]
    placed = materialize(_place_ranks(counts, group, "bucket", ranks), "ranks")
    totals = placed.groupBy(*group).agg(F.max("_total").alias("n_values"))
    point = F.col("lo") == F.col("hi")
    stats = placed.where(point).select(*group, F.explode("_hits").alias("k"), F.col("lo").alias("x"))
    intervals = placed.where(~point).select(
        *group, "bucket", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n", "_before", "_hits"
    ).withColumn("interval", F.xxhash64(*group, "bucket"))
    open_rows = None
    if row_count_up_to(intervals, 0):
        side = small_side(intervals.drop("n"))
        parts = []
        for i, g in enumerate(groupings):
            mine = side.where(F.col("grouping") == i)
            on = (rows["measure"] == mine["measure"]) & (rows["bucket"] == mine["bucket"])
            for k in g:
                on = on & rows[k].eqNullSafe(mine[k])
            parts.append(rows.join(mine, on).select("interval", "v"))
        open_rows = parts[0]
        for part in parts[1:]:
            open_rows = open_rows.unionByName(part)
        open_rows = materialize(open_rows, "open")
    while open_rows is not None and row_count_up_to(intervals, 0):
        leaves = intervals.where(F.col("n") <= leaf_rows)
        numbered = (
            open_rows.join(small_side(leaves.select("interval", *group, "_before", "_hits")), "interval")
            .withColumn("k", F.row_number().over(Window.partitionBy("interval").orderBy("v")) - 1 + F.col("_before"))
            .where(F.array_contains("_hits", F.col("k").cast("long")))
            .select(*group, F.col("k").cast("long").alias("k"), F.col("v").alias("x"))
        )
        stats = stats.unionByName(numbered)
        wide = intervals.where(F.col("n") > leaf_rows)
        if not row_count_up_to(wide, 0):
            break
        step = F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * splits)
        inside = open_rows.join(small_side(wide.drop("n", "bucket")), "interval").withColumn(
            "bucket", F.least(step, F.lit(splits - 1)).cast("int")
        )
        finer = inside.groupBy("interval", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        about = wide.select("interval", *group, "_hits", F.col("_before").alias("_start"))
        cum = F.sum("n").over(Window.partitionBy("interval").orderBy("bucket"))
        found = (
            finer.withColumn("_before", cum - F.col("n"))
            .join(small_side(about), "interval")
            .withColumn("_before", F.col("_before") + F.col("_start"))
            .withColumn("_hits", F.filter("_hits", lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("n"))))
            .where(F.size("_hits") > 0)
            .withColumn("inner", F.xxhash64("interval", "bucket"))
        )
        found = materialize(found, "ranks")
        stats = stats.unionByName(found.where(point).select(*group, F.explode("_hits").alias("k"), F.col("lo").alias("x")))
        again = found.where(~point)
        open_rows = materialize(
            inside.join(small_side(again.select("interval", "bucket", "inner")), ["interval", "bucket"]).select(
                F.col("inner").alias("interval"), "v"
            ),
            "open",
        )
        intervals = again.select(
            *group, "bucket", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n", "_before", "_hits", F.col("inner").alias("interval")
        )
    return stats, totals


def exact_percentiles(
    df: DataFrame,
    groupings: Sequence[Sequence[str]],
    measures: Sequence[str],
    probs: Sequence[float],
    resolution: int = RESOLUTION,
    splits: int = SPLITS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Exact percentiles (linear between neighbouring order statistics) for every grouping.

    Returns one row per grouping, group, measure and probability: ``grouping`` (its
    position), all key columns (null where not in the grouping), ``measure``, ``prob``,
    ``n_values``, ``value``. Null, NaN and infinite values do not count; groups without
    a finite value do not appear. A null key is a group of its own. No group is ever
    sorted or gathered whole: ``leaf_rows`` bounds what one window sees.
    """
    group = ["grouping", *dict.fromkeys(k for g in groupings for k in g), "measure"]
    stats, totals = order_statistics(df, groupings, measures, _both_ranks(probs), resolution, splits, leaf_rows)
    wanted = totals.select(*group, "n_values", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).withColumn(
        "_r", F.col("prob") * (F.col("n_values") - 1)
    )
    both = wanted.withColumn("k", F.explode(F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))))
    same = [both[c].eqNullSafe(stats[c]) for c in [*group, "k"]]
    on = same[0]
    for one in same[1:]:
        on = on & one
    ends = both.join(stats, on).select(*[both[c] for c in [*group, "n_values", "prob", "_r"]], "x")
    x0, x1 = F.min("x"), F.max("x")
    frac = F.first("_r") - F.floor(F.first("_r"))
    return ends.groupBy(*group, "n_values", "prob").agg((x0 + (x1 - x0) * frac).alias("value"))
