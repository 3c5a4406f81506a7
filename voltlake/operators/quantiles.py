"""Order statistics of grouped numeric columns, narrowed by Spark's quantile sketches.

A sketch of each group brackets the wanted ranks; rows below a bracket are counted and
rows within it kept; brackets are narrowed by sketches of their own rows until they are
small enough to number. No group is sorted or gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import materialize, row_count_up_to, small_side

#: Steps between the cut points of a sketch, its accuracy, and rows that are numbered at once.
STEPS, ACCURACY, LEAF_ROWS = 128, 1000, 4096


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def long_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys..., measure, v) with the finite values of each measure."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures]))
    return df.select(*keys, cells.alias("_cell")).select(*keys, "_cell.measure", "_cell.v").where(finite(F.col("v")))


def _sketch(rows: DataFrame, by: Sequence[str], steps: int) -> DataFrame:
    grid = F.percentile_approx("v", [i / steps for i in range(steps + 1)], ACCURACY)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), grid.alias("grid"))


def order_statistics(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], ranks: Callable[[Column], Column], leaf_rows: int = LEAF_ROWS, steps: int = STEPS
) -> tuple[DataFrame, DataFrame]:
    """(statistics, totals): per group and measure the values ``x`` of the ranks ``k`` (from
    0) that ``ranks`` makes of the number of values, and that number ``n_values``.

    A group's sketch is off by less than one of its steps, so a rank lies between the cut
    points one before and two behind it. Equal values within such a bracket are added up
    at once; a bracket of more than ``leaf_rows`` different values is cut again.
    """
    group = [*keys, "measure"]
    rows = long_measures(df, keys, measures)
    first = materialize(_sketch(rows, group, steps), "sketch")
    totals = first.select(*group, F.col("n").alias("n_values"))
    wanted = first.withColumn("k", F.explode(ranks(F.col("n")))).withColumn("k", F.col("k").cast("long"))
    i = F.floor(F.col("k") * steps / F.col("n")).cast("int")
    narrow = F.col("n") > leaf_rows
    lo = F.when(narrow & (i >= 1), F.get("grid", i - 1)).otherwise(F.col("lo"))
    hi = F.when(narrow & (i + 2 <= steps), F.get("grid", i + 2)).otherwise(F.col("hi"))
    brackets = wanted.select(*group, "k", lo.alias("_lo"), hi.alias("_hi")).groupBy(*group, "_lo", "_hi").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    name = F.xxhash64(F.to_json(F.struct(*group, "_lo", "_hi"))).alias("id")
    brackets = materialize(brackets.select(*group, name, "ks", F.col("_lo").alias("lo"), F.col("_hi").alias("hi")), "brackets")
    point = F.col("lo") == F.col("hi")

    def settled(frame: DataFrame) -> DataFrame:
        return frame.select(*group, F.explode("ks").alias("k"), F.col("lo").alias("x"))

    stats = settled(brackets.where(point))
    open_ = brackets.where(~point)
    if not row_count_up_to(open_, 0):
        return stats, totals
    side = small_side(open_.select("id", "lo", "hi", *[F.col(c).alias(f"_{c}") for c in group]))
    on = rows["measure"] == side["_measure"]
    for k in keys:
        on = on & rows[k].eqNullSafe(side[f"_{k}"])
    met = rows.join(side, on).where(F.col("v") <= F.col("hi"))
    kept = materialize(met.where(F.col("v") >= F.col("lo")).groupBy("id", "v").agg(F.count("*").alias("c")), "inside")
    under = met.where(F.col("v") < F.col("lo")).groupBy("id").agg(F.count("*").alias("under"))
    open_ = materialize(open_.join(under, "id", "left").select("id", *group, "ks", F.coalesce("under", F.lit(0)).alias("below")), "open")
    while True:
        sized = materialize(open_.join(kept.groupBy("id").agg(F.count("*").alias("n")), "id"), "sized")
        leaves = small_side(sized.where(F.col("n") <= leaf_rows).select("id", *group, "below", "ks"))
        upto = F.sum("c").over(Window.partitionBy("id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        hits = F.filter("ks", lambda k: (k >= F.col("_upto") - F.col("c")) & (k < F.col("_upto")))
        stats = stats.unionByName(kept.join(leaves, "id").withColumn("_upto", upto).select(*group, F.explode(hits).alias("k"), F.col("v").alias("x")))
        wide = sized.where(F.col("n") > leaf_rows).drop("n")
        if not row_count_up_to(wide, 0):
            return stats, totals
        many = kept.join(small_side(wide.select("id")), "id", "left_semi")
        cuts = small_side(materialize(_sketch(many, ["id"], steps).select("id", "grid"), "cuts"))
        placed = many.join(cuts, "id").select("id", "v", "c", F.size(F.filter("grid", lambda g: g < F.col("v"))).alias("b"))
        sums = placed.groupBy("id", "b").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        sums = sums.withColumn("_upto", F.sum("c").over(Window.partitionBy("id").orderBy("b")))
        about = sums.join(wide.withColumnRenamed("below", "_start"), "id").withColumn("_upto", F.col("_upto") + F.col("_start"))
        about = about.withColumn("ks", hits).where(F.size("ks") > 0).withColumn("below", F.col("_upto") - F.col("c")).withColumn("inner", F.xxhash64("id", "b"))
        about = materialize(about.select("id", "b", "inner", *group, "ks", "below", "lo", "hi"), "brackets")
        stats = stats.unionByName(settled(about.where(point)))
        again = about.where(~point)
        kept = materialize(placed.join(small_side(again.select("id", "b", "inner")), ["id", "b"]).select(F.col("inner").alias("id"), "v", "c"), "inside")
        open_ = again.select(F.col("inner").alias("id"), *group, "ks", "below")


def exact_percentiles(df: DataFrame, keys: Sequence[str], measures: Sequence[str], probs: Sequence[float], leaf_rows: int = LEAF_ROWS, steps: int = STEPS) -> DataFrame:
    """(keys..., measure, prob, n_values, value): exact percentiles, linear between
    neighbouring order statistics. Null, NaN and infinite values do not count; groups
    without a finite value do not appear. A null key is a group of its own."""
    group = [*keys, "measure"]

    def ranks(n: Column) -> Column:
        return F.array_distinct(F.array(*[f(F.lit(float(p)) * (n - 1)) for p in probs for f in (F.floor, F.ceil)]))

    stats, totals = order_statistics(df, keys, measures, ranks, leaf_rows, steps)
    wanted = totals.select(*group, "n_values", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).withColumn(
        "_r", F.col("prob") * (F.col("n_values") - 1)
    )
    both = wanted.withColumn("k", F.explode(F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))))
    on = both["k"] == stats["k"]
    for c in group:
        on = on & both[c].eqNullSafe(stats[c])
    ends = both.join(stats, on).select(*[both[c] for c in [*group, "n_values", "prob", "_r"]], "x")
    x0, x1 = F.min("x"), F.max("x")
    frac = F.first("_r") - F.floor(F.first("_r"))
    return ends.groupBy(*group, "prob", "n_values").agg((x0 + (x1 - x0) * frac).alias("value"))
