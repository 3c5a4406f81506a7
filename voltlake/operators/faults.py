"""Implausible readings per source: impossible values, stuck values and spikes.

Spikes are peaks over a threshold: per source, readings are divided by the source's level
in the season (hour of the day); the tail of these residuals above their 90th percentile
is fitted by a generalised Pareto distribution, which gives a cutoff at a fixed risk.
Readings above the cutoff are candidates, which an exact rule then confirms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.quantiles import exact_percentiles
from voltlake.runtime import materialize, small_side

STUCK_READINGS = 8
SPIKE_FACTOR = 4.0
TAIL_PROB = 0.9
#: Accepted chance that a sound reading lies above the cutoff.
RISK = 1e-2
#: Readings of a season that count as much as the level of all seasons.
LEVEL_ROWS = 50
#: Rows that one window of the stuck rule sees at about most.
CHUNK_ROWS = 50_000
#: Chunks of the longest series.
MOST_CHUNKS = 1024


@dataclass(frozen=True)
class Field:
    """A measured column with its physical limit; ``above`` names a column that the
    reading must exceed, ``limit`` one that it must not."""

    name: str
    limit: str | None = None
    above: str | None = None


def reading(name: str) -> Column:
    """Null and NaN readings are passed over."""
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


def impossible(field: Field) -> Column:
    v = reading(field.name)
    wrong = (v < 0) | (v == F.lit(float("inf")))
    if field.limit:
        wrong = wrong | F.coalesce(v > F.col(field.limit), F.lit(False))
    if field.above:
        wrong = wrong | F.coalesce(v <= F.col(field.above), F.lit(False))
    return F.coalesce(wrong, F.lit(False))


def with_chunks(df: DataFrame, series: str, order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``_chunk``: ranges of ``order`` within a series that hold about as many rows
    each, so that a long series or a burst is spread over tasks. Rows of equal order
    share a chunk; series of at most ``chunk_rows`` rows are one."""
    long = df.groupBy(series).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk_rows)
    most = long.agg(F.max("_n")).first()[0]
    if most is None:
        return df.withColumn("_chunk", F.lit(0).cast("long"))
    many = min(MOST_CHUNKS, -(-most // chunk_rows))
    at = [i / many for i in range(1, many)]
    hot = small_side(long.select(F.col(series).alias("_ls")))
    cuts = df.join(hot, df[series].eqNullSafe(hot["_ls"])).groupBy("_ls").agg(F.array_distinct(F.percentile_approx(order, at, 20 * many)).alias("_cuts"))
    cuts = small_side(materialize(cuts, "cuts"))
    joined = df.join(cuts, df[series].eqNullSafe(cuts["_ls"]), "left").drop("_ls")
    before = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return joined.withColumn("_chunk", F.when(F.col("_cuts").isNotNull(), before).otherwise(0).cast("long")).drop("_cuts")


def stuck_flags(df: DataFrame, series: str, order: list[str], fields: list[str], least: int = STUCK_READINGS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``_stuck_<field>``: the reading is one of ``least`` or more in a row that are
    exactly equal within the series. Null readings neither count nor break a row.

    Runs are found within chunks; runs that touch a chunk's edge are joined with their
    continuation through one summary row per chunk edge.
    """
    out = with_chunks(df, series, order[0], chunk_rows)
    in_chunk = Window.partitionBy(series, "_chunk").orderBy(*order)
    for f in fields:
        v = reading(f)
        before = F.last(F.when(v.isNotNull(), v), ignorenulls=True).over(in_chunk.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(f"_new_{f}", (v.isNotNull() & (before.isNull() | (before != v))).cast("long"))
    for f in fields:
        out = out.withColumn(f"_run_{f}", F.sum(f"_new_{f}").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0))).drop(f"_new_{f}")
    for f in fields:
        run = Window.partitionBy(series, "_chunk", f"_run_{f}")
        out = out.withColumn(f"_len_{f}", F.count(reading(f)).over(run))
    out = materialize(out, "runs")
    for f in fields:
        out = _join_edges(out, series, f)
        long_run = F.coalesce(F.col("_whole"), F.col(f"_len_{f}")) >= least
        out = out.withColumn(f"_stuck_{f}", reading(f).isNotNull() & long_run).drop("_whole", f"_run_{f}", f"_len_{f}")
    return out.drop("_chunk")


def _join_edges(runs: DataFrame, series: str, field: str) -> DataFrame:
    """Adds ``_whole``: the full length of runs that go on over a chunk's edge."""
    run, length = f"_run_{field}", f"_len_{field}"
    v = reading(field)
    valid = runs.where(v.isNotNull()).select(series, "_chunk", F.col(run).alias("_r"), F.col(length).alias("_l"), v.alias("_v"))
    edges = valid.groupBy(series, "_chunk").agg(
        F.min(F.struct("_r", "_l", "_v")).alias("_first"), F.max(F.struct("_r", "_l", "_v")).alias("_last")
    )
    split_series = edges.groupBy(series).agg(F.count("*").alias("_c")).where(F.col("_c") > 1).select(series)
    edges = edges.join(small_side(split_series), edges[series].eqNullSafe(split_series[series])).drop(split_series[series])
    both = F.when(F.col("_first._r") == F.col("_last._r"), F.array("_first")).otherwise(F.array("_first", "_last"))
    ends = edges.select(series, "_chunk", F.posexplode(both).alias("_pos", "_e")).select(series, "_chunk", "_pos", "_e.*")
    order = Window.partitionBy(series).orderBy("_chunk", "_pos")
    starts = (F.col("_pos") == 1) | F.lag("_v").over(order).isNull() | (F.lag("_v").over(order) != F.col("_v"))
    islands = ends.withColumn("_new", starts.cast("long")).withColumn("_island", F.sum("_new").over(order))
    whole = islands.withColumn("_whole", F.sum("_l").over(Window.partitionBy(series, "_island")))
    grown = whole.where(F.col("_whole") > F.col("_l")).select(
        F.col(series).alias("_s"), F.col("_chunk").alias("_c"), F.col("_r").alias("_rr"), "_whole"
    )
    on = runs[series].eqNullSafe(grown["_s"]) & (runs["_chunk"] == grown["_c"]) & (runs[run] == grown["_rr"])
    return runs.join(small_side(grown), on, "left").drop("_s", "_c", "_rr")


def possible_readings(df: DataFrame, source: str, season: Column, fields: list[Field]) -> DataFrame:
    """(source, _season, field_name, v): the readings that are not impossible."""
    possible = [F.struct(F.lit(f.name).alias("field_name"), F.when(~impossible(f), reading(f.name)).alias("v")) for f in fields]
    return df.select(source, season.alias("_season"), F.explode(F.array(*possible)).alias("c")).select(source, "_season", "c.*").where(F.col("v").isNotNull())


def tail_percentiles(long: DataFrame, source: str, tail_prob: float = TAIL_PROB) -> DataFrame:
    """(_src, _f, p_tail, n_values) of each source and field."""
    got = exact_percentiles(long, [source, "field_name"], ["v"], [tail_prob])
    return materialize(got.select(F.col(source).alias("_src"), F.col("field_name").alias("_f"), F.col("value").alias("p_tail"), "n_values"), "tails")


def tail_cutoffs(long: DataFrame, tails: DataFrame, source: str, risk: float = RISK, tail_prob: float = TAIL_PROB) -> DataFrame:
    """One row per source, field and season of ``long`` (:func:`possible_readings`):
    ``p_tail`` (percentile of the readings), ``u`` (of the seasonal residuals), the fitted
    tail's ``shape`` and ``scale``, the season's ``level`` and the ``cutoff`` of a reading
    at ``risk``.

    Levels are geometric means of the readings cut at ``p_tail``, drawn to the source's
    own mean where a season has few, so that spikes and small seasons hardly move them;
    sources without a positive reading have level 1. The Pareto tail is fitted through
    the middle and the upper quarter of the excesses: faulty readings, as long as they
    are less than a quarter of the tail, do not move it. Tails without different
    excesses have shape and scale 0 and the cutoff at ``u``.
    """

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a[source].eqNullSafe(b["_src"]) & (a["field_name"] == b["_f"])

    side = small_side(tails)
    base = long.join(side, same(long, side)).drop("_src", "_f", "n_values")
    log = F.when(F.col("v") > 0, F.ln(F.least("v", "p_tail")))
    sums = materialize(base.groupBy(source, "field_name", "_season").agg(F.sum(log).alias("s"), F.count(log).alias("c")), "seasons")
    own = Window.partitionBy(source, "field_name")
    mean = F.try_divide(F.sum("s").over(own), F.sum("c").over(own))
    level = F.exp((F.coalesce("s", F.lit(0.0)) + LEVEL_ROWS * mean) / (F.col("c") + LEVEL_ROWS))
    levels = materialize(sums.select(source, "field_name", "_season", F.coalesce(level, F.lit(1.0)).alias("level")), "levels")
    right = small_side(levels.withColumnsRenamed({source: "_src", "field_name": "_f", "_season": "_sea"}))
    met = long.join(right, same(long, right) & long["_season"].eqNullSafe(right["_sea"]))
    residuals = materialize(met.select(source, "field_name", (F.col("v") / F.col("level")).alias("residual")), "residuals")
    middle, upper = (1 - (1 - tail_prob) * part for part in (0.5, 0.25))
    cuts = exact_percentiles(residuals, [source, "field_name"], ["residual"], [tail_prob, middle, upper])
    at = lambda p: F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("value")))
    cuts = cuts.groupBy(source, "field_name").agg(at(tail_prob).alias("u"), at(middle).alias("_m"), at(upper).alias("_q"), F.max("n_values").alias("n_values"))
    half, quarter = F.col("_m") - F.col("u"), F.col("_q") - F.col("u")
    ok = half > 0
    shape = F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.log2(F.greatest((quarter - half) / F.when(ok, half), F.lit(1e-9))))))
    shape = F.when(F.abs(shape) < 1e-9, 1e-9).otherwise(shape)
    scale = shape * half / (F.pow(F.lit(2.0), shape) - 1)
    growth = (F.pow(F.lit(max(1.0, (1 - tail_prob) / risk)), F.col("shape")) - 1) / F.col("shape")
    fitted = cuts.withColumn("shape", shape).withColumn("scale", scale).withColumn("_cut", F.col("u") + F.coalesce(F.col("scale") * growth, F.lit(0.0)))
    fitted = fitted.withColumns({"shape": F.coalesce("shape", F.lit(0.0)), "scale": F.coalesce("scale", F.lit(0.0))}).drop("_m", "_q")
    fitted = fitted.join(side, same(fitted, side)).select(source, "field_name", "p_tail", "u", "shape", "scale", side["n_values"], "_cut")
    right = small_side(fitted.withColumnsRenamed({source: "_src", "field_name": "_f"}))
    joined = levels.join(right, same(levels, right)).drop("_src", "_f")
    return joined.withColumn("cutoff", F.col("level") * F.col("_cut")).drop("_cut")


def flag_faults(
    df: DataFrame,
    source: str,
    series: str,
    order: list[str],
    season: Column | None,
    fields: list[Field],
    factor: float = SPIKE_FACTOR,
    risk: float = RISK,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``fault_<field>`` (impossible, stuck, spike or null), the first that applies,
    and ``proposed_<field>``: the reading lies above its season's fitted cutoff.

    Spikes are the proposed readings that also lie above ``factor`` times the source's
    90th percentile. Without a ``season`` nothing is fitted and that line alone decides.
    Null and NaN readings have no fault. A null source or series is one of its own.
    """
    names = [f.name for f in fields]
    flagged = stuck_flags(df, series, order, names, chunk_rows=chunk_rows).withColumn("_season", season if season is not None else F.lit(0))
    long = possible_readings(df, source, season if season is not None else F.lit(0), fields)
    tails = tail_percentiles(long, source)
    cuts = materialize(tail_cutoffs(long, tails, source, risk), "cutoffs") if season is not None else None
    for f in fields:
        v = reading(f.name)
        if cuts is None:
            mine = small_side(tails.where(F.col("_f") == f.name).select("_src", F.col("p_tail").alias("_p"), F.lit(0.0).alias("_cut")))
            on = flagged[source].eqNullSafe(mine["_src"])
        else:
            mine = small_side(cuts.where(F.col("field_name") == f.name).select(F.col(source).alias("_src"), F.col("_season").alias("_sea"), F.col("p_tail").alias("_p"), F.col("cutoff").alias("_cut")))
            on = flagged[source].eqNullSafe(mine["_src"]) & flagged["_season"].eqNullSafe(mine["_sea"])
        proposed = F.coalesce(v > F.col("_cut"), F.lit(False))
        spike = proposed & (v > factor * F.col("_p"))
        fault = F.when(impossible(f), "impossible").when(F.col(f"_stuck_{f.name}"), "stuck").when(spike, "spike")
        flagged = flagged.join(mine, on, "left").withColumns({f"fault_{f.name}": fault, f"proposed_{f.name}": proposed}).drop("_src", "_sea", "_p", "_cut", f"_stuck_{f.name}")
    return flagged.drop("_season")
