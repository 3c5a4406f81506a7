"""Operators on detection events: merging, dead time, matching, thresholds, phase bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.quantiles import exact_percentiles
from voltlake.runtime import materialize, row_count_up_to, small_side

#: Width of the index ranges that a long channel is cut into.
CHUNK = 1 << 22


def _same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    on = None
    for x, y in pairs:
        one = a[x].eqNullSafe(b[y])
        on = one if on is None else on & one
    return on


def with_previous(events: DataFrame, channel: str, index: str, order: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Adds ``_prev``: the index of the event before, in the order (index, *order). The
    channel is cut into index ranges; a range's first event looks at the last of the
    ranges before through one row per range, so a long channel does not fill one task."""
    cut = events.withColumn("_chunk", F.floor(F.col(index) / chunk))
    inside = Window.partitionBy(channel, "_chunk").orderBy(index, *order)
    cut = cut.withColumn("_lag", F.lag(index).over(inside))
    ends = cut.groupBy(channel, "_chunk").agg(F.max(index).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(channel).orderBy("_chunk"))).where(F.col("_before").isNotNull())
    ends = small_side(ends.select(F.col(channel).alias("_ch"), F.col("_chunk").alias("_ck"), "_before"))
    joined = cut.join(ends, cut[channel].eqNullSafe(ends["_ch"]) & (cut["_chunk"] == ends["_ck"]), "left")
    return joined.withColumn("_prev", F.coalesce("_lag", "_before")).drop("_lag", "_before", "_ch", "_ck", "_chunk")


def merge_nearby(events: DataFrame, channel: str, index: str, amplitude: str, key: str, min_sep: int) -> DataFrame:
    """The strongest event of each chain whose neighbours lie at most ``min_sep`` apart
    (first of equals), with ``n_merged``. Null amplitudes count as the weakest; null
    indexes form no chain and are left out."""
    from_prev = with_previous(events.where(F.col(index).isNotNull()), channel, index, [key])
    fresh = F.col("_prev").isNull() | (F.col(index) - F.col("_prev") > min_sep)
    starts = from_prev.withColumn("_fresh", fresh)
    # a chain is named by its first index: the last start at or before an event
    cut = starts.withColumn("_chunk", F.floor(F.col(index) / CHUNK))
    inside = Window.partitionBy(channel, "_chunk").orderBy(index, key)
    cut = cut.withColumn("_start", F.last(F.when(F.col("_fresh"), F.col(index)), ignorenulls=True).over(inside))
    ends = cut.groupBy(channel, "_chunk").agg(F.max(F.when(F.col("_fresh"), F.col(index))).alias("_own"))
    carried = F.last("_own", ignorenulls=True).over(Window.partitionBy(channel).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    ends = small_side(ends.select(F.col(channel).alias("_ch"), F.col("_chunk").alias("_ck"), carried.alias("_carry")))
    chained = cut.join(ends, cut[channel].eqNullSafe(ends["_ch"]) & (cut["_chunk"] == ends["_ck"])).withColumn("_start", F.coalesce("_start", "_carry"))
    keep = [c for c in events.columns if c != channel]
    first = F.struct(F.coalesce(-F.col(amplitude), F.lit(float("inf"))).alias("_s"), F.col(index).alias("_i"), F.col(key).alias("_k"), *[F.col(c).alias(f"_v_{c}") for c in keep])
    best = chained.groupBy(channel, "_start").agg(F.min(first).alias("b"), F.count("*").alias("n_merged"))
    return best.select(channel, *[F.col(f"b._v_{c}").alias(c) for c in keep], "n_merged")


def dead_time(events: DataFrame, channel: str, index: str, min_sep: int) -> DataFrame:
    """(channel, index) of the events kept when each must lie at least ``min_sep`` after
    the last kept one. Indexes of a channel count once; null indexes are left out.

    An event that far after its predecessor is always kept, so chains begin anew there.
    Within a chain every event points to the first one far enough behind it; what the
    chain's head reaches is kept. Doubling the pointers takes the logarithm of the
    longest chain in joins instead of a walk along the channel.
    """
    points = events.select(F.col(channel).alias("ch"), F.col(index).cast("long").alias("x")).where(F.col("x").isNotNull()).distinct()
    width = max(CHUNK, 4 * min_sep)
    marked = with_previous(points, "ch", "x", chunk=width)
    marked = marked.withColumn("head", F.col("_prev").isNull() | (F.col("x") - F.col("_prev") >= min_sep)).drop("_prev")
    own = F.floor(F.col("x") / width)
    near_start = F.col("x") - own * width < 2 * min_sep
    copies = F.explode(F.when(near_start, F.array(own, own - 1)).otherwise(F.array(own)))
    spread = marked.select("*", own.alias("_own"), copies.alias("_c"))
    ahead = Window.partitionBy("ch", "_c").orderBy("x").rangeBetween(min_sep, 2 * min_sep)
    pointed = spread.withColumn("to", F.first("x").over(ahead)).where(F.col("_c") == F.col("_own")).select("ch", "x", "head", "to")
    pointed = materialize(pointed, "pointers")
    jumps = [pointed.where(F.col("to").isNotNull()).select("ch", "x", "to")]
    while row_count_up_to(jumps[-1], 0):
        a = jumps[-1]
        b = a.select(F.col("ch").alias("_ch"), F.col("x").alias("_x"), F.col("to").alias("far"))
        twice = a.join(b, a["ch"].eqNullSafe(b["_ch"]) & (a["to"] == b["_x"])).select("ch", "x", F.col("far").alias("to"))
        jumps.append(materialize(twice, "jumps"))
    kept = pointed.where("head").select("ch", "x")
    for jump in reversed(jumps[:-1]):
        j = jump.select(F.col("ch").alias("_ch"), F.col("x").alias("_x"), "to")
        more = kept.join(j, kept["ch"].eqNullSafe(j["_ch"]) & (kept["x"] == j["_x"])).select("ch", F.col("to").alias("x"))
        kept = materialize(kept.unionByName(more).distinct(), "kept")
    return kept.select(F.col("ch").alias(channel), F.col("x").alias(index))


def match_within(left: DataFrame, right: DataFrame, channel: str, index: str, key: str, tolerance: int) -> DataFrame:
    """Each left event with the first right event (lowest index, then key) at most
    ``tolerance`` away: (channel, left_key, right_key, offset); unmatched left events have
    null. An equi join on index buckets as wide as the tolerance replaces the range join."""
    wide = max(tolerance, 1)
    a = left.select(F.col(channel).alias("ch"), F.col(index).alias("li"), F.col(key).alias("left_key"))
    b = right.select(F.col(channel).alias("ch"), F.col(index).alias("ri"), F.col(key).alias("right_key"))
    bucket = F.floor(F.col("li") / wide)
    near = a.where(F.col("li").isNotNull()).withColumn("bk", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    far = b.where(F.col("ri").isNotNull()).withColumn("bk", F.floor(F.col("ri") / wide))
    met = near.join(far, ["ch", "bk"]).where(F.abs(F.col("li") - F.col("ri")) <= tolerance)
    first = met.groupBy("ch", "left_key").agg(F.min(F.struct("ri", "right_key", "li")).alias("m"))
    found = first.select(F.col("ch").alias("_ch"), F.col("left_key").alias("_lk"), F.col("m.right_key").alias("right_key"), (F.col("m.ri") - F.col("m.li")).alias("offset"))
    return a.join(found, a["ch"].eqNullSafe(found["_ch"]) & (a["left_key"] == found["_lk"]), "left").select(
        F.col("ch").alias(channel), "left_key", "right_key", "offset"
    )


def robust_thresholds(samples: DataFrame, channel: str, value: str, k_sigma: float = 5.0) -> DataFrame:
    """(channel, n_values, baseline, mad, threshold): the median, the median absolute
    deviation and ``k_sigma`` robust standard deviations, exact in two counting searches."""
    base = exact_percentiles(samples, [channel], [value], [0.5]).select(F.col(channel), "n_values", F.col("value").alias("baseline"))
    base = materialize(base, "baseline")
    side = small_side(base.withColumnRenamed(channel, "_ch"))
    off = samples.join(side, samples[channel].eqNullSafe(side["_ch"])).select(channel, F.abs(F.col(value) - F.col("baseline")).alias("off"))
    mads = exact_percentiles(materialize(off, "off"), [channel], ["off"], [0.5]).select(F.col(channel).alias("_c"), F.col("value").alias("mad"))
    return base.join(mads, base[channel].eqNullSafe(mads["_c"])).select(
        channel, "n_values", "baseline", "mad", (F.lit(1.4826 * k_sigma) * F.col("mad")).alias("threshold")
    )


def histogram_knee(samples: DataFrame, channel: str, value: str, robust: DataFrame, bins: int = 1000, sensitivity: float = 1.0) -> DataFrame:
    """(channel, knee, threshold): where the cumulative histogram of the distances from
    the baseline is farthest above its chord, weighted towards small distances; at least
    three robust standard deviations. ``robust`` is the result of robust_thresholds."""
    side = small_side(robust.select(F.col(channel).alias("_ch"), "baseline", "mad"))
    off = samples.join(side, samples[channel].eqNullSafe(side["_ch"])).select(channel, F.abs(F.col(value) - F.col("baseline")).alias("off"), "mad")
    off = off.where(F.col("off").isNotNull() & ~F.isnan("off") & (F.col("off") < F.lit(float("inf"))))
    tops = small_side(off.groupBy(channel).agg(F.max("off").alias("top"), F.count("*").alias("total"), F.max("mad").alias("m")).withColumnRenamed(channel, "_ch"))
    placed = off.join(tops, off[channel].eqNullSafe(tops["_ch"])).where(F.col("top") > 0)
    bin_ = F.least(F.floor(F.col("off") / F.col("top") * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(channel, bin_.alias("bin")).agg(F.count("*").alias("n"), F.max("top").alias("top"), F.max("total").alias("total"), F.max("m").alias("mad"))
    cum = F.sum("n").over(Window.partitionBy(channel).orderBy("bin")) / F.col("total")
    x = (F.col("bin") + 0.5) / bins
    score = (cum - x) * (1 - 0.3 * sensitivity * x)
    best = counts.select(channel, "bin", "top", "mad", score.alias("s")).groupBy(channel).agg(
        F.min(F.struct((-F.round("s", 12)).alias("s"), "bin")).alias("b"), F.max("top").alias("top"), F.max("mad").alias("mad")
    )
    knee = (F.col("b.bin") + 0.5) / bins * F.col("top")
    return best.select(channel, knee.alias("knee"), F.greatest(knee, F.lit(3 * 1.4826) * F.col("mad")).alias("threshold"))


def sync_average(samples: DataFrame, channel: str, phase: str, value: str, bins: int = 360) -> DataFrame:
    """(channel, bin, n, mean, std, highest, lowest, rms) of the absolute values by phase
    bin; bins without samples have n = 0 and zeros. Null and NaN phases or values are
    passed over."""
    v, p = F.abs(F.col(value)), F.col(phase)
    ok = v.isNotNull() & ~F.isnan(v) & p.isNotNull() & ~F.isnan(p)
    bin_ = F.least(F.floor(F.pmod(p, F.lit(360.0)) / (360.0 / bins)), F.lit(bins - 1)).cast("int")
    got = samples.where(ok).groupBy(channel, bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("highest"), F.min(v).alias("lowest"), F.sqrt(F.avg(v * v)).alias("rms")
    )
    frame = samples.select(channel).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    g = got.withColumnsRenamed({channel: "_ch", "bin": "_b"})
    joined = frame.join(g, frame[channel].eqNullSafe(g["_ch"]) & (frame["bin"] == g["_b"]), "left")
    return joined.select(channel, "bin", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std", "highest", "lowest", "rms")])


def hotspots(average: DataFrame, channel: str, sigma: float = 3.0, min_bins: int = 3, merge_gap: int = 2, bins: int = 360) -> DataFrame:
    """(channel, lo, hi, n_bins, peak_bin, peak, significance): runs of at least
    ``min_bins`` bins whose mean exceeds median + sigma * std, around the circle; runs
    at most ``merge_gap`` bins apart are one. ``hi`` may exceed the last bin by a turn."""
    stats = average.groupBy(channel).agg(F.median("mean").alias("mid"), F.stddev_pop("mean").alias("sd"))
    s = small_side(stats.withColumnRenamed(channel, "_ch"))
    hot = average.join(s, average[channel].eqNullSafe(s["_ch"])).where(F.col("mean") > F.col("mid") + sigma * F.col("sd"))
    ring = hot.select(channel, "mean", "mid", "sd", F.explode(F.array(F.col("bin"), F.col("bin") + bins)).alias("b"))  # two turns of a circle of fixed size
    order = Window.partitionBy(channel).orderBy("b")
    runs = ring.withColumn("_gap", F.coalesce(F.col("b") - F.lag("b").over(order), F.lit(bins)))
    runs = runs.withColumn("_run", F.sum((F.col("_gap") > 1).cast("int")).over(order)).withColumn("_len", F.count("*").over(Window.partitionBy(channel, "_run")))
    runs = runs.where(F.col("_len") >= min_bins).withColumn("_gap", F.coalesce(F.col("b") - F.lag("b").over(order), F.lit(bins)))
    runs = runs.withColumn("_spot", F.sum((F.col("_gap") > merge_gap + 1).cast("int")).over(order))
    spots = runs.groupBy(channel, "_spot").agg(
        F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n_bins"), F.min(F.struct((-F.col("mean")).alias("m"), "b")).alias("p"),
        F.max(F.when(F.col("sd") > 0, (F.col("mean") - F.col("mid")) / F.when(F.col("sd") > 0, F.col("sd")))).alias("significance"),
    )
    # each spot appears in both turns: keep the one that starts in the first turn and is whole
    first = spots.where((F.col("lo") < bins) & ((F.col("lo") > 0) | (F.col("hi") >= 2 * bins - 1)))
    wrapped = spots.where((F.col("lo") < bins) & (F.col("hi") >= bins)).select(F.col(channel).alias("_c"), (F.col("hi") - bins).alias("_h"))
    at_zero = spots.where(F.col("lo") == 0).join(wrapped, spots[channel].eqNullSafe(wrapped["_c"]) & (spots["hi"] <= wrapped["_h"]), "left_anti")
    both = first.unionByName(at_zero.where(F.col("hi") < 2 * bins - 1))
    return both.select(channel, "lo", "hi", "n_bins", F.pmod(F.col("p.b"), F.lit(bins)).alias("peak_bin"), (-F.col("p.m")).alias("peak"), "significance")


def quadrant_kurtosis(samples: DataFrame, channel: str, phase: str, value: str, threshold: float = 5.0) -> DataFrame:
    """(channel, part, n, kurtosis, verdict) for the four quadrants, both half cycles and
    the whole; the verdict is process, uncertain or skip."""
    p = F.pmod(F.col(phase), F.lit(360.0))
    quarter = F.least(F.floor(p / 90), F.lit(3)).cast("int")
    parts = F.array(
        F.concat(F.lit("Q"), (quarter + 1).cast("string")), F.when(quarter < 2, "positive").otherwise("negative"), F.lit("all")
    )
    rows = samples.where(p.isNotNull() & ~F.isnan(p) & F.col(value).isNotNull() & ~F.isnan(value)).select(channel, F.explode(parts).alias("part"), F.col(value).alias("v"))
    got = rows.groupBy(channel, "part").agg(F.count("*").alias("n"), F.kurtosis("v").alias("k"), F.var_pop("v").alias("m2"))
    k = F.when((F.col("n") < 4) | (F.col("m2") < 1e-20), 0.0).otherwise(F.coalesce("k", F.lit(0.0)))
    verdict = F.when(k >= 2 * threshold, "process").when(k >= threshold, "uncertain").otherwise("skip")
    return got.select(channel, "part", "n", k.alias("kurtosis"), verdict.alias("verdict"))
