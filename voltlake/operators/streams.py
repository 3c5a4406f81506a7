"""Continuous sample streams in long form (channel, i, x): crossings, windows, wavelet
detection and phase recovery."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions import kernels
from voltlake.operators.events import CHUNK, dead_time
from voltlake.operators.quantiles import exact_percentiles
from voltlake.runtime import materialize, small_side


def with_neighbour(samples: DataFrame, channel: str, index: str, value: str) -> DataFrame:
    """Adds ``_before``: the value of the sample before (index - 1), through an equi join
    of ranges at their edges only: the rest is a window over a range of the channel."""
    cut = samples.withColumn("_chunk", F.floor(F.col(index) / CHUNK))
    inside = Window.partitionBy(channel, "_chunk").orderBy(index)
    cut = cut.withColumn("_lag", F.lag(value).over(inside)).withColumn("_at", F.lag(index).over(inside))
    last = cut.groupBy(channel, "_chunk").agg(F.max_by(value, index).alias("_end"), F.max(index).alias("_end_at"))
    edge = small_side(last.select(F.col(channel).alias("_ch"), (F.col("_chunk") + 1).alias("_ck"), "_end", "_end_at"))
    joined = cut.join(edge, cut[channel].eqNullSafe(edge["_ch"]) & (cut["_chunk"] == edge["_ck"]), "left")
    near = F.when(F.col("_at") == F.col(index) - 1, F.col("_lag")).when(F.col("_at").isNull() & (F.col("_end_at") == F.col(index) - 1), F.col("_end"))
    return joined.withColumn("_before", near).drop("_lag", "_at", "_end", "_end_at", "_ch", "_ck", "_chunk")


def crossings(samples: DataFrame, channel: str, index: str, value: str, levels: DataFrame) -> DataFrame:
    """(channel, index, polarity) where the value less the channel's ``baseline`` rises
    above ``threshold`` or falls below its negative. ``levels``: channel, baseline, threshold."""
    side = small_side(levels.select(F.col(channel).alias("_lc"), "baseline", "threshold"))
    prev = with_neighbour(samples, channel, index, value)
    rows = prev.join(side, prev[channel].eqNullSafe(side["_lc"])).drop("_lc")
    now, was = F.col(value) - F.col("baseline"), F.col("_before") - F.col("baseline")
    up = (now > F.col("threshold")) & (was <= F.col("threshold"))
    down = (now < -F.col("threshold")) & (was >= -F.col("threshold"))
    return rows.where(up | down).select(channel, index, F.when(up, 1).otherwise(-1).alias("polarity"))


def extract_windows(samples: DataFrame, triggers: DataFrame, channel: str, index: str, value: str, pre: int, post: int) -> DataFrame:
    """(channel, trigger, waveform, signed_peak): ``pre`` samples before to ``post`` after
    each trigger whose whole window exists and does not overlap the one kept before
    (windows that touch are kept). Samples meet windows by an equi join on ranges as wide
    as a window, not by comparing all of both."""
    width = pre + post
    last = small_side(samples.groupBy(channel).agg(F.max(index).alias("_top"), F.min(index).alias("_low")).withColumnRenamed(channel, "_lc"))
    ends = triggers.join(last, triggers[channel].eqNullSafe(last["_lc"]))
    inside = ends.where((F.col(index) - pre >= F.col("_low")) & (F.col(index) + post <= F.col("_top") + 1)).select(channel, index)
    kept = dead_time(inside, channel, index, width)
    spans = kept.select(F.col(channel).alias("_c"), F.col(index).alias("trigger"), (F.col(index) - pre).alias("_s"))
    spans = spans.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col("_s") / width), F.floor((F.col("_s") + width - 1) / width)))))
    cells = samples.select(F.col(channel).alias("_c"), F.col(index).alias("_i"), F.col(value).alias("_x"), F.floor(F.col(index) / width).alias("_b"))
    met = cells.join(spans, ["_c", "_b"]).where((F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_s") + width))
    w = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"])  # one window's samples
    grouped = met.groupBy("_c", "trigger").agg(w.alias("waveform"), F.min(F.struct((-F.abs("_x")).alias("a"), "_i", "_x")).alias("_p"))
    return grouped.where(F.size("waveform") == width).select(F.col("_c").alias(channel), "trigger", "waveform", F.col("_p._x").alias("signed_peak"))


def cycle_kurtosis(samples: DataFrame, channel: str, index: str, value: str, per_cycle: int) -> DataFrame:
    """(channel, cycle, n, kurtosis) of every full cycle of ``per_cycle`` samples."""
    got = samples.groupBy(channel, F.floor(F.col(index) / per_cycle).alias("cycle")).agg(
        F.count(value).alias("n"), F.kurtosis(value).alias("k"), F.var_pop(value).alias("m2")
    )
    k = F.when((F.col("n") < 4) | (F.col("m2") < 1e-20), 0.0).otherwise(F.coalesce("k", F.lit(0.0)))
    return got.where(F.col("n") == per_cycle).select(channel, "cycle", "n", k.alias("kurtosis"))


def in_blocks(samples: DataFrame, channel: str, index: str, value: str, block: int, halo: int) -> DataFrame:
    """(channel, block, first, xs): arrays of at most block + 2 * halo samples in order;
    the halo repeats the neighbours' samples so that filters see across the edges."""
    own = F.floor(F.col(index) / block)
    offset = F.col(index) - own * block
    at = F.array_compact(F.array(own, F.when(offset < halo, own - 1), F.when(offset >= block - halo, own + 1)))
    spread = samples.select(channel, F.col(index).alias("_i"), F.col(value).cast("double").alias("_x"), F.explode(at).alias("block"))
    pairs = F.array_sort(F.collect_list(F.struct("_i", "_x")))  # bounded by the block size
    got = spread.groupBy(channel, "block").agg(pairs.alias("p"))
    return got.select(channel, "block", F.col("p")[0]["_i"].alias("first"), F.transform("p", lambda s: s["_x"]).alias("xs"))


def wavelet_coefficients(samples: DataFrame, channel: str, index: str, value: str, bands: Sequence[int] = (1, 2, 3), order: int = 4, block: int = 1 << 15) -> DataFrame:
    """(channel, band, sample, coefficient) of the detail bands of long channels, block
    by block. The halo covers the filters' reach, so only channel ends are mirrored."""
    deepest = max(bands)
    halo = (2 * order) << deepest
    block = -(-max(block, 4 * halo) // (1 << deepest)) << deepest
    types = dict(samples.dtypes)
    blocks = in_blocks(samples, channel, index, value, block, halo)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ch, b, first, xs in zip(batch[channel], batch["block"], batch["first"], batch["xs"], strict=True):
                x = np.asarray(xs, dtype=float)[None, :]
                _, details = kernels.wavedec(x, deepest, order)
                parts = []
                for level in bands:
                    d = details[level - 1][0]
                    at = first + (np.arange(len(d)) << level) + (1 << (level - 1))
                    mine = (at >= b * block) & (at < (b + 1) * block)
                    parts.append(pd.DataFrame({channel: ch, "band": f"D{level}", "sample": at[mine], "coefficient": d[mine]}))
                yield pd.concat(parts)

    return blocks.mapInPandas(run, f"{channel} {types[channel]}, band string, sample long, coefficient double")


def wavelet_events(coefficients: DataFrame, channel: str, percentile: float = 0.995) -> DataFrame:
    """(channel, band, sample, amplitude, threshold, significance): coefficients whose
    size exceeds the exact percentile of their channel and band."""
    sized = materialize(coefficients.withColumn("size", F.abs("coefficient")), "coefficients")
    cuts = exact_percentiles(sized, [channel, "band"], ["size"], [percentile]).select(F.col(channel).alias("_c"), F.col("band").alias("_b"), F.col("value").alias("threshold"))
    spread = sized.groupBy(F.col(channel).alias("_c2"), F.col("band").alias("_b2")).agg(F.stddev_pop("coefficient").alias("sd"))
    side = cuts.join(spread, cuts["_c"].eqNullSafe(spread["_c2"]) & (cuts["_b"] == spread["_b2"])).drop("_c2", "_b2")
    side = small_side(side)
    rows = sized.join(side, sized[channel].eqNullSafe(side["_c"]) & (sized["band"] == side["_b"])).where(F.col("size") > F.col("threshold"))
    return rows.select(channel, "band", "sample", F.col("size").alias("amplitude"), "threshold", ((F.col("size") - F.col("threshold")) / (F.col("sd") + 1e-10)).alias("significance"))


def zero_crossing_phase(samples: DataFrame, channel: str, index: str, value: str) -> DataFrame:
    """(channel, index, phase): 0 to 360 degrees between rising zero crossings of the
    reference less its mean, as-of joined by windows over ranges of the channel. Samples
    before the first or after the last crossing go on with the first or last period;
    channels of fewer than two crossings have null phases."""
    means = small_side(samples.groupBy(channel).agg(F.avg(value).alias("_m")).withColumnRenamed(channel, "_mc"))
    rows = samples.join(means, samples[channel].eqNullSafe(means["_mc"])).withColumn("_r", F.col(value) - F.col("_m")).drop("_mc", "_m")
    near = with_neighbour(rows, channel, index, "_r").withColumnRenamed("_before", "_p")
    rising = (F.col("_p") < 0) & (F.col("_r") >= 0)
    at = F.when(rising, F.col(index) - 1 + F.col("_p") / (F.col("_p") - F.col("_r")))
    marked = near.withColumn("_z", at).withColumn("_chunk", F.floor(F.col(index) / CHUNK))
    back = Window.partitionBy(channel, "_chunk").orderBy(index)
    marked = marked.withColumn("_left", F.last("_z", ignorenulls=True).over(back))
    ahead = Window.partitionBy(channel, "_chunk").orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_right", F.last("_z", ignorenulls=True).over(ahead))
    edges = marked.groupBy(channel, "_chunk").agg(F.min("_z").alias("_z0"), F.max("_z").alias("_z1"))
    by = Window.partitionBy(channel).orderBy("_chunk")
    after = Window.partitionBy(channel).orderBy(F.desc("_chunk"))
    edges = edges.withColumn("_in", F.last("_z1", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "_out", F.last("_z0", ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1))
    )
    ends = _end_crossings(marked, channel, "_chunk", "_z")
    edges = edges.join(ends, edges[channel].eqNullSafe(ends["_dc"]), "left")
    e = small_side(edges.select(F.col(channel).alias("_ec"), F.col("_chunk").alias("_ek"), "_in", "_out", "_first", "_second", "_last", "_prior"))
    full = marked.join(e, marked[channel].eqNullSafe(e["_ec"]) & (marked["_chunk"] == e["_ek"]))
    left, right = F.coalesce("_left", "_in"), F.coalesce("_right", "_out")
    phase = (
        F.when(right > left, (F.col(index) - left) / (right - left) * 360)
        .when(left.isNull(), F.pmod((F.col(index) - F.col("_first")) / (F.col("_second") - F.col("_first")) * 360, F.lit(360.0)))
        .otherwise(F.pmod((F.col(index) - F.col("_last")) / (F.col("_last") - F.col("_prior")) * 360, F.lit(360.0)))
    )
    return full.select(channel, index, phase.alias("phase"))


def _end_crossings(marked: DataFrame, channel: str, chunk: str, z: str) -> DataFrame:
    """(_dc, _first, _second, _prior, _last): the outer crossings of each channel that has
    two at least, from the two lowest and two highest of each range."""
    hit = marked.where(F.col(z).isNotNull()).select(channel, chunk, z)
    lowest = hit.withColumn("_r", F.row_number().over(Window.partitionBy(channel, chunk).orderBy(z)))
    highest = hit.withColumn("_r", F.row_number().over(Window.partitionBy(channel, chunk).orderBy(F.desc(z))))
    few = lowest.where(F.col("_r") <= 2).unionByName(highest.where(F.col("_r") <= 2)).select(channel, z).distinct()
    up = few.withColumn("_r", F.row_number().over(Window.partitionBy(channel).orderBy(z))).where(F.col("_r") <= 2)
    down = few.withColumn("_r", F.row_number().over(Window.partitionBy(channel).orderBy(F.desc(z)))).where(F.col("_r") <= 2)
    a = up.groupBy(F.col(channel).alias("_dc")).agg(F.min(z).alias("_first"), F.max(z).alias("_second"), F.count("*").alias("_n")).where(F.col("_n") == 2).drop("_n")
    b = down.groupBy(F.col(channel).alias("_db")).agg(F.min(z).alias("_prior"), F.max(z).alias("_last"))
    return a.join(b, a["_dc"].eqNullSafe(b["_db"])).drop("_db")


def pulse_rate_threshold(
    samples: DataFrame, channel: str, index: str, value: str, levels: DataFrame, per_cycle: int, target: float, lowest: float = 3.0, highest: float = 20.0, step: float = 0.1
) -> DataFrame:
    """(channel, k_sigma, threshold, per_cycle): the least multiple of the robust deviation
    (on a grid) at which rising and falling crossings per cycle do not exceed ``target``;
    the highest multiple if none does. ``levels``: channel, baseline, mad, n_values.

    A crossing of every level between two samples is two marks, one where it begins and
    one where it ends, so one aggregation counts the crossings of all levels at once.
    """
    grid = int(round((highest - lowest) / step))
    side = small_side(levels.select(F.col(channel).alias("_lc"), "baseline", (F.col("mad") * 1.4826).alias("sigma"), "n_values"))
    prev = with_neighbour(samples, channel, index, value)
    rows = prev.join(side, prev[channel].eqNullSafe(side["_lc"])).where((F.col("sigma") > 0) & F.col("_before").isNotNull())

    def level(x: Column) -> Column:
        """The first grid level that is not below x."""
        return F.greatest(F.lit(0), F.least(F.lit(grid + 1), F.ceil(F.round((x / F.col("sigma") - lowest) / step, 9)))).cast("int")

    now, was = F.col(value) - F.col("baseline"), F.col("_before") - F.col("baseline")
    marks = F.array(
        F.struct(level(was).alias("b"), level(now).alias("e")), F.struct(level(-was).alias("b"), level(-now).alias("e"))
    )
    spans = rows.select(channel, F.explode(marks).alias("m")).where(F.col("m.b") < F.col("m.e"))
    steps = spans.select(channel, F.explode(F.array(F.struct(F.col("m.b").alias("at"), F.lit(1).alias("d")), F.struct(F.col("m.e").alias("at"), F.lit(-1).alias("d")))).alias("s"))
    marked = steps.groupBy(channel, "s.at").agg(F.sum("s.d").alias("d"))
    every = side.where(F.col("sigma") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(grid))))
    full = every.join(marked.withColumnsRenamed({channel: "_mc", "at": "_at"}), every["_lc"].eqNullSafe(F.col("_mc")) & (every["at"] == F.col("_at")), "left")
    count = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("_lc").orderBy("at"))
    rated = full.withColumn("rate", count / (F.col("n_values") / per_cycle))
    best = rated.groupBy("_lc").agg(
        F.coalesce(F.min(F.when(F.col("rate") <= target, F.struct("at", "rate"))), F.max(F.struct("at", "rate"))).alias("b"), F.max("sigma").alias("sigma")
    )
    k = F.lit(lowest) + F.col("b.at") * step
    return best.select(F.col("_lc").alias(channel), k.alias("k_sigma"), (k * F.col("sigma")).alias("threshold"), F.col("b.rate").alias("per_cycle"))


def sine_fit(samples: DataFrame, channel: str, index: str, value: str, period: float, spread: float = 0.1, steps: int = 40) -> DataFrame:
    """(channel, period, amplitude, phase): the sine of the best period within ``spread``
    of the nominal one. For every period on a grid the least-squares sine follows from
    sums over the channel; the phase is that of the sample with index 0."""
    means = small_side(samples.groupBy(channel).agg(F.avg(value).alias("_m")).withColumnRenamed(channel, "_mc"))
    rows = samples.join(means, samples[channel].eqNullSafe(means["_mc"])).select(channel, F.col(index).alias("_i"), (F.col(value) - F.col("_m")).alias("_x"))
    grid = F.explode(F.array(*[F.lit(period * (1 - spread + 2 * spread * k / steps)) for k in range(steps + 1)]))  # a fixed grid
    turn = F.col("_i") * (2 * np.pi) / F.col("period")
    sums = rows.withColumn("period", grid).groupBy(channel, "period").agg(
        F.sum(F.sin(turn) * F.sin(turn)).alias("ss"), F.sum(F.cos(turn) * F.cos(turn)).alias("cc"), F.sum(F.sin(turn) * F.cos(turn)).alias("sc"),
        F.sum(F.col("_x") * F.sin(turn)).alias("xs"), F.sum(F.col("_x") * F.cos(turn)).alias("xc"),
    )
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    a, b = F.try_divide(F.col("xs") * F.col("cc") - F.col("xc") * F.col("sc"), det), F.try_divide(F.col("xc") * F.col("ss") - F.col("xs") * F.col("sc"), det)
    fitted = sums.select(channel, "period", a.alias("a"), b.alias("b"), (a * F.col("xs") + b * F.col("xc")).alias("gain")).where(F.col("gain").isNotNull())
    best = fitted.groupBy(channel).agg(F.max(F.struct(F.round("gain", 6).alias("g"), (-F.col("period")).alias("p"), "a", "b")).alias("f"))
    return best.select(
        channel, (-F.col("f.p")).alias("period"), F.sqrt(F.col("f.a") * F.col("f.a") + F.col("f.b") * F.col("f.b")).alias("amplitude"),
        F.pmod(F.degrees(F.atan2("f.b", "f.a")), F.lit(360.0)).alias("phase"),
    )
