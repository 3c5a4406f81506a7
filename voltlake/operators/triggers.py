"""Triggers of continuous samples: refinement to peak or onset, noise floors, thresholds
compared, and choices of samples by phase."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.operators.events import dead_time
from voltlake.operators.quantiles import exact_percentiles, finite
from voltlake.operators.streams import in_blocks, with_neighbour
from voltlake.runtime import materialize, small_side


def refined_triggers(
    samples: DataFrame, triggers: DataFrame, channel: str, index: str, value: str, levels: DataFrame, min_separation: int, search: int = 100, to: str = "peak", factor: float = 0.1
) -> DataFrame:
    """(channel, index) of triggers moved to the peak of the ``search`` samples from the
    trigger on (``to="peak"``), or to where that pulse rises above ``factor`` of its peak,
    looked for back to half the search before the trigger (``to="onset"``; the peak if the
    pulse never falls so low). The dead time is applied anew.

    The sample at the trigger gives the sign of the pulse; the first of equal peaks counts.
    ``levels``: channel, baseline. Null and NaN samples are passed over, triggers without
    a sample stay. Samples meet triggers by an equi join on ranges as wide as a search.
    """
    if to not in ("peak", "onset"):
        raise ValueError(f"no refinement to {to!r}")
    back = search // 2
    width = search + back
    spans = triggers.select(F.col(channel).alias("_tc"), F.col(index).cast("long").alias("_t")).where(F.col("_t").isNotNull()).distinct()
    first = F.floor((F.col("_t") - back) / width)
    last = F.floor((F.col("_t") + search - 1) / width)
    spans = spans.withColumn("_tb", F.explode(F.array_distinct(F.array(first, last))))
    side = small_side(levels.select(F.col(channel).alias("_lc"), "baseline"))
    cells = samples.where(finite(F.col(value))).join(side, samples[channel].eqNullSafe(side["_lc"]))
    cells = cells.select(F.col(channel).alias("_c"), F.col(index).alias("_i"), (F.col(value) - F.col("baseline")).alias("_v"), F.floor(F.col(index) / width).alias("_b"))
    met = spans.join(cells, spans["_tc"].eqNullSafe(cells["_c"]) & (spans["_tb"] == cells["_b"]))
    met = met.where((F.col("_i") >= F.col("_t") - back) & (F.col("_i") < F.col("_t") + search))
    ahead = F.col("_i") >= F.col("_t")
    facts = [
        F.max(F.when(F.col("_i") == F.col("_t"), F.col("_v"))).alias("_at"),
        F.max(F.when(ahead, F.struct("_v", (-F.col("_i")).alias("n")))).alias("_up"),
        F.max(F.when(ahead, F.struct((-F.col("_v")).alias("_v"), (-F.col("_i")).alias("n")))).alias("_down"),
    ]
    if to == "onset":
        facts.append(F.collect_list(F.struct("_i", F.abs("_v").alias("a"))).alias("_near"))  # the samples of one search
    got = met.groupBy("_tc", "_t").agg(*facts)
    best = F.when(F.col("_at") >= 0, F.col("_up")).otherwise(F.col("_down"))
    got = got.where(F.col("_at").isNotNull()).withColumn("_peak", -best["n"]).withColumn("_size", F.abs(best["_v"]))
    moved = F.col("_peak")
    if to == "onset":
        quiet = F.filter("_near", lambda p: (p["_i"] < F.col("_peak")) & (p["a"] < F.col("_size") * factor))
        moved = F.coalesce(F.array_max(F.transform(quiet, lambda p: p["_i"])) + 1, moved)
    found = got.select(F.col("_tc").alias("_fc"), F.col("_t").alias("_ft"), moved.alias("_to"))
    every = spans.select("_tc", "_t").distinct()
    placed = every.join(found, every["_tc"].eqNullSafe(found["_fc"]) & (every["_t"] == found["_ft"]), "left")
    return dead_time(materialize(placed.select(F.col("_tc").alias(channel), F.coalesce("_to", "_t").alias(index)), "refined"), channel, index, min_separation)


def noise_floors(samples: DataFrame, channel: str, value: str) -> DataFrame:
    """(channel, n_values, baseline, mad, sigma, rms_noise, peak_to_noise): the median, the
    median absolute deviation, the deviation it stands for, the root mean square of the
    quarter of the samples nearest the baseline (sigma where none is nearer than that
    quarter's edge), and the farthest sample in sigmas (null where sigma is 0). Null, NaN
    and infinite samples do not count."""
    rows = samples.where(finite(F.col(value))).select(channel, value)
    base = exact_percentiles(rows, [channel], [value], [0.5]).select(channel, "n_values", F.col("value").alias("baseline"))
    base = materialize(base, "baseline")
    side = small_side(base.select(F.col(channel).alias("_ch"), "baseline"))
    off = rows.join(side, rows[channel].eqNullSafe(side["_ch"])).select(channel, F.abs(F.col(value) - F.col("baseline")).alias("off"))
    off = materialize(off, "off")
    both = exact_percentiles(off, [channel], ["off"], [0.25, 0.5]).groupBy(F.col(channel).alias("_cc"))
    cuts = both.agg(F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("quarter"), F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("mad"))
    cuts = materialize(cuts, "cuts")
    near = small_side(cuts)
    sized = off.join(near, off[channel].eqNullSafe(near["_cc"])).groupBy(F.col(channel).alias("_sc")).agg(
        F.max("mad").alias("mad"), F.avg(F.when(F.col("off") < F.col("quarter"), F.col("off") * F.col("off"))).alias("square"), F.max("off").alias("top")
    )
    sigma = F.col("mad") * 1.4826
    return base.join(sized, base[channel].eqNullSafe(sized["_sc"])).select(
        channel, "n_values", "baseline", "mad", sigma.alias("sigma"), F.coalesce(F.sqrt("square"), sigma).alias("rms_noise"), F.try_divide(F.col("top"), sigma).alias("peak_to_noise")
    )


def triggers_by_method(samples: DataFrame, channel: str, index: str, value: str, levels: DataFrame, min_separation: int) -> DataFrame:
    """(channel, method, index): triggers after the dead time under several named
    thresholds at once. ``levels``: channel, method, baseline, threshold. The samples are
    read once, and only crossings are kept for each method."""
    named = levels.groupBy(F.col(channel).alias("_lc")).agg(F.max("baseline").alias("_base"), F.collect_list(F.struct("method", "threshold")).alias("_levels"))  # a row per method
    side = small_side(named)
    prev = with_neighbour(samples, channel, index, value)
    rows = prev.join(side, prev[channel].eqNullSafe(side["_lc"]))
    now, was = F.col(value) - F.col("_base"), F.col("_before") - F.col("_base")

    def crossed(level: Column) -> Column:
        t = level["threshold"]
        return ((now > t) & (was <= t)) | ((now < -t) & (was >= -t))

    hits = rows.select(channel, index, F.explode(F.filter("_levels", crossed)).alias("_l")).select(F.struct(F.col(channel).alias("c"), F.col("_l.method").alias("m")).alias("_s"), index)
    kept = dead_time(materialize(hits, "crossings"), "_s", index, min_separation)
    return kept.select(F.col("_s.c").alias(channel), F.col("_s.m").alias("method"), index)


def compare_methods(samples: DataFrame, channel: str, index: str, value: str, levels: DataFrame, per_cycle: int, min_separation: int) -> DataFrame:
    """(channel, method, threshold, n_triggers, per_cycle) for each named threshold, with
    0 where nothing triggers. ``levels``: channel, method, baseline, threshold, n_values."""
    counts = triggers_by_method(samples, channel, index, value, levels, min_separation).groupBy(F.col(channel).alias("_cc"), F.col("method").alias("_cm")).agg(F.count("*").alias("n"))
    joined = levels.join(counts, levels[channel].eqNullSafe(counts["_cc"]) & (levels["method"] == counts["_cm"]), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(channel, "method", "threshold", n.alias("n_triggers"), F.try_divide(n * F.lit(float(per_cycle)), F.col("n_values")).alias("per_cycle"))


def near_phase(phase: Column, target: float, tolerance: float = 1.0) -> Column:
    """Whether a phase in degrees is at most ``tolerance`` from the target on the circle."""
    return F.abs(F.pmod(phase - target + 180.0, F.lit(360.0)) - 180.0) <= tolerance


def in_phase_range(phase: Column, start: float, end: float) -> Column:
    """Whether a phase lies from ``start`` to ``end``, both included; a range whose start
    is behind its end goes through 360 degrees."""
    return (phase >= start) & (phase <= end) if start <= end else (phase >= start) | (phase <= end)


def hilbert_phase(samples: DataFrame, channel: str, index: str, value: str, period: int, block: int = 1 << 15, turns: int = 16) -> DataFrame:
    """(channel, index, phase): the angle of the analytic signal of the samples less their
    channel's mean, 0 to 360 degrees; 0 is the crest, as of a cosine.

    Channels of at most ``block`` samples are transformed whole. Longer ones are cut into
    blocks that see ``turns`` periods of their neighbours on both sides: the transform's
    kernel falls with the distance, so the angle of a signal of about that period moves by
    a fraction of a degree. Null and NaN samples are passed over; samples of a channel
    are numbered without gaps."""
    rows = samples.where(finite(F.col(value)))
    means = small_side(rows.groupBy(channel).agg(F.avg(value).alias("_m")).withColumnRenamed(channel, "_mc"))
    centred = rows.join(means, rows[channel].eqNullSafe(means["_mc"])).select(channel, index, (F.col(value) - F.col("_m")).alias("_r"))
    blocks = in_blocks(centred, channel, index, "_r", max(block, 2 * turns * period), turns * period)
    width, types = max(block, 2 * turns * period), dict(samples.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ch, b, first, xs in zip(batch[channel], batch["block"], batch["first"], batch["xs"], strict=True):
                x = np.asarray(xs, dtype=float)
                n = len(x)
                gain = np.zeros(n)
                gain[0], gain[1 : (n + 1) // 2] = 1, 2
                if n % 2 == 0:
                    gain[n // 2] = 1
                turned = np.degrees(np.angle(np.fft.ifft(np.fft.fft(x) * gain))) % 360.0
                at = first + np.arange(n)
                mine = (at >= b * width) & (at < (b + 1) * width)
                yield pd.DataFrame({channel: ch, index: at[mine], "phase": turned[mine]})

    return blocks.mapInPandas(run, f"{channel} {types[channel]}, {index} long, phase double")
