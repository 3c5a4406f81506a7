"""Whether recorded values follow from others: amplitudes from peaks, phases from times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.operators.quantiles import finite
from voltlake.runtime import small_side


def amplitude_agreement(rows: DataFrame, group: str, amplitude: str, positive: str, negative: str, rtol: float = 1e-10) -> DataFrame:
    """(group, n, n_agree, percent): rows whose amplitude has the size of the larger peak,
    within ``rtol`` of it. Rows with a null, NaN or infinite value do not count; groups
    without any other have none and a null percentage."""
    size = F.greatest(F.abs(positive), F.abs(negative))
    ok = finite(F.col(amplitude)) & finite(F.col(positive)) & finite(F.col(negative))
    same = ok & (F.abs(F.abs(F.col(amplitude)) - size) <= size * rtol)
    got = rows.groupBy(group).agg(F.count_if(ok).alias("n"), F.count_if(same).alias("n_agree"))
    return got.withColumn("percent", F.try_divide(F.col("n_agree") * 100.0, F.col("n")))


def phase_agreement(rows: DataFrame, group: str, seconds: str, phase: str, frequency: str, tolerance: float = 10.0, decimals: int = 6) -> DataFrame:
    """(group, n, offset, concentration, n_agree, percent): whether phases are those of the
    times in periods of the group's frequency, up to one offset. The offset is the mean
    direction of the differences, rounded to ``decimals``, in degrees from 0 to 360; its
    concentration is 1 if all differences are equal and near 0 if they are random; phases
    within ``tolerance`` of time and offset agree. Rows with a null, NaN or infinite value
    and those of a frequency of 0 or less do not count."""
    ok = rows.where(finite(F.col(seconds)) & finite(F.col(phase)) & finite(F.col(frequency)) & (F.col(frequency) > 0))
    gap = F.col(phase) - F.pmod(F.col(seconds) * F.col(frequency), F.lit(1.0)) * 360
    gaps = ok.select(F.col(group).alias("_g"), gap.alias("_d"))
    turn = F.radians("_d")
    mean = gaps.groupBy(F.col("_g").alias("_k")).agg(F.count("*").alias("n"), F.avg(F.sin(turn)).alias("_s"), F.avg(F.cos(turn)).alias("_c"))
    offset = F.pmod(F.round(F.degrees(F.atan2("_s", "_c")), decimals), F.lit(360.0))
    mean = small_side(mean.select("_k", "n", offset.alias("offset"), F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c")).alias("concentration")))
    both = gaps.join(mean, gaps["_g"].eqNullSafe(mean["_k"]))
    near = F.abs(F.pmod(F.col("_d") - F.col("offset") + 180, F.lit(360.0)) - 180) <= tolerance
    got = both.groupBy("_g").agg(F.max("n").alias("n"), F.max("offset").alias("offset"), F.max("concentration").alias("concentration"), F.count_if(near).alias("n_agree"))
    return got.select(F.col("_g").alias(group), "n", "offset", "concentration", "n_agree", (F.col("n_agree") * 100.0 / F.col("n")).alias("percent"))
