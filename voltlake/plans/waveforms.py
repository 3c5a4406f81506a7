"""Queries over waveforms (the ``embeddings`` table: 64 samples, data set = label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators import waveforms
from voltlake.plans.pulses import NUDGE, digits
from voltlake.runtime import materialize, read_table

#: The sample interval of the waveforms.
DT = 4e-9


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pulse_id"), F.col("label").alias("dataset"), F.col("embedding").alias("waveform"))


def waveform_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude, energy and shape features by higher-order functions."""
    got = waveforms.basic_features(_waves(spark, sf_dir), ["pulse_id"], "waveform", DT)
    return got.select("pulse_id", *[digits(F.col(c), 7).alias(c) for c in got.columns if c != "pulse_id"])


def waveform_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pulse features: intrinsic ones by the kernel, the others per data set."""
    features = materialize(waveforms.intrinsic_features(_waves(spark, sf_dir), ["pulse_id", "dataset"], "waveform", DT), "features")
    return waveforms.with_normalised(features, "dataset", 64, DT)


def waveform_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign of each waveform by six methods."""
    return waveforms.polarity_methods(_waves(spark, sf_dir), ["pulse_id"], "waveform")


def window_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive windows compared per data set and method."""
    return waveforms.window_comparison(_waves(spark, sf_dir), "dataset", "waveform", DT)


def window_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window method of each data set that leaves the fewest windows of several pulses."""
    return waveforms.best_windows(window_methods(spark, sf_dir), "dataset")


QUERIES = {"window_best": window_best, "waveform_basics": waveform_basics, "waveform_features": waveform_features, "waveform_polarity": waveform_polarity, "window_methods": window_methods}


def _dig(e: str) -> str:
    return f"CAST(printf('%.7e', ({e}) * {NUDGE!r}::DOUBLE + 0.0) AS DOUBLE)"


_BASIC = {
    "peak_amplitude_positive": "hi", "peak_amplitude_negative": "lo", "absolute_amplitude": "top", "peak_to_peak_amplitude": "hi - lo", "rms_amplitude": "rms",
    "crest_factor": "CASE WHEN rms <> 0 THEN top / rms ELSE 0 END",
    "pulse_width": f"(len(w) - list_position(list_reverse(list_transform(w, lambda v: abs(v) >= 0.5 * top)), true) + 1 - list_position(list_transform(w, lambda v: abs(v) >= 0.5 * top), true)) * {DT}::DOUBLE",
    "slew_rate": f"list_max(list_transform(range(2, len(w) + 1), lambda i: abs(w[i] - w[i - 1]))) / {DT}::DOUBLE",
    "energy": f"e * {DT}::DOUBLE", "charge": f"c * {DT}::DOUBLE", "energy_charge_ratio": "CASE WHEN c <> 0 THEN e / c ELSE 0 END",
    "cumulative_energy_area_ratio": "CASE WHEN dn > 0 THEN up / dn WHEN up > 0 THEN 'inf'::DOUBLE ELSE 1 END",
    "zero_crossing_count": "len(list_filter(range(2, len(w) + 1), lambda i: (w[i] < 0) <> (w[i - 1] < 0)))",
}

SQL = {
    "waveform_basics": f"""WITH d AS (SELECT vec_id AS pulse_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
b AS (SELECT pulse_id, list_transform(x, lambda v: v - CASE WHEN len(x) > 50 THEN list_sum(x[1:50]) / 50 ELSE list_sum(x) / len(x) END) AS w FROM d WHERE len(x) > 0),
s AS (SELECT pulse_id, w, list_max(w) AS hi, list_min(w) AS lo, greatest(abs(list_max(w)), abs(list_min(w))) AS top, list_sum(list_transform(w, lambda v: v * v)) AS e,
  list_sum(list_transform(w, lambda v: abs(v))) AS c, coalesce(list_sum(list_transform(list_filter(w, lambda v: v > 0), lambda v: v * v)), 0) AS up,
  coalesce(list_sum(list_transform(list_filter(w, lambda v: v < 0), lambda v: v * v)), 0) AS dn FROM b),
r AS (SELECT *, sqrt(e / len(w)) AS rms FROM s)
SELECT pulse_id, {", ".join(f"{_dig(v)} AS {k}" for k, v in _BASIC.items())} FROM r""",
    "waveform_polarity": """WITH d AS (SELECT vec_id AS pulse_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
b AS (SELECT pulse_id, list_transform(x, lambda v: v - CASE WHEN len(x) > 50 THEN list_sum(x[1:50]) / 50 ELSE list_sum(x) / len(x) END) AS w FROM d WHERE len(x) > 0),
t AS (SELECT *, list_max(w) AS hi, list_min(w) AS lo, greatest(list_max(w), -list_min(w)) AS top, w[1:CASE WHEN len(w) > 50 THEN 50 ELSE 10 END] AS head FROM b),
p AS (SELECT *, CASE WHEN abs(hi) >= abs(lo) THEN 1 ELSE -1 END AS pk,
  coalesce(list_min(list_filter(range(2, len(w)), lambda i: w[i] > w[i - 1] AND w[i] > w[i + 1] AND w[i] >= 0.2 * top)), 1000000) AS up,
  coalesce(list_min(list_filter(range(2, len(w)), lambda i: w[i] < w[i - 1] AND w[i] < w[i + 1] AND -w[i] >= 0.2 * top)), 1000000) AS dn,
  coalesce(list_sum(list_transform(list_filter(w, lambda v: v > 0), lambda v: v * v)), 0) AS eu, coalesce(list_sum(list_transform(list_filter(w, lambda v: v < 0), lambda v: v * v)), 0) AS ed,
  greatest(3 * sqrt(list_sum(list_transform(head, lambda v: pow(v - list_sum(head) / len(head), 2))) / len(head)), 0.05 * top) AS lim FROM t),
s AS (SELECT *, list_min(list_filter(range(1, len(w) + 1), lambda i: abs(w[i]) > lim)) AS st FROM p)
SELECT pulse_id, pk::INTEGER AS peak, CASE WHEN top = 0 OR up <= dn THEN 1 ELSE -1 END::INTEGER AS first_peak, CASE WHEN list_sum(w) >= 0 THEN 1 ELSE -1 END::INTEGER AS integrated_charge,
  CASE WHEN eu >= ed THEN 1 ELSE -1 END::INTEGER AS energy_weighted, CASE WHEN hi < 0 OR lo >= 0 THEN pk WHEN eu >= ed THEN 1 ELSE -1 END::INTEGER AS dominant_half_cycle,
  CASE WHEN top = 0 THEN 1 WHEN st IS NULL OR len(w) - (st - 1) < 3 THEN pk WHEN w[st] > 0 THEN 1 ELSE -1 END::INTEGER AS initial_slope FROM s""",
}
