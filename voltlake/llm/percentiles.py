"""Percentiles of very large columns per group, exact and mergeable.

Exact bisection: value intervals are kept per group and percentile, rows below midpoints
are counted in each pass, and the intervals narrow until the target ranks are resolved.
The counts of the first pass are the mergeable form: they add up over days and sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm.bisection import RELATIVE_ERROR, approx_percentiles, bucket_counts, exact_percentiles, merge_counts
from voltlake.operators.quantiles import long_measures
from voltlake.runtime import materialize, once_per_key, read_table

MEASURES = ("absolute_amplitude", "energy", "rise_time")
PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
#: Significant digits after the first that the query returns.
DIGITS = 9


def _pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pulse_features").select("pulse_key", "sensor_id", "recorded_at", *MEASURES)
    once = once_per_key(rows, ["pulse_key"])
    return once.select("sensor_id", F.to_date("recorded_at").alias("day"), *MEASURES)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per sensor, per day and per sensor and day; exact, so the bound is 0."""
    pulses = materialize(_pulses(spark, sf_dir), "pulses")
    found = exact_percentiles(pulses, [["sensor_id"], ["day"], ["sensor_id", "day"]], MEASURES, PROBS)
    names = F.array(F.lit("sensor"), F.lit("day"), F.lit("sensor_day"))
    value = F.format_string(f"%.{DIGITS}e", F.col("value")).cast("double")
    return found.select(
        F.get(names, F.col("grouping")).alias("grouping"), "sensor_id", "day", "measure", "prob", "n_values", value.alias("value"), F.lit(0.0).alias("error_bound")
    )


def p3_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable summary of each sensor and day: rows and value range by bucket."""
    return bucket_counts(long_measures(_pulses(spark, sf_dir), ["sensor_id", "day"], MEASURES), ["sensor_id", "day"])


def p3_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sensor's percentiles over all days from the day summaries alone: the order
    statistic of rank floor(p * (n - 1)) lies between ``lo`` and ``hi``, whose geometric
    middle is off by at most ``error_bound`` of its value."""
    days = materialize(p3_day_counts(spark, sf_dir), "days")
    placed = approx_percentiles(merge_counts(days, ["sensor_id"]), ["sensor_id"], PROBS)
    middle = F.when(F.col("lo") > 0, F.sqrt(F.col("lo")) * F.sqrt(F.col("hi"))).otherwise((F.col("lo") + F.col("hi")) / 2)
    return placed.select("sensor_id", "measure", F.col("_k").alias("rank"), "n_values", "lo", "hi", middle.alias("value"), F.lit(RELATIVE_ERROR).alias("error_bound"))


QUERIES = {"p3_percentiles": p3_percentiles, "p3_day_counts": p3_day_counts, "p3_from_counts": p3_from_counts}

_PROB_LIST = ", ".join(str(p) for p in PROBS)

SQL = {
    "p3_percentiles": f"""
WITH once AS (
  SELECT pulse_key, min(sensor_id) AS sensor_id, CAST(min(recorded_at) AT TIME ZONE 'UTC' AS DATE) AS day,
         min(absolute_amplitude) AS absolute_amplitude, min(energy) AS energy, min(rise_time) AS rise_time
  FROM pulse_features GROUP BY pulse_key),
long AS (
  {" UNION ALL ".join(f"SELECT sensor_id, day, '{m}' AS measure, {m} AS v FROM once WHERE isfinite({m})" for m in MEASURES)}),
cuts AS (
  SELECT 'sensor' AS grouping, sensor_id, NULL::DATE AS day, measure, count(*) AS n_values, quantile_cont(v, [{_PROB_LIST}]) AS q FROM long GROUP BY sensor_id, measure
  UNION ALL
  SELECT 'day', NULL::INTEGER, day, measure, count(*), quantile_cont(v, [{_PROB_LIST}]) FROM long GROUP BY day, measure
  UNION ALL
  SELECT 'sensor_day', sensor_id, day, measure, count(*), quantile_cont(v, [{_PROB_LIST}]) FROM long GROUP BY sensor_id, day, measure)
SELECT grouping, sensor_id, day, measure, CAST(p AS DOUBLE) AS prob, n_values, CAST(printf('%.{DIGITS}e', x) AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS error_bound
FROM (SELECT grouping, sensor_id, day, measure, n_values, unnest([{_PROB_LIST}]) AS p, unnest(q) AS x FROM cuts)
""",
}
