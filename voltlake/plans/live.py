"""A query that runs as a stream, and data set labels and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.plans.analysis import _EXPECTED, label_of
from voltlake.plans.pulses import NUDGE, digits
from voltlake.runtime import once_per_key, read_table
from voltlake.streaming import events


def live_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection events per day and detector, computed by Structured Streaming."""
    stream = events.event_stream(spark, sf_dir)
    finite = stream.withColumn("amplitude", F.when(F.abs("amplitude") < F.lit(float("inf")), F.col("amplitude")))
    # files come in any order, so an event may be as late as all of them span
    first, last = read_table(spark, sf_dir, "detection_events").agg(F.min("detected_at"), F.max("detected_at")).first()
    span = (last - first).days + 1 if first is not None else 1
    got = events.run_to_table(events.windowed(finite, late=f"{span} days"), spark)
    return got.select(F.to_date("window_start").alias("day"), "source", "n", digits(F.col("total")).alias("total"), digits(F.col("highest")).alias("highest"))


def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each acquisition with its format, label, sampling and the pulses that arrived."""
    rows = read_table(spark, sf_dir, "acquisitions").dropDuplicates(["acquisition_id"])
    counts = once_per_key(read_table(spark, sf_dir, "pulse_features").select("pulse_key", "acquisition_id"), ["pulse_key"]).groupBy("acquisition_id").agg(F.count("*").alias("n_pulses"))
    joined = rows.join(counts, "acquisition_id", "left")
    return joined.select(
        "acquisition_id", "dataset", F.lower(F.trim("format_type")).alias("format_type"), label_of(F.col("dataset")).alias("label"), F.coalesce("n_pulses", F.lit(0)).alias("n_pulses"),
        F.coalesce("sample_interval", F.lit(4e-9)).alias("sample_interval"), F.coalesce("ac_frequency", F.lit(60.0)).alias("ac_frequency"),
    )


QUERIES = {"live_event_counts": live_event_counts, "dataset_catalog": dataset_catalog}


def _dig(e: str) -> str:
    return f"CAST(printf('%.9e', ({e}) * {NUDGE!r}::DOUBLE + 0.0) AS DOUBLE)"


SQL = {
    "live_event_counts": f"""WITH once AS (SELECT event_id, min(detected_at) AS detected_at, min(source) AS source, min(CASE WHEN isfinite(amplitude) THEN amplitude END) AS a FROM detection_events GROUP BY event_id)
SELECT CAST(detected_at AT TIME ZONE 'UTC' AS DATE) AS day, source, count(*) AS n, {_dig("sum(a)")} AS total, {_dig("max(a)")} AS highest FROM once GROUP BY ALL""",
    "dataset_catalog": f"""WITH c AS (SELECT acquisition_id, count(DISTINCT pulse_key) AS n_pulses FROM pulse_features GROUP BY acquisition_id)
SELECT acquisition_id, dataset, lower(trim(format_type)) AS format_type, {_EXPECTED} AS label, coalesce(n_pulses, 0) AS n_pulses,
  coalesce(sample_interval, 4e-9::DOUBLE) AS sample_interval, coalesce(ac_frequency, 60::DOUBLE) AS ac_frequency FROM acquisitions LEFT JOIN c USING (acquisition_id)""",
}
