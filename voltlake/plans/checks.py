"""Queries over what names and recorded values tell about acquisitions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators import checks, events, labels, streams
from voltlake.plans import streams as s
from voltlake.plans.pulses import _dig, digits
from voltlake.runtime import once_per_key, read_table

_PULSE = ("acquisition_id", "absolute_amplitude", "peak_amplitude_positive", "peak_amplitude_negative", "trigger_time", "phase_angle")


def _pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once_per_key(read_table(spark, sf_dir, "pulse_features").select("pulse_key", *_PULSE), ["pulse_key"])


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once_per_key(read_table(spark, sf_dir, "acquisitions").select("acquisition_id", "dataset", "sensor_id", "n_waveforms", "ac_frequency"), ["acquisition_id"])


def amplitude_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pulses of each acquisition have the amplitude of their larger peak."""
    got = checks.amplitude_agreement(_pulses(spark, sf_dir), "acquisition_id", "absolute_amplitude", "peak_amplitude_positive", "peak_amplitude_negative")
    return got.select("acquisition_id", "n", "n_agree", digits(F.col("percent")).alias("percent"))


def phase_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the phases of each acquisition follow from its trigger times."""
    sets = _sets(spark, sf_dir).select("acquisition_id", F.coalesce("ac_frequency", F.lit(60.0)).alias("hz"))
    rows = _pulses(spark, sf_dir).join(sets, "acquisition_id")
    got = checks.phase_agreement(rows, "acquisition_id", "trigger_time", "phase_angle", "hz", 10.0, 5)
    return got.select("acquisition_id", "n", F.round("offset", 5).alias("offset"), F.round("concentration", 6).alias("concentration"), "n_agree", digits(F.col("percent")).alias("percent"))


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisitions, sensors, waveforms and distinct pulses of each type that names tell."""
    sets = labels.labelled(_sets(spark, sf_dir), "dataset")
    sizes = _pulses(spark, sf_dir).groupBy("acquisition_id").agg(F.count("*").alias("n_pulses"))
    return sets.join(sizes, "acquisition_id", "left").groupBy("label").agg(
        F.count("*").alias("n_acquisitions"), F.countDistinct("sensor_id").alias("n_sensors"), F.sum("n_waveforms").alias("n_waveforms"), F.coalesce(F.sum("n_pulses"), F.lit(0)).alias("n_pulses")
    )


def stream_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess kurtosis of the samples of each channel by quadrant of their phase."""
    rows = s.samples(spark, sf_dir)
    phases = streams.zero_crossing_phase(rows, "channel", "i", "x").select(F.col("channel").alias("c"), F.col("i").alias("k"), digits(F.col("phase"), 6).alias("phase"))
    joined = rows.join(phases, rows["channel"].eqNullSafe(phases["c"]) & (rows["i"] == phases["k"])).select("channel", "phase", "x")
    got = events.quadrant_kurtosis(joined, "channel", "phase", "x")
    return got.select("channel", "part", "n", (F.round("kurtosis", 5) + 0.0).alias("kurtosis"), "verdict")


QUERIES = {"amplitude_check": amplitude_check, "phase_check": phase_check, "labelled_corpus": labelled_corpus, "stream_quadrants": stream_quadrants}

_ONCE = f"pu AS (SELECT pulse_key, {', '.join(f'min({c}) AS {c}' for c in _PULSE)} FROM pulse_features GROUP BY pulse_key)"
_SETS = "se AS (SELECT acquisition_id, min(dataset) AS dataset, min(sensor_id) AS sensor_id, min(n_waveforms) AS n_waveforms, min(ac_frequency) AS ac_frequency FROM acquisitions GROUP BY acquisition_id)"
_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(lower(dataset), '{'|'.join(several)}') THEN '{kind}'" for kind, several in labels.PATTERNS) + " END"

SQL = {
    "amplitude_check": f"""WITH {_ONCE}, o AS (SELECT acquisition_id, isfinite(absolute_amplitude) AND isfinite(peak_amplitude_positive) AND isfinite(peak_amplitude_negative) AS ok,
  abs(absolute_amplitude) AS a, greatest(abs(peak_amplitude_positive), abs(peak_amplitude_negative)) AS z FROM pu),
c AS (SELECT acquisition_id, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE ok AND abs(a - z) <= z * 1e-10) AS n_agree FROM o GROUP BY acquisition_id)
SELECT acquisition_id, n, n_agree, CASE WHEN n > 0 THEN {_dig("n_agree * 100.0::DOUBLE / n")} END AS percent FROM c""",
    "phase_check": f"""WITH {_ONCE}, {_SETS}, g AS (SELECT acquisition_id, phase_angle - ((((trigger_time * coalesce(ac_frequency, 60)) % 1) + 1) % 1) * 360 AS d FROM pu JOIN se USING (acquisition_id)
  WHERE isfinite(trigger_time) AND isfinite(phase_angle) AND isfinite(coalesce(ac_frequency, 60)) AND coalesce(ac_frequency, 60) > 0),
m AS (SELECT acquisition_id, count(*) AS n, avg(sin(radians(d))) AS si, avg(cos(radians(d))) AS co FROM g GROUP BY acquisition_id),
o AS (SELECT *, (round(degrees(atan2(si, co)), 5) + 360) % 360 AS f FROM m),
h AS (SELECT acquisition_id, count(*) FILTER (WHERE abs((d - f + 180 + 1080) % 360 - 180) <= 10) AS n_agree FROM g JOIN o USING (acquisition_id) GROUP BY acquisition_id)
SELECT acquisition_id, n, CAST(round(f, 5) AS DOUBLE) AS "offset", CAST(round(sqrt(si * si + co * co), 6) AS DOUBLE) AS concentration, n_agree, {_dig("n_agree * 100.0::DOUBLE / n")} AS percent FROM o JOIN h USING (acquisition_id)""",
    "labelled_corpus": f"""WITH {_ONCE}, {_SETS}, la AS (SELECT *, {_LABEL} AS label FROM se), z AS (SELECT acquisition_id, count(*) AS n FROM pu GROUP BY acquisition_id)
SELECT label, count(*) AS n_acquisitions, count(DISTINCT sensor_id) AS n_sensors, CAST(sum(n_waveforms) AS BIGINT) AS n_waveforms, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pulses
FROM la LEFT JOIN z USING (acquisition_id) WHERE label IS NOT NULL GROUP BY label""",
    "stream_quadrants": f"""WITH j AS (SELECT p.channel, phase, x, least(floor((phase % 360) / 90), 3)::INTEGER AS q FROM ({s.SQL["stream_phase"]}) p
  JOIN (SELECT l_suppkey AS channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(s._ORDER)}) - 1 AS i, l_extendedprice AS x FROM lineitem) v ON v.channel = p.channel AND v.i = p.i WHERE phase IS NOT NULL),
l AS (SELECT channel, 'Q' || (q + 1) AS part, x FROM j UNION ALL SELECT channel, CASE WHEN q < 2 THEN 'positive' ELSE 'negative' END, x FROM j UNION ALL SELECT channel, 'all', x FROM j),
m AS (SELECT channel, part, count(*) AS n, var_pop(x) AS m2, kurtosis_pop(x) AS k FROM l GROUP BY ALL),
r AS (SELECT channel, part, n, CASE WHEN n < 4 OR m2 < 1e-20 THEN 0 ELSE coalesce(k, 0) END AS kk FROM m)
SELECT channel, part, n, CAST(round(kk, 5) + 0.0 AS DOUBLE) AS kurtosis, CASE WHEN kk >= 10 THEN 'process' WHEN kk >= 5 THEN 'uncertain' ELSE 'skip' END AS verdict FROM r""",
}
