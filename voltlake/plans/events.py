"""Queries over detection events and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators import classify, events, windows
from voltlake.plans.pulses import NUDGE, digits
from voltlake.runtime import materialize, once_per_key, read_table

#: Samples within which two detections are one, and a detector is blind after an event.
TOLERANCE, MERGE_GAP, DEAD_TIME = 5_000, 20_000, 50_000


def band_name(column: str) -> Column:
    """D1 to D3 without spelling variants; null where it is none of them."""
    digit = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"([1-3])\s*$", 1)
    return F.when(digit != "", F.concat(F.lit("D"), digit))


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection event once, with a clean band."""
    keep = ["event_id", "acquisition_id", "sensor_id", "sample_index", "phase_degrees", "band", "amplitude", "threshold", "source"]
    rows = once_per_key(read_table(spark, sf_dir, "detection_events").select(*keep), ["event_id"])
    return rows.withColumn("band", band_name("band"))


def event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest event of each chain of close events, per acquisition."""
    rows = once(spark, sf_dir).select("acquisition_id", "event_id", "sample_index", "amplitude")
    return events.merge_nearby(rows, "acquisition_id", "sample_index", "amplitude", "event_id", MERGE_GAP)


def event_dead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample indexes that a detector with a dead time after each kept event keeps."""
    return events.dead_time(once(spark, sf_dir), "acquisition_id", "sample_index", DEAD_TIME)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each acquisition whose band's window (at 250 million samples a second)
    begins behind the window kept before."""
    return windows.kept_windows(once(spark, sf_dir), "acquisition_id", "sample_index", "event_id", "band")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(once(spark, sf_dir), "events")
    trigger, wavelet = rows.where(F.col("source") == "trigger"), rows.where(F.col("source") == "wavelet")
    pairs = materialize(events.match_within(trigger, wavelet, "acquisition_id", "sample_index", "event_id", TOLERANCE), "pairs")
    bands = rows.select(F.col("event_id").alias("_id"), F.col("band").alias("_band"))
    tb = bands.withColumnsRenamed({"_id": "left_key", "_band": "trigger_band"})
    wb = bands.withColumnsRenamed({"_id": "right_key", "_band": "wavelet_band"})
    both = pairs.join(tb, "left_key").join(wb, "right_key", "left")
    alone = wavelet.select("acquisition_id", F.col("event_id").alias("right_key"), F.col("band").alias("wavelet_band")).join(
        pairs.where(F.col("right_key").isNotNull()).select("right_key"), "right_key", "left_anti"
    )
    columns = ("acquisition_id", F.col("left_key").alias("trigger_id"), F.col("right_key").alias("wavelet_id"), "offset", "trigger_band", "wavelet_band")
    first = both.select(*columns, F.when(F.col("right_key").isNull(), "trigger_only").otherwise("matched").alias("category"))
    none = {"left_key": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "trigger_band": F.lit(None).cast("string")}
    return first.unionByName(alone.withColumns(none).select(*columns, F.lit("wavelet_only").alias("category")))


def detector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger events with the wavelet event they agree with, and what only one found."""
    return _matched(spark, sf_dir)


def band_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of matched events by either detector, with totals."""
    both = _matched(spark, sf_dir).where(F.col("category") == "matched")
    named = both.select(F.coalesce("trigger_band", F.lit("none")).alias("trigger_band"), F.coalesce("wavelet_band", F.lit("none")).alias("wavelet_band"))
    got = classify.confusion(named, "trigger_band", "wavelet_band")
    return got.select(F.coalesce("trigger_band", F.lit("all")).alias("trigger_band"), F.coalesce("wavelet_band", F.lit("all")).alias("wavelet_band"), "n")


def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude statistics per band and detector over the finite amplitudes."""
    from voltlake.operators.quantiles import exact_percentiles, finite

    rows = once(spark, sf_dir).where(finite(F.col("amplitude"))).select(F.coalesce("band", F.lit("none")).alias("band"), "source", "amplitude")
    rows = materialize(rows, "bands")
    stats = rows.groupBy("band", "source").agg(
        F.count("*").alias("n"), F.avg("amplitude").alias("mean"), F.stddev_pop("amplitude").alias("std"), F.min("amplitude").alias("lowest"), F.max("amplitude").alias("highest")
    )
    mids = exact_percentiles(rows, ["band", "source"], ["amplitude"], [0.5]).select("band", "source", F.col("value").alias("median"))
    return stats.join(mids, ["band", "source"]).select("band", "source", "n", *[digits(F.col(c)).alias(c) for c in ("mean", "std", "lowest", "highest", "median")])


def phase_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronous average of the amplitudes in 36 phase bins per acquisition."""
    got = events.sync_average(once(spark, sf_dir).where(F.abs("amplitude") < F.lit(float("inf"))), "acquisition_id", "phase_degrees", "amplitude", 36)
    return got.select("acquisition_id", "bin", "n", *[digits(F.col(c)).alias(c) for c in ("mean", "std", "highest", "lowest", "rms")])


def phase_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of phase bins with an average far above the acquisition's median bin."""
    rows = once(spark, sf_dir).where(F.abs("amplitude") < F.lit(float("inf")))
    average = materialize(events.sync_average(rows, "acquisition_id", "phase_degrees", "amplitude", 36), "average")
    return events.hotspots(average, "acquisition_id", sigma=1.0, min_bins=1, merge_gap=1, bins=36)


def phase_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess kurtosis of log amplitudes by quadrant, half cycle and whole."""
    rows = once(spark, sf_dir).where((F.col("amplitude") > 0) & (F.col("amplitude") < F.lit(float("inf")))).withColumn("level", F.ln("amplitude"))
    got = events.quadrant_kurtosis(rows, "acquisition_id", "phase_degrees", "level")
    return got.select("acquisition_id", "part", "n", (F.round("kurtosis", 5) + 0.0).alias("kurtosis"), "verdict")


def _amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltlake.operators.quantiles import finite

    return materialize(once(spark, sf_dir).where(finite(F.col("amplitude"))).select("acquisition_id", "amplitude"), "amplitudes")


def robust_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, median absolute deviation and 5-sigma threshold per acquisition."""
    got = events.robust_thresholds(_amplitudes(spark, sf_dir), "acquisition_id", "amplitude")
    return got.select("acquisition_id", "n_values", *[digits(F.col(c)).alias(c) for c in ("baseline", "mad", "threshold")])


def knee_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold at the knee of the cumulative amplitude histogram per acquisition."""
    rows = _amplitudes(spark, sf_dir)
    robust = materialize(events.robust_thresholds(rows, "acquisition_id", "amplitude"), "robust")
    got = events.histogram_knee(rows, "acquisition_id", "amplitude", robust, bins=200)
    return got.select("acquisition_id", digits(F.col("knee")).alias("knee"), digits(F.col("threshold")).alias("threshold"))


QUERIES = {
    "event_windows": event_windows, "event_merge": event_merge, "event_dead_time": event_dead_time, "detector_match": detector_match, "band_confusion": band_confusion,
    "band_statistics": band_statistics, "phase_average": phase_average, "phase_hotspots": phase_hotspots, "phase_kurtosis": phase_kurtosis,
    "robust_threshold": robust_threshold, "knee_threshold": knee_threshold,
}

_ONCE = """once AS (SELECT event_id, min(acquisition_id) AS acquisition_id, min(sample_index) AS sample_index, min(phase_degrees) AS phase_degrees,
  CASE WHEN regexp_matches(coalesce(min(band), ''), '[1-3]\\s*$') THEN 'D' || regexp_extract(min(band), '([1-3])\\s*$', 1) END AS band,
  min(amplitude) AS amplitude, min(source) AS source FROM detection_events GROUP BY event_id)"""


def _dig(e: str) -> str:
    return f"CAST(printf('%.9e', ({e}) * {NUDGE!r}::DOUBLE + 0.0) AS DOUBLE)"


_MATCH = f"""WITH {_ONCE}, t AS (SELECT * FROM once WHERE source = 'trigger'), w AS (SELECT * FROM once WHERE source = 'wavelet'),
m AS (SELECT t.event_id AS trigger_id, arg_min(w.event_id, (w.sample_index, w.event_id)) AS wavelet_id, min(w.sample_index) - min(t.sample_index) AS o
  FROM t JOIN w ON w.acquisition_id = t.acquisition_id AND w.sample_index BETWEEN t.sample_index - {TOLERANCE} AND t.sample_index + {TOLERANCE} GROUP BY t.event_id),
a AS (SELECT t.acquisition_id, t.event_id AS trigger_id, m.wavelet_id, m.o AS "offset", t.band AS trigger_band, w.band AS wavelet_band,
  CASE WHEN m.wavelet_id IS NULL THEN 'trigger_only' ELSE 'matched' END AS category FROM t LEFT JOIN m ON m.trigger_id = t.event_id LEFT JOIN w ON w.event_id = m.wavelet_id
  UNION ALL SELECT acquisition_id, NULL, event_id, NULL, NULL, band, 'wavelet_only' FROM w WHERE event_id NOT IN (SELECT wavelet_id FROM m))
"""

_ROBUST = f"""WITH {_ONCE}, v AS (SELECT acquisition_id, amplitude AS x FROM once WHERE isfinite(amplitude)),
c AS (SELECT acquisition_id, count(*) AS n_values, quantile_cont(x, 0.5) AS baseline FROM v GROUP BY acquisition_id),
d AS (SELECT v.acquisition_id, abs(x - baseline) AS f FROM v JOIN c USING (acquisition_id)),
e AS (SELECT acquisition_id, quantile_cont(f, 0.5) AS mad FROM d GROUP BY acquisition_id)"""

_PRE, _POST = ("CASE band " + " ".join(f"WHEN '{b}' THEN {w[i]}" for b, w in windows.BAND_WINDOWS.items()) + " END" for i in (0, 1))

SQL = {
    "event_windows": f"""WITH RECURSIVE {_ONCE}, w AS (SELECT acquisition_id, event_id, sample_index, band, sample_index - {_PRE} AS s, sample_index + {_POST} AS e FROM once WHERE sample_index - {_PRE} >= 0),
k AS (SELECT acquisition_id, min({{'i': sample_index, 'k': event_id, 's': s, 'e': e, 'b': band}}) AS o FROM w GROUP BY acquisition_id UNION ALL
  SELECT k.acquisition_id, (SELECT min({{'i': sample_index, 'k': event_id, 's': s, 'e': e, 'b': band}}) FROM w WHERE w.acquisition_id = k.acquisition_id AND w.s > k.o.e) FROM k WHERE k.o IS NOT NULL)
SELECT acquisition_id, o.k AS event_id, o.i AS sample_index, o.b AS band, o.s AS start, o.e AS stop FROM k WHERE o IS NOT NULL""",
    "event_merge": f"""WITH {_ONCE}, o AS (SELECT *, CASE WHEN sample_index - lag(sample_index) OVER w > {MERGE_GAP} OR lag(sample_index) OVER w IS NULL THEN 1 ELSE 0 END AS f
  FROM once WHERE sample_index IS NOT NULL WINDOW w AS (PARTITION BY acquisition_id ORDER BY sample_index, event_id)),
c AS (SELECT *, sum(f) OVER (PARTITION BY acquisition_id ORDER BY sample_index, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT acquisition_id, event_id, sample_index, amplitude, n_merged FROM (
  SELECT *, count(*) OVER (PARTITION BY acquisition_id, g) AS n_merged,
    row_number() OVER (PARTITION BY acquisition_id, g ORDER BY coalesce(-amplitude, 'inf'::DOUBLE), sample_index, event_id) AS r FROM c) WHERE r = 1""",
    "event_dead_time": f"""WITH RECURSIVE p AS (SELECT DISTINCT acquisition_id, min(sample_index) AS sample_index FROM detection_events GROUP BY event_id, acquisition_id),
k AS (SELECT acquisition_id, min(sample_index) AS sample_index FROM p WHERE sample_index IS NOT NULL GROUP BY acquisition_id
  UNION ALL SELECT k.acquisition_id, (SELECT min(p.sample_index) FROM p WHERE p.acquisition_id = k.acquisition_id AND p.sample_index >= k.sample_index + {DEAD_TIME}) AS sample_index
  FROM k WHERE k.sample_index IS NOT NULL)
SELECT acquisition_id, sample_index FROM k WHERE sample_index IS NOT NULL""",
    "detector_match": _MATCH + "SELECT * FROM a",
    "band_confusion": _MATCH
    + """, n AS (SELECT coalesce(trigger_band, 'none') AS t, coalesce(wavelet_band, 'none') AS w FROM a WHERE category = 'matched')
SELECT coalesce(t, 'all') AS trigger_band, coalesce(w, 'all') AS wavelet_band, count(*) AS n FROM n GROUP BY CUBE (t, w)""",
    "band_statistics": f"""WITH {_ONCE} SELECT coalesce(band, 'none') AS band, source, count(*) AS n, {_dig("avg(amplitude)")} AS mean, {_dig("stddev_pop(amplitude)")} AS std,
  {_dig("min(amplitude)")} AS lowest, {_dig("max(amplitude)")} AS highest, {_dig("quantile_cont(amplitude, 0.5)")} AS median FROM once WHERE isfinite(amplitude) GROUP BY ALL""",
    "phase_average": f"""WITH {_ONCE}, u AS (SELECT * FROM once WHERE isfinite(amplitude)),
b AS (SELECT acquisition_id, least(floor((((phase_degrees % 360) + 360) % 360) / 10), 35)::INTEGER AS bin, abs(amplitude) AS v FROM u WHERE phase_degrees IS NOT NULL AND NOT isnan(phase_degrees)),
g AS (SELECT acquisition_id, bin, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS highest, min(v) AS lowest, sqrt(avg(v * v)) AS rms FROM b GROUP BY ALL)
SELECT f.acquisition_id, f.bin, coalesce(n, 0) AS n, {", ".join(f"{_dig(f'coalesce({c}, 0)')} AS {c}" for c in ("mean", "std", "highest", "lowest", "rms"))}
FROM (SELECT DISTINCT acquisition_id, unnest(range(0, 36))::INTEGER AS bin FROM u) f LEFT JOIN g USING (acquisition_id, bin)""",
    "phase_kurtosis": f"""WITH {_ONCE}, v AS (SELECT acquisition_id, least(floor((((phase_degrees % 360) + 360) % 360) / 90), 3)::INTEGER AS q, ln(amplitude) AS x
  FROM once WHERE amplitude > 0 AND isfinite(amplitude) AND phase_degrees IS NOT NULL AND NOT isnan(phase_degrees)),
l AS (SELECT acquisition_id, 'Q' || (q + 1) AS part, x FROM v UNION ALL SELECT acquisition_id, CASE WHEN q < 2 THEN 'positive' ELSE 'negative' END, x FROM v UNION ALL SELECT acquisition_id, 'all', x FROM v),
m AS (SELECT acquisition_id, part, count(*) AS n, var_pop(x) AS m2, kurtosis_pop(x) AS k FROM l GROUP BY ALL),
r AS (SELECT acquisition_id, part, n, CASE WHEN n < 4 OR m2 < 1e-20 THEN 0 ELSE coalesce(k, 0) END AS kk FROM m)
SELECT acquisition_id, part, n, CAST(round(kk, 5) + 0.0 AS DOUBLE) AS kurtosis, CASE WHEN kk >= 10 THEN 'process' WHEN kk >= 5 THEN 'uncertain' ELSE 'skip' END AS verdict FROM r""",
    "robust_threshold": _ROBUST
    + f" SELECT acquisition_id, n_values, {_dig('baseline')} AS baseline, {_dig('mad')} AS mad, {_dig('1.4826 * 5 * mad')} AS threshold FROM c JOIN e USING (acquisition_id)",
    "knee_threshold": _ROBUST
    + f""", top AS (SELECT acquisition_id, max(f) AS top, count(*) AS total FROM d GROUP BY acquisition_id),
h AS (SELECT d.acquisition_id, least(floor(f / top * 200), 199)::INTEGER AS bin, count(*) AS n, max(top) AS top, max(total) AS total FROM d JOIN top USING (acquisition_id) WHERE top > 0 GROUP BY ALL),
s AS (SELECT *, round((sum(n) OVER (PARTITION BY acquisition_id ORDER BY bin) / total - (bin + 0.5) / 200) * (1 - 0.3 * (bin + 0.5) / 200), 12) AS s FROM h),
k AS (SELECT acquisition_id, (arg_min(bin, (-s, bin)) + 0.5) / 200 * max(top) AS knee FROM s GROUP BY acquisition_id)
SELECT acquisition_id, {_dig("knee")} AS knee, {_dig("greatest(knee, 3 * 1.4826 * mad)")} AS threshold FROM k JOIN e USING (acquisition_id)""",
}
