"""Queries over the triggers and phases of continuous samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators import events, streams, triggers
from voltlake.plans import streams as s
from voltlake.plans.pulses import digits
from voltlake.runtime import materialize

#: Samples searched for a pulse's peak (a third of a cycle here), and bins of the knee.
SEARCH, KNEE_BINS = 20, 200
#: A phase range through 360 degrees.
START, END = 330.0, 30.0


def _refined(spark: SparkSession, sf_dir: str, to: str) -> DataFrame:
    rows = s.samples(spark, sf_dir)
    levels = materialize(events.robust_thresholds(rows, "channel", "x", s.K_SIGMA), "levels")
    found = materialize(streams.crossings(rows, "channel", "i", "x", levels), "crossings")
    kept = events.dead_time(found, "channel", "i", s.DEAD)
    return triggers.refined_triggers(rows, kept, "channel", "i", "x", levels, s.DEAD, SEARCH, to)


def stream_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of each channel moved to the peaks of their pulses."""
    return _refined(spark, sf_dir, "peak")


def stream_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of each channel moved to where their pulses begin."""
    return _refined(spark, sf_dir, "onset")


def stream_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise floor of each channel."""
    got = triggers.noise_floors(s.samples(spark, sf_dir), "channel", "x")
    return got.select("channel", "n_values", *[digits(F.col(c)).alias(c) for c in ("baseline", "mad", "sigma", "rms_noise", "peak_to_noise")])


def stream_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust, pulse-rate and knee threshold of each channel with the triggers they give."""
    rows = s.samples(spark, sf_dir)
    robust = materialize(events.robust_thresholds(rows, "channel", "x", s.K_SIGMA), "levels")
    rate = streams.pulse_rate_threshold(rows, "channel", "i", "x", robust, s.CYCLE, 3.0, lowest=0.5, highest=2.5, step=0.05)
    knee = events.histogram_knee(rows, "channel", "x", robust, bins=KNEE_BINS)
    each = {"stdev": robust, "pulse_rate": rate, "knee": knee}
    parts = [f.select(F.col("channel").alias("_c"), F.lit(m).alias("method"), digits(F.col("threshold")).alias("threshold")) for m, f in each.items()]
    named = parts[0].unionByName(parts[1]).unionByName(parts[2])
    base = robust.select("channel", "baseline", "n_values")
    levels = materialize(base.join(named, base["channel"].eqNullSafe(named["_c"])).drop("_c"), "thresholds")
    got = triggers.compare_methods(rows, "channel", "i", "x", levels, s.CYCLE, s.DEAD)
    return got.select("channel", "method", "threshold", "n_triggers", digits(F.col("per_cycle")).alias("per_cycle"))


def stream_phase_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in a phase range through 360 degrees, and which lie at its middle."""
    rows = s.samples(spark, sf_dir)
    phases = streams.zero_crossing_phase(rows, "channel", "i", "x").select(F.col("channel").alias("c"), F.col("i").alias("k"), digits(F.col("phase"), 6).alias("phase"))
    inside = phases.where(triggers.in_phase_range(F.col("phase"), START, END))
    joined = rows.join(inside, rows["channel"].eqNullSafe(inside["c"]) & (rows["i"] == inside["k"]))
    return joined.select("channel", "i", "phase", "x", triggers.near_phase(F.col("phase"), 0.0, 5.0).alias("at_crossing"))


def stream_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of each sample by the analytic signal of its channel."""
    return triggers.hilbert_phase(s.samples(spark, sf_dir), "channel", "i", "x", s.CYCLE)


QUERIES = {
    "stream_peaks": stream_peaks, "stream_onsets": stream_onsets, "stream_noise": stream_noise, "stream_methods": stream_methods,
    "stream_phase_range": stream_phase_range, "stream_hilbert": stream_hilbert,
}

_PULSES = f""", v AS (SELECT s.channel, s.i, x - baseline AS v FROM s JOIN c USING (channel)),
a AS (SELECT d.channel, d.i AS t, v.v AS level FROM d JOIN v ON v.channel = d.channel AND v.i = d.i),
p AS (SELECT a.channel, a.t, arg_max(v.i, (CASE WHEN level >= 0 THEN v.v ELSE -v.v END, -v.i)) AS pk, max(CASE WHEN level >= 0 THEN v.v ELSE -v.v END) AS size
  FROM a JOIN v ON v.channel = a.channel AND v.i BETWEEN a.t AND a.t + {SEARCH - 1} GROUP BY a.channel, a.t)"""

_AGAIN = f""", f AS (SELECT channel, min(i) AS i FROM r GROUP BY channel UNION ALL
  SELECT f.channel, (SELECT min(r.i) FROM r WHERE r.channel = f.channel AND r.i >= f.i + {s.DEAD}) FROM f WHERE f.i IS NOT NULL)
SELECT channel, i FROM f WHERE i IS NOT NULL"""

_METHODS = f""", o AS (SELECT s.channel, abs(x - baseline) AS f, mad FROM s JOIN t USING (channel)),
tp AS (SELECT channel, max(f) AS top, count(*) AS total, max(mad) AS mad FROM o GROUP BY channel),
hi AS (SELECT o.channel, least(floor(f / top * {KNEE_BINS}), {KNEE_BINS - 1})::INTEGER AS bin, count(*) AS n, max(top) AS top, max(total) AS total, max(tp.mad) AS mad
  FROM o JOIN tp USING (channel) WHERE top > 0 GROUP BY ALL),
sc AS (SELECT *, round((sum(n) OVER (PARTITION BY channel ORDER BY bin) / total - (bin + 0.5) / {KNEE_BINS}) * (1 - 0.3 * (bin + 0.5) / {KNEE_BINS}), 12) AS s FROM hi),
kn AS (SELECT channel, greatest((arg_min(bin, (-s, bin)) + 0.5) / {KNEE_BINS} * max(top), 3 * 1.4826 * max(mad)) AS threshold FROM sc GROUP BY channel),
lv AS (SELECT channel, 'stdev' AS method, {s._dig("threshold")} AS threshold FROM t UNION ALL SELECT channel, 'knee', {s._dig("threshold")} FROM kn
  UNION ALL SELECT channel, 'pulse_rate', threshold FROM ({s.SQL["stream_rate_threshold"]})),
xm AS (SELECT n.channel, method, i FROM n JOIN lv USING (channel) WHERE (now > lv.threshold AND was <= lv.threshold) OR (now < -lv.threshold AND was >= -lv.threshold)),
km AS (SELECT channel, method, min(i) AS i FROM xm GROUP BY channel, method UNION ALL
  SELECT km.channel, km.method, (SELECT min(xm.i) FROM xm WHERE xm.channel = km.channel AND xm.method = km.method AND xm.i >= km.i + {s.DEAD}) FROM km WHERE km.i IS NOT NULL),
cm AS (SELECT channel, method, count(*) AS n FROM km WHERE i IS NOT NULL GROUP BY channel, method)
SELECT lv.channel, lv.method, lv.threshold, coalesce(cm.n, 0) AS n_triggers, {s._dig(f"coalesce(cm.n, 0) * {s.CYCLE} / n_values")} AS per_cycle
FROM lv JOIN t ON t.channel = lv.channel LEFT JOIN cm ON cm.channel = lv.channel AND cm.method = lv.method"""

SQL = {
    "stream_peaks": s._S + s._KEPT + _PULSES + ", r AS (SELECT DISTINCT channel, pk AS i FROM p)" + _AGAIN,
    "stream_onsets": s._S + s._KEPT + _PULSES
    + f""", r AS (SELECT DISTINCT channel, i FROM (SELECT p.channel, p.t, coalesce(max(v.i) + 1, max(p.pk)) AS i FROM p LEFT JOIN v
  ON v.channel = p.channel AND v.i >= p.t - {SEARCH // 2} AND v.i < p.pk AND abs(v.v) < p.size * 0.1::DOUBLE GROUP BY p.channel, p.t))""" + _AGAIN,
    "stream_noise": s._S
    + f""", o AS (SELECT s.channel, abs(x - baseline) AS f FROM s JOIN c USING (channel)),
q AS (SELECT channel, quantile_cont(f, 0.25) AS q, max(f) AS top FROM o GROUP BY channel),
r AS (SELECT channel, sqrt(avg(f * f) FILTER (WHERE f < q)) AS rms FROM o JOIN q USING (channel) GROUP BY channel)
SELECT channel, n_values, {s._dig("baseline")} AS baseline, {s._dig("mad")} AS mad, {s._dig("1.4826 * mad")} AS sigma,
  {s._dig("coalesce(rms, 1.4826 * mad)")} AS rms_noise, {s._dig("top / (1.4826 * mad)")} AS peak_to_noise FROM t JOIN q USING (channel) JOIN r USING (channel)""",
    "stream_methods": s._S + _METHODS,
    "stream_phase_range": f"""SELECT p.channel, p.i, phase, x, least(phase, 360 - phase) <= 5 AS at_crossing FROM ({s.SQL["stream_phase"]}) p
JOIN (SELECT l_suppkey AS channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(s._ORDER)}) - 1 AS i, l_extendedprice AS x FROM lineitem) q ON q.channel = p.channel AND q.i = p.i
WHERE phase >= {START} OR phase <= {END}""",
}
