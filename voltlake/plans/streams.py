"""Queries over continuous samples (the ``lineitem`` prices of a supplier, in key order,
are the samples of a channel) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.operators import events, streams
from voltlake.operators.faults import with_chunks
from voltlake.plans.pulses import NUDGE, digits
from voltlake.runtime import materialize, read_table, small_side

K_SIGMA, DEAD, PRE, POST, CYCLE = 1.2, 10, 4, 12, 60
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, i, x): samples of each channel numbered from 0, within ranges of the
    channel that begin where the ranges before end."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", *_ORDER)
    cut = with_chunks(rows, "l_suppkey", "l_orderkey")
    sizes = cut.groupBy("l_suppkey", "_chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("l_suppkey").orderBy("_chunk")) - F.col("n")
    starts = small_side(materialize(sizes.select(F.col("l_suppkey").alias("_s"), F.col("_chunk").alias("_c"), before.alias("_start")), "starts"))
    inside = F.row_number().over(Window.partitionBy("l_suppkey", "_chunk").orderBy(*_ORDER)) - 1
    placed = cut.withColumn("_i", inside).join(starts, F.col("l_suppkey").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return materialize(placed.select(F.col("l_suppkey").alias("channel"), (F.col("_start") + F.col("_i")).cast("long").alias("i"), F.col("l_extendedprice").alias("x")), "samples")


def _crossed(rows: DataFrame) -> DataFrame:
    levels = materialize(events.robust_thresholds(rows, "channel", "x", K_SIGMA), "levels")
    return materialize(streams.crossings(rows, "channel", "i", "x", levels), "crossings")


def stream_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline, deviation and trigger threshold of each channel."""
    got = events.robust_thresholds(samples(spark, sf_dir), "channel", "x", K_SIGMA)
    return got.select("channel", "n_values", *[digits(F.col(c)).alias(c) for c in ("baseline", "mad", "threshold")])


def stream_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold crossings of each channel, before any dead time."""
    return _crossed(samples(spark, sf_dir))


def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of each channel after the dead time."""
    return events.dead_time(_crossed(samples(spark, sf_dir)), "channel", "i", DEAD)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of samples around each trigger."""
    rows = samples(spark, sf_dir)
    kept = events.dead_time(_crossed(rows), "channel", "i", DEAD)
    got = streams.extract_windows(rows, kept, "channel", "i", "x", PRE, POST)
    return got.select("channel", "trigger", F.array_join(F.transform("waveform", lambda v: v.cast("decimal(18,2)").cast("string")), " ").alias("samples"), "signed_peak")


def stream_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess kurtosis of each full cycle of each channel."""
    got = streams.cycle_kurtosis(samples(spark, sf_dir), "channel", "i", "x", CYCLE)
    return got.select("channel", "cycle", "n", (F.round("kurtosis", 5) + 0.0).alias("kurtosis"))


def stream_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose wavelet coefficients exceed their band's 99.5th percentile."""
    return streams.wavelet_events(streams.wavelet_coefficients(samples(spark, sf_dir), "channel", "i", "x"), "channel")


def stream_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of each sample by the rising zero crossings of its channel."""
    got = streams.zero_crossing_phase(samples(spark, sf_dir), "channel", "i", "x")
    return got.select("channel", "i", digits(F.col("phase"), 6).alias("phase"))


def stream_rate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least threshold of each channel with at most three crossings a cycle."""
    rows = samples(spark, sf_dir)
    levels = materialize(events.robust_thresholds(rows, "channel", "x"), "levels")
    got = streams.pulse_rate_threshold(rows, "channel", "i", "x", levels, CYCLE, 3.0, lowest=0.5, highest=2.5, step=0.05)
    return got.select("channel", *[digits(F.col(c)).alias(c) for c in ("k_sigma", "threshold", "per_cycle")])


def stream_sine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sine of each channel around the nominal cycle."""
    got = streams.sine_fit(samples(spark, sf_dir), "channel", "i", "x", float(CYCLE))
    return got.select("channel", *[digits(F.col(c), 6).alias(c) for c in ("period", "amplitude")])


QUERIES = {
    "stream_rate_threshold": stream_rate_threshold, "stream_sine": stream_sine,
    "stream_thresholds": stream_thresholds, "stream_crossings": stream_crossings, "stream_triggers": stream_triggers, "stream_windows": stream_windows,
    "stream_kurtosis": stream_kurtosis, "stream_wavelet": stream_wavelet, "stream_phase": stream_phase,
}


def _dig(e: str, n: int = 9) -> str:
    return f"CAST(printf('%.{n}e', ({e}) * {NUDGE!r}::DOUBLE + 0.0) AS DOUBLE)"


_S = f"""WITH RECURSIVE s AS (SELECT l_suppkey AS channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(_ORDER)}) - 1 AS i, l_extendedprice AS x FROM lineitem),
c AS (SELECT channel, count(*) AS n_values, quantile_cont(x, 0.5) AS baseline FROM s GROUP BY channel),
m AS (SELECT s.channel, quantile_cont(abs(x - baseline), 0.5) AS mad FROM s JOIN c USING (channel) GROUP BY s.channel),
t AS (SELECT channel, n_values, baseline, mad, {1.4826 * K_SIGMA!r}::DOUBLE * mad AS threshold FROM c JOIN m USING (channel)),
n AS (SELECT channel, i, x - baseline AS now, lag(x) OVER (PARTITION BY channel ORDER BY i) - baseline AS was, threshold FROM s JOIN t USING (channel)),
x AS (SELECT channel, i, CASE WHEN now > threshold THEN 1 ELSE -1 END::INTEGER AS polarity FROM n WHERE (now > threshold AND was <= threshold) OR (now < -threshold AND was >= -threshold))"""

_KEPT = f""", k AS (SELECT channel, min(i) AS i FROM x GROUP BY channel UNION ALL
  SELECT k.channel, (SELECT min(x.i) FROM x WHERE x.channel = k.channel AND x.i >= k.i + {DEAD}) FROM k WHERE k.i IS NOT NULL),
d AS (SELECT channel, i FROM k WHERE i IS NOT NULL)"""

SQL = {
    "stream_thresholds": _S + f" SELECT channel, n_values, {_dig('baseline')} AS baseline, {_dig('mad')} AS mad, {_dig('threshold')} AS threshold FROM t",
    "stream_crossings": _S + " SELECT channel, i, polarity FROM x",
    "stream_triggers": _S + _KEPT + " SELECT channel, i FROM d",
    "stream_windows": _S
    + _KEPT
    + f""", e AS (SELECT channel, max(i) AS top FROM s GROUP BY channel),
f AS (SELECT d.channel, d.i FROM d JOIN e USING (channel) WHERE d.i >= {PRE} AND d.i + {POST} <= top + 1),
w AS (SELECT channel, min(i) AS i FROM f GROUP BY channel UNION ALL
  SELECT w.channel, (SELECT min(f.i) FROM f WHERE f.channel = w.channel AND f.i >= w.i + {PRE + POST}) FROM w WHERE w.i IS NOT NULL)
SELECT w.channel, w.i AS trigger, string_agg(printf('%.2f', x), ' ' ORDER BY s.i) AS samples, arg_min(x, (-abs(x), s.i)) AS signed_peak
FROM w JOIN s ON s.channel = w.channel AND s.i BETWEEN w.i - {PRE} AND w.i + {POST - 1} WHERE w.i IS NOT NULL GROUP BY w.channel, w.i""",
    "stream_rate_threshold": _S
    + f""", v AS (SELECT s.channel, x - baseline AS now, lag(x) OVER (PARTITION BY s.channel ORDER BY i) - baseline AS was, mad * 1.4826 AS sigma, n_values FROM s JOIN t USING (channel)),
g AS (SELECT unnest(range(0, 41)) AS lv),
z AS (SELECT channel, n_values, sigma, now / sigma AS now, was / sigma AS was FROM v WHERE was IS NOT NULL AND sigma > 0),
q AS (SELECT channel, lv, max(sigma) AS sigma,
  (count(*) FILTER (WHERE round((now - 0.5) / 0.05, 9) > lv AND round((was - 0.5) / 0.05, 9) <= lv) + count(*) FILTER (WHERE round((-now - 0.5) / 0.05, 9) > lv AND round((-was - 0.5) / 0.05, 9) <= lv)) / (max(n_values) / {CYCLE}) AS rate
  FROM z CROSS JOIN g GROUP BY channel, lv),
k AS (SELECT channel, max(sigma) AS sigma, coalesce(min(lv) FILTER (WHERE rate <= 3), max(lv)) AS lv FROM q GROUP BY channel)
SELECT k.channel, {_dig("0.5 + k.lv * 0.05")} AS k_sigma, {_dig("(0.5 + k.lv * 0.05) * k.sigma")} AS threshold, {_dig("rate")} AS per_cycle FROM k JOIN q ON q.channel = k.channel AND q.lv = k.lv""",
    "stream_sine": _S
    + f""", m2 AS (SELECT channel, i, x - avg(x) OVER (PARTITION BY channel) AS v FROM s), p AS (SELECT unnest(range(0, 41)) AS k),
u AS (SELECT channel, v, {float(CYCLE)!r}::DOUBLE * (0.9 + 0.2 * k / 40) AS period, 2 * pi() * i / ({float(CYCLE)!r}::DOUBLE * (0.9 + 0.2 * k / 40)) AS w FROM m2 CROSS JOIN p),
f AS (SELECT channel, period, sum(sin(w) * sin(w)) AS ss, sum(cos(w) * cos(w)) AS cc, sum(sin(w) * cos(w)) AS sc, sum(v * sin(w)) AS xs, sum(v * cos(w)) AS xc FROM u GROUP BY ALL),
ab AS (SELECT channel, period, (xs * cc - xc * sc) / (ss * cc - sc * sc) AS a, (xc * ss - xs * sc) / (ss * cc - sc * sc) AS b, xs, xc FROM f),
bs AS (SELECT channel, arg_max({{'p': period, 'a': a, 'b': b}}, (round(a * xs + b * xc, 6), -period)) AS o FROM ab GROUP BY channel)
SELECT channel, {_dig("o.p", 6)} AS period, {_dig("sqrt(o.a * o.a + o.b * o.b)", 6)} AS amplitude FROM bs""",
    "stream_kurtosis": _S
    + f""" SELECT channel, cycle, n, CAST(round(CASE WHEN m2 < 1e-20 THEN 0 ELSE k END, 5) + 0.0 AS DOUBLE) AS kurtosis
FROM (SELECT channel, i // {CYCLE} AS cycle, count(*) AS n, kurtosis_pop(x) AS k, var_pop(x) AS m2 FROM s GROUP BY ALL) WHERE n = {CYCLE}""",
    "stream_phase": _S
    + f""", r AS (SELECT s.channel, i, x - avg(x) OVER (PARTITION BY s.channel) AS r FROM s),
p AS (SELECT *, lag(r) OVER (PARTITION BY channel ORDER BY i) AS p FROM r),
z AS (SELECT channel, i, CASE WHEN p < 0 AND r >= 0 THEN i - 1 + p / (p - r) END AS z FROM p),
b AS (SELECT channel, i, last_value(z IGNORE NULLS) OVER (PARTITION BY channel ORDER BY i ROWS UNBOUNDED PRECEDING) AS a,
  first_value(z IGNORE NULLS) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM z),
o AS (SELECT channel, list(z ORDER BY z) AS zs FROM z WHERE z IS NOT NULL GROUP BY channel HAVING count(*) > 1),
e AS (SELECT channel, zs[1] AS z1, zs[2] AS z2, zs[-2] AS y1, zs[-1] AS y2 FROM o)
SELECT b.channel, i, {_dig("CASE WHEN c > a THEN (i - a) / (c - a) * 360 WHEN a IS NULL THEN (((i - z1) / (z2 - z1) * 360) % 360 + 360) % 360 ELSE (((i - y2) / (y2 - y1) * 360) % 360 + 360) % 360 END", 6)} AS phase
FROM b LEFT JOIN e ON e.channel = b.channel""",
}
