"""Queries over the discharge tables (pulses, events, settings) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators import badrows, drift, faults
from voltlake.runtime import materialize, once_per_key, read_table

AMPLITUDE = faults.Field("absolute_amplitude", limit="adc_range_v")
SLEW = faults.Field("slew_rate", limit="max_slew_v_s")
EVENT = faults.Field("amplitude", above="threshold")


def hour_of_day(column: str):
    return F.hour(F.col(column))


def pulses_with_limits(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each pulse once, with its sensor's limits."""
    keep = ["pulse_key", "acquisition_id", "sensor_id", "pulse_id", "trigger_time", "recorded_at", "absolute_amplitude", "slew_rate"]
    pulses = once_per_key(read_table(spark, sf_dir, "pulse_features").select(*keep, *extra), ["pulse_key"])
    limits = read_table(spark, sf_dir, "sensors").select("sensor_id", "adc_range_v", "max_slew_v_s")
    return pulses.join(F.broadcast(limits.dropDuplicates(["sensor_id"])), "sensor_id", "left")  # 48 sensors at every scale


def flagged_pulses(spark: SparkSession, sf_dir: str, fields=(AMPLITUDE, SLEW), extra: tuple[str, ...] = (), fitted: bool = True) -> DataFrame:
    """The pulses with their faults; without ``fitted`` by the spike rule alone, for those
    who only need to leave faulty readings out."""
    base = materialize(pulses_with_limits(spark, sf_dir, extra), "pulses")
    season = hour_of_day("recorded_at") if fitted else None
    return faults.flag_faults(base, "sensor_id", "acquisition_id", ["trigger_time", "pulse_id", "pulse_key"], season, list(fields))


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["event_id", "acquisition_id", "sensor_id", "sample_index", "detected_at", "amplitude", "threshold"]
    base = materialize(once_per_key(read_table(spark, sf_dir, "detection_events").select(*keep), ["event_id"]), "events")
    return faults.flag_faults(base, "sensor_id", "acquisition_id", ["sample_index", "event_id"], hour_of_day("detected_at"), [EVENT])


def _fault_rows(flagged: DataFrame, table: str, key: str, fields: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"fault_{f}").alias("fault")) for f in fields]))
    return (
        flagged.select(F.col(key).alias("row_key"), cells.alias("c"))
        .where(F.col("c.fault").isNotNull())
        .select(F.lit(table).alias("data_table"), "row_key", "c.field_name", "c.fault")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty readings of both tables with the first fault that applies."""
    pulses = _fault_rows(flagged_pulses(spark, sf_dir), "pulse_features", "pulse_key", ["absolute_amplitude", "slew_rate"])
    events = _fault_rows(flagged_events(spark, sf_dir), "detection_events", "event_id", ["amplitude"])
    return pulses.unionByName(events)


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted tail of each sensor, field and hour of day."""
    base = materialize(pulses_with_limits(spark, sf_dir), "pulses")
    long = faults.possible_readings(base, "sensor_id", hour_of_day("recorded_at"), [AMPLITUDE, SLEW])
    cuts = faults.tail_cutoffs(long, faults.tail_percentiles(long, "sensor_id"), "sensor_id")
    return cuts.withColumnRenamed("_season", "hour_of_day")


def p5_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sensor and field: readings above the fitted cutoffs, and the spikes among them."""
    pulses = materialize(flagged_pulses(spark, sf_dir), "flagged")
    cells = [F.struct(F.lit(f.name).alias("field_name"), F.col(f"proposed_{f.name}").alias("p"), F.col(f"fault_{f.name}").alias("k")) for f in (AMPLITUDE, SLEW)]
    long = pulses.select("sensor_id", F.explode(F.array(*cells)).alias("c")).select("sensor_id", "c.*")
    sound = F.col("p") & (F.col("k").isNull() | (F.col("k") == "spike"))
    return long.groupBy("sensor_id", "field_name").agg(F.count("*").alias("n"), F.count(F.when(sound, 1)).alias("proposed"), F.count(F.when(F.col("k") == "spike", 1)).alias("spikes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid settings lines with the first reason that applies."""
    lines = read_table(spark, sf_dir, "sg_lines").select("line_id", "raw_line")
    return badrows.rejected_lines(badrows.parsed_lines(lines))


def p4_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid settings lines as typed columns."""
    parsed = badrows.parsed_lines(read_table(spark, sf_dir, "sg_lines").select("line_id", "raw_line"))
    return badrows.valid_settings(parsed, badrows.rejected_lines(parsed))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "settings_dump").select("file_id", "logger_id", "written_at", "record_no", "payload")


def _drifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ingested records, changes, renames)."""
    records = _settings(spark, sf_dir)
    table = materialize(drift.ingest(records), "ingested")
    cells = materialize(drift.field_cells(table), "cells")
    return table, *drift.field_changes(cells, materialize(drift.file_sequence(table), "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each settings file against the file before it of the same logger."""
    return _drifted(spark, sf_dir)[1]


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings records in one table: seconds, hertz, whole counts, rescued rest."""
    table, _, renames = _drifted(spark, sf_dir)
    return drift.replay(table, drift.approved_names(materialize(renames, "votes"))).drop("parsed", "forms")


QUERIES = {
    "p2_found": p2_found,
    "p2_table": p2_table,
    "p4_found": p4_found,
    "p4_valid": p4_valid,
    "p5_found": p5_found,
    "p5_cutoffs": p5_cutoffs,
    "p5_peaks": p5_peaks,
}

_P5_TABLE = """
{name}_once AS (
  SELECT {key} AS row_key, min(acquisition_id) AS acq, min(sensor_id) AS sensor_id, {cols} FROM {table} GROUP BY {key}),
"""

_P5_FIELD = """
{id}_v AS (
  SELECT row_key, acq, o.sensor_id, {ord} AS ord, {v} AS v, {bad} AS bad
  FROM {name}_once o LEFT JOIN sensors s ON s.sensor_id = o.sensor_id
  WHERE {v} IS NOT NULL AND NOT isnan({v})),
{id}_n AS (
  SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM {id}_v WINDOW w AS (PARTITION BY acq ORDER BY ord)),
{id}_r AS (
  SELECT *, sum(fresh) OVER (PARTITION BY acq ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM {id}_n),
{id}_l AS (
  SELECT *, count(*) OVER (PARTITION BY acq, run) AS len FROM {id}_r),
{id}_p AS (
  SELECT sensor_id, quantile_cont(v, 0.9) AS p90 FROM {id}_v WHERE NOT bad GROUP BY sensor_id),
{id}_f AS (
  SELECT '{table}' AS data_table, row_key, '{field}' AS field_name,
         CASE WHEN bad THEN 'impossible' WHEN len >= 8 THEN 'stuck' WHEN v > 4 * p90 THEN 'spike' END AS fault
  FROM {id}_l l LEFT JOIN {id}_p p ON p.sensor_id IS NOT DISTINCT FROM l.sensor_id),
"""


def _p5_sql() -> str:
    pulse = {"name": "pu", "table": "pulse_features", "key": "pulse_key"}
    event = {"name": "ev", "table": "detection_events", "key": "event_id"}
    low = "v < 0 OR isinf(v)"
    parts = [
        _P5_TABLE.format(**pulse, cols="min(trigger_time) AS t, min(pulse_id) AS t2, min(absolute_amplitude) AS aa, min(slew_rate) AS sr"),
        _P5_TABLE.format(**event, cols="min(sample_index) AS t, min(amplitude) AS am, min(threshold) AS th"),
    ]
    for ident, base, field, v, order, rule in (
        ("a", pulse, "absolute_amplitude", "aa", "(t, t2, row_key)", "coalesce(aa > adc_range_v, false)"),
        ("b", pulse, "slew_rate", "sr", "(t, t2, row_key)", "coalesce(sr > max_slew_v_s, false)"),
        ("c", event, "amplitude", "am", "(t, row_key)", "coalesce(am <= th, false)"),
    ):
        bad = f"({low.replace('v', v, 1).replace('(v)', f'({v})')} OR {rule})"
        parts.append(_P5_FIELD.format(id=ident, name=base["name"], table=base["table"], field=field, v=v, ord=order, bad=bad))
    union = " UNION ALL ".join(f"SELECT * FROM {i}_f WHERE fault IS NOT NULL" for i in "abc")
    return "WITH " + "".join(parts).rstrip().rstrip(",") + " " + union


_P4_PARSED = r"""
WITH once AS (SELECT DISTINCT line_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS body FROM sg_lines),
sound AS (
  SELECT line_id, body,
    regexp_full_match(body, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS ok FROM once),
marked AS (
  SELECT line_id, ok, CASE WHEN ok THEN list_transform(
    regexp_extract_all(chr(9) || body, '\t("([^"]|"")*"|[^"\t]*)', 1),
    lambda c: CASE WHEN c LIKE '"%' THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) END AS cells
  FROM sound),
judged AS (
  SELECT line_id, ok, cells,
    CASE WHEN ok AND len(cells) = 19 THEN list_transform(cells[2:19], lambda c:
      CASE WHEN regexp_full_match(c, ' *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *')
           THEN try_cast(trim(c) AS DOUBLE) END) END AS nums
  FROM marked),
reasons AS (
  SELECT line_id, cells, nums,
    CASE WHEN NOT ok THEN 'quoting' WHEN len(cells) <> 19 THEN 'column_count'
         WHEN len(list_filter(nums, lambda x: x IS NOT NULL AND NOT isinf(x))) < 18
           OR nums[10] <= 0 OR nums[11] <= 0 OR nums[9] < 0 OR nums[9] <> floor(nums[9]) THEN 'invalid_value' END AS reason
  FROM judged)
"""

_P2_SQL = r"""
WITH once AS (SELECT file_id, record_no, min(logger_id) AS l, min(written_at) AS w, min(payload) AS p FROM settings_dump GROUP BY file_id, record_no),
files AS (SELECT file_id, min(l) AS l, min(w) AS w FROM once GROUP BY file_id),
seq AS (SELECT file_id, lead(file_id) OVER (PARTITION BY l ORDER BY w, file_id) AS nxt FROM files),
docs AS (SELECT file_id, record_no, p::JSON AS j FROM once WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
keyed AS (SELECT file_id, record_no, j ->> 'dataset' AS ds, unnest(json_keys(j)) AS key, j FROM docs),
val AS (SELECT file_id, record_no, ds, key, json_extract(j, '$."' || key || '"') AS v FROM keyed WHERE key <> 'dataset'),
c AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind,
  trim(CASE json_type(v) WHEN 'OBJECT' THEN coalesce(v ->> '$.value', v::VARCHAR) WHEN 'ARRAY' THEN coalesce(v ->> '$[0]', v::VARCHAR) ELSE v ->> '$' END) AS t FROM val),
d AS (SELECT * REPLACE (CASE WHEN lower(t) NOT IN ('', 'n/a', 'na', 'nan', 'none', 'null', '-') THEN t END AS t) FROM c),
e AS (SELECT *, try_cast(nullif(regexp_extract(t, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*[^\s0-9.,+-]{0,8}\s*$', 1), '') AS DOUBLE) AS num FROM d),
votes AS (SELECT file_id, key, kind, count(*) AS n FROM c WHERE kind IS NOT NULL GROUP BY ALL),
major AS (SELECT file_id, key, arg_max(kind, (n, -list_position(['number', 'text', 'object', 'list', 'boolean'], kind))) AS kind FROM votes GROUP BY file_id, key),
h AS (SELECT f.file_id, f.key, m.kind FROM (SELECT DISTINCT file_id, key FROM c) f LEFT JOIN major m ON m.file_id = f.file_id AND m.key = f.key),
nw AS (SELECT file_id AS pair, key, kind FROM h WHERE file_id IN (SELECT nxt FROM seq WHERE nxt IS NOT NULL)),
od AS (SELECT nxt AS pair, key, kind FROM h JOIN seq USING (file_id) WHERE nxt IS NOT NULL),
cmp AS (SELECT coalesce(nw.pair, od.pair) AS pair, coalesce(nw.key, od.key) AS key, nw.kind AS kn, od.kind AS ko, nw.key IS NOT NULL AS has_n, od.key IS NOT NULL AS has_o
  FROM nw FULL JOIN od ON od.pair = nw.pair AND od.key = nw.key),
ov AS (SELECT s.nxt AS pair, e.ds, e.key, arg_max(t, record_no) AS s0, arg_max(coalesce(num, 'nan'::DOUBLE), record_no) AS q0
  FROM e JOIN seq s USING (file_id) WHERE t IS NOT NULL AND ds IS NOT NULL AND s.nxt IS NOT NULL GROUP BY ALL),
nv AS (SELECT file_id AS pair, ds, key, arg_min(t, record_no) AS s1, arg_min(coalesce(num, 'nan'::DOUBLE), record_no) AS q1 FROM e WHERE t IS NOT NULL AND ds IS NOT NULL GROUP BY ALL),
met AS (SELECT o.pair, o.key AS b, n.key AS a, s0, s1, CASE WHEN isnan(q0) THEN NULL ELSE q0 END AS n0, CASE WHEN isnan(q1) THEN NULL ELSE q1 END AS n1
  FROM ov o JOIN nv n ON n.pair = o.pair AND n.ds = o.ds JOIN cmp x ON x.pair = o.pair AND x.key = o.key AND NOT x.has_n JOIN cmp y ON y.pair = n.pair AND y.key = n.key AND NOT y.has_o),
jd AS (SELECT pair, b, a, n0 = 0 AND n1 = 0 AS zero, CASE WHEN n1 <> 0 AND n0 / n1 > 0 THEN round(log10(n0 / n1) / 3)::INTEGER END AS k, n0, n1, s0, s1 FROM met WHERE (n0 IS NULL) = (n1 IS NULL)),
ag AS (SELECT *, CASE WHEN n0 IS NOT NULL THEN coalesce(zero OR (abs(k) <= 4 AND abs(n0 / n1 / pow(1000.0, k) - 1) <= 1e-6), false) ELSE lower(s0) = lower(s1) END AS ok FROM jd),
pw AS (SELECT pair, b, a, CASE WHEN ok AND NOT coalesce(zero, false) THEN coalesce(k, 0) END AS k, count(*) AS n, count(*) FILTER (WHERE ok) AS ok FROM ag GROUP BY ALL),
sc AS (SELECT pair, b, a, sum(n) AS n, coalesce(max(ok) FILTER (WHERE k IS NOT NULL), 0) + coalesce(sum(ok) FILTER (WHERE k IS NULL), 0) AS ok,
  coalesce(arg_max(k, (ok, -abs(k), k)) FILTER (WHERE k IS NOT NULL), 0) AS k FROM pw GROUP BY pair, b, a),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair, b ORDER BY ok DESC, n, abs(k), a) AS r0, row_number() OVER (PARTITION BY pair, a ORDER BY ok DESC, n, abs(k), b) AS r1 FROM sc WHERE ok * 2 > n),
rn AS (SELECT pair, b, a FROM rk WHERE r0 = 1 AND r1 = 1)
SELECT pair AS file_id, 'renamed' AS change_kind, b AS field_before, a AS field_after FROM rn
UNION ALL SELECT rn.pair, 'retyped', b, a FROM rn JOIN cmp x ON x.pair = rn.pair AND x.key = b JOIN cmp y ON y.pair = rn.pair AND y.key = a WHERE x.ko <> y.kn
UNION ALL SELECT pair, 'retyped', key, key FROM cmp WHERE has_n AND has_o AND kn <> ko
UNION ALL SELECT pair, 'removed', key, '' FROM cmp WHERE NOT has_n AND NOT EXISTS (SELECT 1 FROM rn WHERE rn.pair = cmp.pair AND rn.b = cmp.key)
UNION ALL SELECT pair, 'added', '', key FROM cmp WHERE NOT has_o AND NOT EXISTS (SELECT 1 FROM rn WHERE rn.pair = cmp.pair AND rn.a = cmp.key)
"""

SQL = {
    "p2_found": _P2_SQL,
    "p4_found": _P4_PARSED + "SELECT line_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p4_valid": _P4_PARSED
    + "SELECT line_id, cells[1] AS prefix, "
    + ", ".join(f"nums[{i + 1}] AS sg_{i}" for i in range(18))
    + " FROM reasons WHERE reason IS NULL",
    "p5_found": _p5_sql(),
}
