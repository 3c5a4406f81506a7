"""Text sets of triggered records: ``{prefix}-WFMs.txt`` and its vectors and settings.

A file is read whole and cut into lines in one row, since splitting it would lose the
line numbers that tie waveforms, phases and times together. Values that are no numbers
become null; blank cells are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffixes by content, and what the settings slots mean.
SUFFIXES = {"waveforms": ("WFMs",), "settings": ("SG",), "trigger_time": ("Ti",), "phase_angle": ("Ph", "P"), "amplitude": ("Amp", "A")}
SLOTS = {"voltage_scale": 0, "acquisition_time": 1, "total_records": 2, "ac_frequency": 9, "sample_interval": 10}
DEFAULTS = {"sample_interval": 4e-9, "ac_frequency": 60.0}
FORMATS = {"rugged": r"-WFMs\.txt$", "tektronix": r"\.wfm$", "pdn": r"\.pdn$", "mat": r"\.mat$"}


def plain_name(name: Column) -> Column:
    """A file name as it is: Spark reports it with escapes."""
    return F.try_url_decode(F.regexp_replace(name, r"\+", "%2B"))


def _prefix(suffix: str) -> Column:
    return F.regexp_extract(plain_name(F.col("_metadata.file_name")), rf"^(.*)-{suffix}\.txt$", 1)


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", f"*-{suffix}.txt").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(_prefix(suffix).alias("dataset"), F.col("value"))


def numbers(line: Column) -> Column:
    cells = F.filter(F.split(F.regexp_replace(line, r"\r$", ""), "\t"), lambda c: F.trim(c) != "")
    return F.transform(cells, lambda c: F.trim(c).try_cast("double"))


def waveforms(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, pulse_id, waveform): one row per non-blank line, numbered from 0."""
    lines = F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")
    rows = _files(spark, path, "WFMs").select("dataset", F.posexplode(lines).alias("pulse_id", "line"))
    return rows.select("dataset", F.col("pulse_id").cast("long").alias("pulse_id"), numbers(F.col("line")).alias("waveform"))


def vector(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(dataset, pulse_id, value) of a one-line vector; the first suffix that a set has wins."""
    parts = None
    for rank, suffix in enumerate(SUFFIXES[kind]):
        one = _files(spark, path, suffix).select("dataset", F.lit(rank).alias("rank"), "value")
        parts = one if parts is None else parts.unionByName(one)
    best = parts.groupBy("dataset").agg(F.min(F.struct("rank", "value")).alias("b"))
    joined = F.regexp_replace("b.value", "\n", "\t")
    return best.select("dataset", F.posexplode(numbers(joined)).alias("p", "value")).select("dataset", F.col("p").cast("long").alias("pulse_id"), "value")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, slots, one column per known slot); vectors may be short: missing slots
    are null, interval and frequency then take their defaults."""
    rows = _files(spark, path, "SG").select("dataset", numbers(F.regexp_replace("value", "\n", "\t")).alias("slots"))
    named = [F.coalesce(F.get("slots", F.lit(i)), F.lit(DEFAULTS.get(k)).cast("double")).alias(k) for k, i in SLOTS.items()]
    return rows.select("dataset", "slots", *named)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The noise summaries in ``{prefix}-metadata.json`` files."""
    raw = spark.read.option("pathGlobFilter", "*-metadata.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.regexp_extract(plain_name(F.col("_metadata.file_name")), r"^(.*)-metadata\.json$", 1)
    return raw.select(name.alias("dataset"), F.from_json("value", "map<string,double>").alias("facts"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, format_type, files): data sets by the format their file names show."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    name = plain_name(F.col("name"))
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(FORMATS.items()):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    prefix = F.regexp_replace(name, r"(-[A-Za-z]+\.txt|\.[A-Za-z]+)$", "")
    return files.select(prefix.alias("dataset"), kind.alias("format_type")).where(F.col("format_type").isNotNull()).groupBy("dataset").agg(
        F.min("format_type").alias("format_type"), F.count("*").alias("files")
    )


def swap_flags(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, swapped): whether amplitude and time files hold each other's content: the
    amplitudes never fall and start at 0 while the times do not."""

    def rising(kind: str) -> DataFrame:
        v = vector(spark, path, kind).groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("pulse_id", "value"))), lambda s: s["value"]).alias("v"))
        falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size("v") - 1, F.lit(1))), lambda i: F.get("v", i) < F.get("v", i - 1))
        return v.select("dataset", (~F.coalesce(falls, F.lit(False)) & (F.get("v", F.lit(0)) == 0)).alias(kind))

    both = rising("amplitude").join(rising("trigger_time"), "dataset", "full")
    return both.select("dataset", (F.coalesce("amplitude", F.lit(False)) & ~F.coalesce("trigger_time", F.lit(False))).alias("swapped"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Waveforms joined with phases, times and settings by data set and position."""
    out = waveforms(spark, path)
    for kind in ("phase_angle", "trigger_time", "amplitude"):
        out = out.join(vector(spark, path, kind).withColumnRenamed("value", kind), ["dataset", "pulse_id"], "left")
    return out.join(settings(spark, path).drop("slots"), "dataset", "left")


def write_waveforms(pulses: DataFrame, path: str) -> None:
    """Canonical sink: Parquet by data set; waveforms may differ in length."""
    pulses.write.partitionBy("dataset").parquet(path)


def waveform_lines(pulses: DataFrame) -> DataFrame:
    """(dataset, pulse_id, line): the text form of each waveform."""
    cells = F.transform("waveform", lambda x: F.format_string("%.10e", x))
    return pulses.select("dataset", "pulse_id", F.array_join(cells, "\t").alias("line"))


def timing(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, record_no, seconds): ``1, 16 Sep 2016 15:05:56.172 869 519 614`` as
    seconds of the day; the groups after the point are one fraction."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")
    part = lambda i: F.regexp_extract("value", r"^\s*(\d+),\s*\d+ \w+ \d+ (\d+):(\d+):(\d+)\.([\d ]+?)\s*$", i)
    seconds = part(2).try_cast("double") * 3600 + part(3).try_cast("double") * 60 + F.concat(part(4), F.lit("."), F.regexp_replace(part(5), " ", "")).try_cast("double")
    return rows.where(part(1) != "").select("file_name", part(1).cast("long").alias("record_no"), seconds.alias("seconds"))


def to_phase(seconds: Column, start: Column, ac_frequency: float = 50.0) -> Column:
    return F.pmod((seconds - start) * ac_frequency, F.lit(1.0)) * 360
