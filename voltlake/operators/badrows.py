"""Rows that fail to parse: split quoted lines, validate cells against a rule table.

Parsed cells are exploded into (row, column, value), joined to the rule table, the
broken rules are aggregated per row, and the valid rows are what an anti join leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a settings line: the data set's prefix, then SG[0] to SG[17].
COLUMN_COUNT = 19
#: First reason that applies wins.
REASONS = ("quoting", "column_count", "invalid_value")
#: Rule of each SG slot that needs more than a finite number.
SLOT_RULES = {8: "whole_count", 9: "positive", 10: "positive"}

NUMBER = r"\A *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *\z"


def rule_table(spark: SparkSession, columns: int = COLUMN_COUNT) -> DataFrame:
    """One row per cell position: 0 is free text, the others are numbers."""
    rules = [(0, "text")] + [(i + 1, SLOT_RULES.get(i, "number")) for i in range(columns - 1)]
    return spark.createDataFrame(rules, "column_no int, rule string")


def split_quoted(line: Column) -> tuple[Column, Column]:
    """(whether the quoting is sound, the cells) of a tab-separated line.

    The line is cut at its quotes; parts with an odd number lie inside quotes. A sound
    line has no open quote, and each part outside begins and ends with a tab where it
    meets a quoted cell, or is empty between two quotes (a doubled quote).
    """
    plain = ~F.contains(line, F.lit('"'))
    parts = F.split(line, '"')
    last = F.size(parts) - 1
    tab = F.lit("\t")

    def outside_ok(s: Column, i: Column) -> Column:
        inside = i % 2 == 1
        starts = F.startswith(s, tab) | (i == 0)
        ends = F.endswith(s, tab) | (i == last)
        doubled = (s == "") & (i > 0) & (i < last)
        empty_edge = (s == "") & ((i == 0) | (i == last))
        return inside | doubled | empty_edge | (starts & ends)

    checks = F.transform(parts, outside_ok)
    sound = plain | ((last % 2 == 0) & F.forall(checks, lambda ok: ok))

    def escaped(s: Column, i: Column) -> Column:
        kept = F.replace(s, F.lit("%"), F.lit("%25"))
        inside = F.replace(kept, tab, F.lit("%09"))
        return F.when(i % 2 == 1, inside).when((s == "") & (i > 0) & (i < last), F.lit('"')).otherwise(kept)

    joined = F.array_join(F.transform(parts, escaped), "")
    restored = F.transform(F.split(joined, tab), lambda c: F.replace(F.replace(c, F.lit("%09"), tab), F.lit("%25"), F.lit("%")))
    return sound, F.when(plain, F.split(line, tab)).otherwise(restored)


def parsed_lines(lines: DataFrame, key: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """Adds ``sound`` and ``cells``; one carriage return at the end is not part of a line."""
    body = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\r\z", "")
    with_body = lines.withColumn("_body", body)
    sound, cells = split_quoted(F.col("_body"))
    return with_body.withColumn("sound", sound).withColumn("cells", cells).drop("_body")


def cell_ok(value: Column, rule: Column) -> Column:
    number = F.when(value.rlike(NUMBER), F.trim(value).cast("double"))
    is_finite = number.isNotNull() & (F.abs(number) < F.lit(float("inf")))
    return (
        F.when(rule == "text", F.lit(True))
        .when(~is_finite, F.lit(False))
        .when(rule == "positive", number > 0)
        .when(rule == "whole_count", (number >= 0) & (number == F.floor(number)))
        .otherwise(F.lit(True))
    )


def rejected_lines(parsed: DataFrame, key: str = "line_id", columns: int = COLUMN_COUNT) -> DataFrame:
    """(key, reason) of the invalid lines, each once, with the first reason that applies.

    A null or empty line has one cell and so a wrong column count. Lines given twice
    count once; if copies of a key differ, the first reason of any of them holds.
    """
    rules = F.broadcast(rule_table(parsed.sparkSession, columns))  # one row per column of the format
    shape = F.when(~F.col("sound"), F.lit(0)).when(F.size("cells") != columns, F.lit(1))
    broken_shape = parsed.select(key, shape.alias("_rank")).where(F.col("_rank").isNotNull())
    cells = parsed.where(F.col("sound") & (F.size("cells") == columns)).select(
        key, F.posexplode("cells").alias("column_no", "value")
    )
    broken_cells = (
        cells.join(rules, "column_no").where(~cell_ok(F.col("value"), F.col("rule"))).select(key, F.lit(2).alias("_rank"))
    )
    names = F.array(*[F.lit(r) for r in REASONS])
    return (
        broken_shape.unionByName(broken_cells)
        .groupBy(key)
        .agg(F.min("_rank").alias("_rank"))
        .select(key, F.get(names, F.col("_rank")).alias("reason"))
    )


def valid_settings(parsed: DataFrame, rejected: DataFrame, key: str = "line_id", columns: int = COLUMN_COUNT) -> DataFrame:
    """The clean lines as typed columns: ``prefix``, ``sg_0`` ... ``sg_17`` (doubles)."""
    clean = parsed.dropDuplicates([key]).join(rejected.select(key), key, "left_anti")
    slots = [F.trim(F.get("cells", F.lit(i + 1))).try_cast("double").alias(f"sg_{i}") for i in range(columns - 1)]
    return clean.select(key, F.get("cells", F.lit(0)).alias("prefix"), *slots)
