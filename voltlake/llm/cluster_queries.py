"""Queries that group pulses into discharge sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import similarity
from voltlake.plans import discharge
from voltlake.runtime import materialize

LIKE = similarity.Likeness("acquisition_id", "pulse_key", "phase_angle", ("absolute_amplitude", "rise_time", "dominant_frequency"))


def _grid(spark: SparkSession, sf_dir: str) -> similarity.Grid:
    """The pulses whose amplitude has no fault of p5_found, on the grid."""
    extra = ("phase_angle", "rise_time", "dominant_frequency")
    flagged = discharge.flagged_pulses(spark, sf_dir, (discharge.AMPLITUDE,), extra, fitted=False)
    sound = flagged.where(F.col("fault_absolute_amplitude").isNull())
    return similarity.on_grid(sound, LIKE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses of clusters of ten or more that hang together through alike pulses."""
    return similarity.connected_groups(_grid(spark, sf_dir))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pivot cluster with its size, centre and most typical pulses."""
    grid = _grid(spark, sf_dir)
    members = materialize(similarity.pivot_members(grid, similarity.all_links(grid)), "members")
    found = similarity.described(grid, members)
    rounded = [F.format_string("%.6e", c).cast("double").alias(c) for c in (LIKE.circular, *LIKE.ratios)]
    return found.select("acquisition_id", "size", *rounded, F.col("typical")[0].alias("medoid"), F.array_join(F.transform("typical", lambda k: k.cast("string")), ",").alias("typical"))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters}
SQL: dict[str, str] = {}
