"""Types that the names of data sets tell, and a summary of the labelled data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of each type, tried in this order on the name in lower case.
PATTERNS = (
    ("SURFACE", ("surface", "tracking", "surf_pd")),
    ("CORONA", ("corona", "needle", r"point[\s_-]?plane", r"grounded[\s_-]?needle", r"grounded[\s_-]?plane")),
    ("INTERNAL", ("internal", "void", "cavity", r"in[\s_-]?oil", r"in[\s_-]?solid", "oil", "solid")),
    ("NOISE", ("noise", "background", r"no[\s_-]?pd")),
)

Patterns = Sequence[tuple[str, Sequence[str]]]


def label_of(name: Column, patterns: Patterns = PATTERNS, other: str | None = "UNKNOWN") -> Column:
    """The first type with a pattern that the name holds; ``other`` for a null name or one
    that holds none. Other patterns than the fixed ones may be given."""
    out = F.lit(other).cast("string")
    for kind, several in reversed(list(patterns)):
        out = F.when(F.lower(name).rlike("|".join(several)), kind).otherwise(out)
    return out


def labelled(sets: DataFrame, name: str, wanted: Sequence[str] = (), patterns: Patterns = PATTERNS) -> DataFrame:
    """The data sets whose name tells a type, with their ``label``; of the ``wanted`` types
    only, if any are given. A column named label is replaced."""
    got = sets.withColumn("label", label_of(F.col(name), patterns, None)).where(F.col("label").isNotNull())
    return got.where(F.col("label").isin(list(wanted))) if wanted else got
