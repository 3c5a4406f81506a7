"""Connected components of links by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.runtime import materialize, row_count_up_to


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of a link (u, v) hangs together with.

    Labels spread along the links and are looked up through each other, so that the
    rounds follow the logarithm of the longest path. No links give no rows.
    """
    edges = links.select(F.col("u").alias("x"), F.col("v").alias("y"))
    edges = materialize(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    first = edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"))
    labels = materialize(first.select(F.col("x").alias("node"), "label"), "labels")
    while True:
        spread = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("seen"))
        moved = labels.join(spread, labels["node"] == spread["x"]).select("node", F.least("label", "seen").alias("to"), F.col("label").alias("old"))
        look = moved.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = materialize(moved.join(look, "to", "left").select("node", F.least("to", F.coalesce("next", F.col("to"))).alias("label"), "old"), "labels")
        if not row_count_up_to(new.where(F.col("label") != F.col("old")), 0):
            return new.select("node", "label")
        labels = new.select("node", "label")
