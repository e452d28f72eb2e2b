"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of a link with the smallest node it is linked with, however far away.

    Each round a node takes the smallest label around it and then the label of that label, so distances shrink by
    doubling. Rounds stop when no label changes. Links may repeat, come in either direction or join a node to itself.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut_lineage(ends.union(ends.select("other", "node")).distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(
            F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut_lineage(near.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("label != old").isEmpty():
            return labels
