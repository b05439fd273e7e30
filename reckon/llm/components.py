"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node of its component.

    Every round takes the smallest label among neighbours and then the label's label; rounds are written to the
    shared checkpoint folder. Nothing is gathered; a node with very many edges is only a skewed join key.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("parent"), F.col("label").alias("top"))
        after = cut(step.join(up, step.label == up.parent, "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
