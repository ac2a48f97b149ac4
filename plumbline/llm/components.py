"""Connected components of an edge table, as joins and grouped minima; nothing but row counts reaches the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): the smallest node that can be reached, for every node that has an edge.

    Each round every node takes the smallest label around it, then the label of its label (pointer jumping), until no label changes:
    a star takes two rounds, a chain about the logarithm of its length times a small factor. A hub's messages are minima, combined before the shuffle."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        met = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        of_label = labels.select(F.col("node").alias("l"), F.col("label").alias("jump"))
        new = stored(met.join(of_label, met["label"] == of_label["l"], "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
