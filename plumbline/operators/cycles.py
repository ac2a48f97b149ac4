"""Nodes on a cycle of a parent-pointer table, by pointer doubling with trimming.

Each round drops the nodes nothing points to and doubles the length of every remaining pointer. A tail of
length L is gone after about log2(L) rounds; a round that drops nothing leaves a permutation, and its
members are exactly the nodes on cycles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.skew import HOT_ROWS, cut_lineage, rows_of_keys


def pointers(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(node, jump): one parent per node. A repeated key keeps its smallest parent."""
    return (nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node"))
            .agg(F.min(parent).alias("jump")))


def _double(edges: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Follow each pointer once more; a node whose pointer leads outside is dropped."""
    pointed = edges.groupBy(F.col("jump").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    inner = edges.join(pointed.select("node"), "node", "left_semi")
    step = edges.join(pointed, "node").select(F.col("node").alias("mid"), F.col("jump").alias("next"), "weight")
    walking = inner.withColumnRenamed("jump", "mid")
    if rows < hot_rows:
        joined = walking.join(step, "mid")
    else:
        joined = rows_of_keys(walking, step, ["mid"], "weight", hot_rows=hot_rows)
    return joined.select("node", F.col("next").alias("jump"))


def cycle_nodes(nodes: DataFrame, key: str, parent: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """(node) for every node that lies on a cycle, and how many there are. Dangling parents end a chain."""
    edges = cut_lineage(pointers(nodes, key, parent).where(F.col("jump").isNotNull()))
    before, rows = -1, edges.count()
    while rows and rows != before:
        edges = cut_lineage(_double(edges, rows, hot_rows))
        before, rows = rows, edges.count()
    return edges.select("node"), rows
