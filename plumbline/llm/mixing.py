"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled (hash) order, read up to ``most_epochs`` times. A copy's virtual finish time is
the words its source has sent up to and including it, divided by the source's target. All copies are range-sorted by finish time
over the cluster and the line is cut where the running total reaches the budget. Because every queue sends its target in one unit of
virtual time, each source gets its target up to half a document.

Only narrow rows (source, shuffle key, size) are sorted; running totals are taken in buckets of the shuffle key and in the range
partitions, so a source with a third of the rows is spread like all others. The cut is one point per source (the last copy
taken), which is joined back to the documents.

NULL and empty texts have size 0: such a document is taken where its place in the queue is. A NULL source is a source, last in order.
Rows with the same source and shuffle key (repeated rows) share a finish time and are taken together. An empty table gives an empty
mix. Columns of ``docs`` pass through; a clashing column is an error.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .text import WORD

EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rotating_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... to sources in code point order, NULL last. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))


def targets(sources: DataFrame, most_epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> with ``target``: all sizes shared by weight, none above ``most_epochs`` times its size.

    Resharing the excess until no target is above its limit has one fixed point, min(limit, level * weight). Sources in order of
    limit / weight reach their limit first; the level that the first source below its limit sees is the one (later ones see less)."""
    limit = F.col("source_size") * F.lit(float(most_epochs))
    order = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(limit / F.col("weight") > rest / left, rest / left)
    with_level = sources.withColumn("__level", level)
    return with_level.withColumn("target", F.least(limit, F.coalesce(F.max("__level").over(whole), F.lit(math.inf)) * F.col("weight"))).drop("__level")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.withColumns({"__key": F.xxhash64(F.col(doc_id), F.col(source), F.col(text)), "__size": n_words(F.col(text))})


def queue_cuts(sized: DataFrame, weights=rotating_weights, most_epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, and the last copy taken as (last_epoch, last_key); NULL where none is.

    ``sized``: source, __key, __size of every document."""
    rows = sized.groupBy("source", "__key").agg(F.sum("__size").alias("size"))
    n, sources = sized.count(), targets(weights(sized.groupBy("source").agg(F.sum("__size").alias("source_size"))), most_epochs)
    sources = stored(sources, "mix-sources")
    bits = max(0, min(16, int(math.log2(max(n, 1) / 256)) if n > 256 else 0))
    bucket = F.shiftright(F.col("__key"), 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("sent_before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    sent = rows.withColumn("sent", F.sum("size").over(inside))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("source", "bucket")]
    sent = sent.alias("a").join(sums.alias("b"), same).select("a.source", "a.__key", "a.size", (F.col("a.sent") + F.col("b.sent_before")).alias("sent"))
    s = sources.alias("s")
    copies = (sent.alias("a").join(s, F.col("a.source").eqNullSafe(F.col("s.source"))).where("s.target > 0")
              .select("a.source", "a.__key", "a.size", "a.sent", "s.source_size", "s.target", F.explode(F.sequence(F.lit(0), F.lit(most_epochs - 1))).alias("epoch"))
              .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("sent")) / F.col("target")))
    line = ["finish", "source", "epoch", "__key"]
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = copies.select(*line, "size").repartitionByRange(parts, *line).withColumn("part", F.spark_partition_id())
    placed = stored(placed, "mix-line")
    part_sums = placed.groupBy("part").agg(F.sum("size").alias("part_size"))
    part_sums = part_sums.withColumn("before", F.coalesce(F.sum("part_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("budget"))
    # (at most one row per range partition)
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0))
    total = placed.withColumn("running", running).join(F.broadcast(part_sums.select("part", "before")), "part")
    spent = float(budget.first()["budget"])
    # up to time 1 the running total cannot pass the budget; later copies would fill the room that a long document leaves with another source's words
    taken = (F.col("before") + F.col("running") <= F.lit(spent * (1 + 1e-12))) & (F.col("finish") <= F.lit(1 + 1e-12))
    copy = F.struct("epoch", "__key", "size")
    ends = total.groupBy("source").agg(F.max(F.when(taken, copy)).alias("last"), F.min(F.when(~taken, copy)).alias("next"), F.coalesce(F.sum(F.when(taken, F.col("size"))), F.lit(0)).alias("sent"))
    # a source whose next copy would bring it nearer to its target gets it: no source is further off than half a document
    nearer = (2 * (F.col("s.target") - F.col("l.sent")) > F.col("l.next.size")) & (F.col("l.next.size") > 0)
    last = F.when(nearer, F.col("l.next")).otherwise(F.col("l.last"))
    return (s.join(ends.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
            .select("s.source", "s.source_size", "s.target", last["epoch"].alias("last_epoch"), last["__key"].alias("last_key")))


def _copies(most_epochs: int) -> Column:
    """How often a document is taken: once per whole epoch, once more when it stands before the source's cut."""
    return F.coalesce(F.col("c.last_epoch") + F.when(F.col("d.__key") <= F.col("c.last_key"), 1).otherwise(0), F.lit(0)).cast("long")


def mix_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=rotating_weights, most_epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies."""
    narrow = stored(_sized(docs, doc_id, text, source).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), "__key", "__size"), "mix-sizes")
    cuts = queue_cuts(narrow.select("source", "__key", "__size"), weights, most_epochs)
    return (narrow.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
            .select("d.doc_id", F.col("d.source").alias("source"), F.col("d.__size").alias("size"), "c.source_size", "c.target", _copies(most_epochs).alias("copies")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=rotating_weights, most_epochs: int = EPOCHS) -> DataFrame:
    """The mixed documents with their own columns: a document taken twice comes twice. The texts are read in place and not shuffled."""
    sized = _sized(docs, doc_id, text, source)
    narrow = stored(sized.select(F.col(source).alias("source"), "__key", "__size"), "mix-sizes")
    cuts = queue_cuts(narrow, weights, most_epochs)
    keyed = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(source), F.col(text)))
    found = keyed.alias("d").join(cuts.alias("c"), F.col(f"d.{source}").eqNullSafe(F.col("c.source")))
    found = found.withColumn("__copies", _copies(most_epochs)).where("__copies > 0")
    return found.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")).drop("__copy")
