"""Joins that stay balanced when one key holds a large part of the rows, and lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

HOT_ROWS = 200_000      # a key with fewer rows than this is never worth splitting
HOT_KEYS = 16_384       # so many keys are listed for splitting; any other key has less than this share of the rows


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def row_hash(df: DataFrame) -> Column:
    """A number for a row that is the same when a lost task runs again: its content and its partition (equal rows of different partitions differ)."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)]
    return F.xxhash64(*plain, F.spark_partition_id())


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def rows_of_keys(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Join of many ``rows`` with ``keyed`` (one row per key, ``weight`` = rows behind that key); ``how`` is inner or left.

    NULL keys match. A key of ``hot_rows`` rows or more is cut into ceil(weight / hot_rows) pieces: a row's piece comes from its hash, and the
    key's row is copied to each piece. The HOT_KEYS heaviest keys can be cut, so the list that is sent to every task is bounded, and a key outside of it
    holds less than 1 / HOT_KEYS of all rows. No row is dropped.
    """
    hot = (keyed.where(F.col(weight) >= hot_rows).orderBy(F.col(weight).desc(), *keys).limit(HOT_KEYS)
           .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col(weight) / hot_rows).cast("bigint").alias("_pieces")))

    def flagged(df: DataFrame) -> DataFrame:
        cond = None
        for k in keys:
            part = same(df[k], F.col(f"_hot_{k}"))
            cond = part if cond is None else cond & part
        return df.join(F.broadcast(hot), cond, "left").drop(*[f"_hot_{k}" for k in keys])

    left = flagged(rows.withColumn("_row", row_hash(rows)))
    left = left.withColumn("_salt", F.when(F.col("_pieces").isNotNull(), F.pmod("_row", "_pieces")).otherwise(F.lit(0))).drop("_pieces", "_row")
    right = flagged(keyed).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys or c == "_salt" else F.col(c) for c in right.columns])
    cond = left["_salt"] == right["_r__salt"]
    for k in keys:
        cond = cond & same(left[k], right[f"_r_{k}"])
    return left.join(right, cond, how).drop("_salt", "_r__salt", *[f"_r_{k}" for k in keys])


def previous_in_key(df: DataFrame, key: str, order: str, values: list[str], run: int = 100_000) -> DataFrame:
    """Adds ``previous`` = struct of ``values`` of the row before in its key (by the integer column ``order``).

    A key is walked in runs of ``run`` order numbers, and the last row of a run is carried to the next one, so a
    key with a third of all rows is many small windows instead of one.
    """
    cut = df.withColumn("_run", F.floor(F.col(order) / run))
    inside = Window.partitionBy(key, "_run").orderBy(order)
    ends = cut.groupBy(key, "_run").agg(F.max_by(F.struct(*values), order).alias("_last"))
    carried = ends.select(key, "_run", F.lag("_last").over(Window.partitionBy(key).orderBy("_run")).alias("_carried"))
    return (cut.withColumn("_before", F.lag(F.struct(*values)).over(inside)).join(carried, [key, "_run"])
            .withColumn("previous", F.coalesce("_before", "_carried")).drop("_before", "_carried", "_run"))


def state_before(df: DataFrame, key: str, order: str, state: Column, name: str, run: int = 100_000) -> DataFrame:
    """Adds the last ``state`` that is not NULL among the rows before in the key, in the same runs as ``previous_in_key``."""
    cut = df.withColumn("_run", F.floor(F.col(order) / run)).withColumn("_s", state)
    inside = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(key, "_run").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col(order))).alias("_last"))
    carried = ends.select(key, "_run", F.last("_last", True).over(between).alias("_carried"))
    return (cut.withColumn("_before", F.last("_s", True).over(inside)).join(carried, [key, "_run"])
            .withColumn(name, F.coalesce("_before", "_carried")).drop("_before", "_carried", "_run", "_s"))


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, run: int = 100_000) -> DataFrame:
    """Adds the running sum of ``value`` within its key, in the same runs as ``previous_in_key``."""
    cut = df.withColumn("_run", F.floor(F.col(order) / run)).withColumn("_v", value.cast("bigint"))
    upto = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(key, "_run").agg(F.sum("_v").alias("_s")).select(
        key, "_run", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    return (cut.withColumn("_in", F.sum("_v").over(upto)).join(starts, [key, "_run"])
            .withColumn(name, F.col("_in") + F.col("_start")).drop("_in", "_start", "_run", "_v"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's result to the shared checkpoint folder and go on from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, read back: what is read several times is computed once and outlives executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/plumbline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
