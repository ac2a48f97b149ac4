"""Intermediate tables that survive lost executors: Parquet in the cluster's shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only on a local master (tests), where one machine holds everything."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: later uses neither recompute it nor depend on its shuffle files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` is called so (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Most ids that are sent to every executor: 16 MB of longs.
IDS_SENT = 2_000_000


def rows_with(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids`` (one column of distinct longs). Up to IDS_SENT ids are counted and broadcast, so that the
    wide rows stay in place; beyond, both sides are shuffled."""
    name = "__wanted"
    ids = stored(ids.toDF(name), "ids")
    if ids.count() <= IDS_SENT:
        ids = F.broadcast(ids)
    return df.join(ids, df[key] == ids[name], "left_semi")


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` judged on the finished columns. A plain filter would be pushed below the projections that make them, with
    every array expression copied into the lambdas that read it; a row number in the same projection keeps the filter above."""
    number = free_name(df, "__number")
    return df.withColumn(number, F.monotonically_increasing_id()).where(condition & (F.col(number) >= 0)).drop(number)


def smallest(df: DataFrame, draw: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the smallest ``draw``, a hash of 64 bits. Rows are counted first and only about 2 n of them, below a threshold, are
    sorted: without it every task would send n rows of its own. (That fewer than n of 2 n expected rows pass is as unlikely as exp(-0.3 n).)"""
    rows = df.count()
    if rows > 2 * n:
        df = df.where(draw < F.lit(int(2 * n / rows * 2.0 ** 64) - 2 ** 63))
    return df.orderBy(draw, *ties).limit(n)
