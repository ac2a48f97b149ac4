"""Sinks and the reads that belong to them: snapshots, model versions, rule documents.

All stores are append-only folders of parquet; the current state is an aggregate over what was appended. Model versions are committed
by a manifest each, so that writers may meet.
"""
from __future__ import annotations

import json
import os
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from plumbline.functions.skew import previous_in_key, running_sum


def latest(df: DataFrame, keys: list[str], order: str, tie: str | None = None) -> DataFrame:
    """The newest row per key, as a partial aggregate: no window, so a busy key stays one row per task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(order, tie) if tie else F.col(order)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, "row.*")


def save_snapshot(profiles: DataFrame, path: str, source_id: str, created_at: Column, structure: str) -> None:
    (profiles.withColumns({"source_id": F.lit(source_id), "created_at": created_at, "structure_hash": F.lit(structure)})
     .write.mode("append").partitionBy("source_id").parquet(path))


def latest_snapshot(snapshots: DataFrame, profiled_only: bool = True) -> DataFrame:
    """Newest snapshot row per source; only profiled ones unless asked otherwise."""
    found = snapshots.where(F.col("profiled_at").isNotNull()) if profiled_only else snapshots
    return latest(found, ["source_id"], "created_at", "snapshot_id")


def content_hash(df: DataFrame) -> str:
    """Hash of a table's rows in any order, duplicates included. Bookkeeping columns must be left out before."""
    line = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(line).alias("x"),
                 F.sum(line.cast("decimal(20,0)")).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


_MANIFEST = "source_id string, version int, content string, created_by string, files string"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, version, content, created_by, files): the committed versions of all sources, one small file each."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests/*/")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _head(spark: SparkSession, path: str, source_id: str) -> Row | None:
    mine = versions(spark, path).where(F.col("source_id") == source_id)
    return mine.agg(F.max_by(F.struct("version", "content", "files"), "version").alias("h")).first()["h"]


def save_if_changed(model: DataFrame, path: str, source_id: str, created_by: str = "engine") -> tuple[int, bool]:
    """Store a model as the version after the last, unless that one has the same content. (version, saved).

    The rows are written aside; a version exists once its manifest does, which is created whole and never replaced. A writer who
    finds the number taken looks at what the other one wrote and goes on from there, so each number has one writer and readers
    never see half a version. Files of a writer that died are in nobody's manifest.
    """
    spark = model.sparkSession
    digest = content_hash(model)
    head = _head(spark, path, source_id)
    if head is not None and head["content"] == digest:
        return head["version"], False
    files = f"files/{uuid.uuid4().hex}"
    model.write.parquet(f"{path}/{files}")
    while True:
        version = (head["version"] if head is not None else 0) + 1
        manifest = {"source_id": source_id, "version": version, "content": digest, "created_by": created_by, "files": files}
        if _create(spark, f"{path}/manifests/{quote(source_id, safe='')}", f"{version:09d}.json", json.dumps(manifest)):
            return version, True
        head = _head(spark, path, source_id)
        if head["content"] == digest:
            return head["version"], False


def read_model(spark: SparkSession, path: str, source_id: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, the last one unless it is named; None where there is none."""
    if version is None:
        found = _head(spark, path, source_id)
    else:
        found = versions(spark, path).where((F.col("source_id") == source_id) & (F.col("version") == version)).first()
    return None if found is None else spark.read.parquet(f"{path}/{found['files']}")


def _create(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Make a file with all its content, or leave the one that has this name and say False.

    Written under a hidden name first. On a cluster's file system a rename that may not replace decides who is first, on local disks a link.
    Stores whose rename is a copy cannot decide it.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    aside, target = fs.Path(f"{folder}/_{uuid.uuid4().hex}"), fs.Path(f"{folder}/{name}")
    system = target.getFileSystem(conf)
    system.mkdirs(fs.Path(folder))
    out = system.create(aside, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if system.getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        else:
            _rename_new(spark, aside, target)
        return True
    except FileExistsError:
        return False
    finally:
        system.delete(aside, False)


def _rename_new(spark: SparkSession, aside, target) -> None:
    """FileExistsError where the target is there already."""
    option = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    plain = spark.sparkContext._gateway.new_array(option, 1)
    plain[0] = option.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, plain)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        raise FileExistsError(str(target)) from e


def version_history(changes: DataFrame) -> DataFrame:
    """Version of each save of (source_id, saved_at, content): equal content right after itself is no version."""
    seen = previous_in_key(changes, "source_id", "saved_at", ["content"])
    saved = seen.withColumn("saved", F.coalesce(F.col("previous.content") != F.col("content"), F.lit(True))).drop("previous")
    return running_sum(saved, "source_id", "saved_at", F.col("saved").cast("int"), "version")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(seq, rule) from JSON documents: a list, {"rules": [...]}, {"rules": [{"rule": {...}}]}, one rule, or one rule per line, which is
    what ``write_rules`` writes. ``seq`` goes on from file to file, in the order of their names."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    lines = F.filter(F.transform(F.split("value", "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")
    by_line = (F.size(lines) > 0) & F.forall(lines, lambda x: F.get_json_object(x, "$.check").isNotNull() | F.get_json_object(x, "$.rule").isNotNull())
    one = F.when(F.get_json_object("value", "$.check").isNotNull() | F.get_json_object("value", "$.rule").isNotNull(), F.array("value"))
    listed = F.coalesce(F.from_json("value", "struct<rules:array<string>>")["rules"], F.from_json("value", "array<string>"))
    items = docs.select("file", F.when(by_line, lines).otherwise(F.coalesce(listed, one, F.expr("CAST(array() AS array<string>)"))).alias("items"))
    # one row per file here, so this window holds a number for each file only
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = items.select("file", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)).alias("start"))
    return (items.join(starts, "file").select("start", F.posexplode("items").alias("at", "item"))
            .select((F.col("start") + F.col("at")).cast("int").alias("seq"), F.coalesce(F.get_json_object("item", "$.rule"), F.col("item")).alias("rule")))


def write_rules(rules: DataFrame, path: str) -> None:
    """One JSON object per line; ``rules`` has a column ``rule`` with the JSON text."""
    rules.select(F.regexp_replace("rule", "[\\r\\n]+", " ").alias("value")).write.mode("append").text(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("append").json(path)
