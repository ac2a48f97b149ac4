"""What a source consists of: tables, columns, types, declared keys, row counts, identity."""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.model import Constraints

INVENTORY = ("table string, column string, ordinal int, native_type string, generic_type string, nullable boolean, "
             "is_primary_key boolean, max_length int, precision int, scale int, comment string")


def generic_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.DateType):
        return "date"
    if type(kind).__name__ == "TimeType":
        return "time"
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return "json"
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "other"


def open_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Read-only scans by table name. Any Spark source works; for fmt='jdbc' the path is the table's name and the
    options carry url, partitionColumn, lowerBound, upperBound and numPartitions."""
    tables = {}
    for name, path in sorted(paths.items()):
        reader = spark.read.format(fmt).options(**options)
        tables[name] = reader.option("dbtable", path) if fmt == "jdbc" else reader
        try:
            tables[name] = tables[name].load() if fmt == "jdbc" else tables[name].load(path)
        except Exception as e:  # noqa: BLE001 - each source raises its own error
            raise ConnectionError(f"could not read table '{name}' at '{path}': {str(e).splitlines()[0]}") from e
    return tables


def columns_of(table: str, df: DataFrame, constraints: Constraints) -> list[tuple]:
    pk = set(constraints.pk(table))
    rows = []
    for i, f in enumerate(df.schema.fields, 1):
        kind = f.dataType
        length = kind.length if isinstance(kind, (T.VarcharType, T.CharType)) else None
        decimal = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (None, None)
        rows.append((table, f.name, i, kind.simpleString(), generic_type(kind), f.nullable and f.name not in pk,
                     f.name in pk, length, *decimal, f.metadata.get("comment")))
    return rows


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count): a count reads no column data."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def schema_inventory(tables: dict[str, DataFrame], constraints: Constraints, with_counts: bool = True) -> DataFrame:
    """One row per column in table and column order, with declared keys and (optionally) the table's row count."""
    spark = next(iter(tables.values())).sparkSession
    rows = [r for name in sorted(tables) for r in columns_of(name, tables[name], constraints)]
    inventory = spark.createDataFrame(rows, INVENTORY)
    keys = foreign_keys(spark, constraints).where(F.size("columns") == 1).select(
        "table", F.col("columns")[0].alias("column"), F.col("ref_table").alias("references"),
        "self_reference").dropDuplicates(["table", "column"])
    single = {(t, c[0]) for t, c in constraints.unique if len(c) == 1}
    unique = F.lit(False)
    for t, c in sorted(single):
        unique = unique | ((F.col("table") == t) & (F.col("column") == c))
    out = inventory.join(F.broadcast(keys), ["table", "column"], "left").withColumn("is_unique", unique)
    return out.join(row_counts(tables), "table") if with_counts else out


def foreign_keys(spark: SparkSession, constraints: Constraints) -> DataFrame:
    rows = [(t, list(c), rt, list(rc), t == rt) for t, c, rt, rc in constraints.foreign_keys]
    return spark.createDataFrame(
        rows, "table string, columns array<string>, ref_table string, ref_columns array<string>, self_reference boolean")


def source_id(fmt: str, database: str, host: str = "", port: str = "", schema: str = "") -> str:
    """Stable id of a source. Who connects is left out, so two users see the same source."""
    parts = (fmt, host.lower(), str(port or ""), database.lower(), schema.lower())
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def structure_hash(inventory: DataFrame, keys: DataFrame, per_table: bool = False) -> DataFrame:
    """([table,] structure_hash): moves with tables, columns, types and keys, never with data."""
    described = inventory.select("table", F.concat_ws(
        "|", F.lit("column"), "table", F.lpad(F.col("ordinal").cast("string"), 6, "0"), "column", "native_type",
        F.col("nullable").cast("string"), F.col("is_primary_key").cast("string")).alias("line"))
    linked = keys.select("table", F.concat_ws("|", F.lit("fk"), "table", F.array_join("columns", ","), "ref_table").alias("line"))
    return described.unionByName(linked).groupBy(*(["table"] if per_table else [])).agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("structure_hash"))


def hash_sample(df: DataFrame, key: list[str], limit: int, seed: int = 42, row_count: int | None = None) -> DataFrame:
    """A repeatable sample of at most ``limit`` rows with the method used ('full' or 'random').

    Rows are taken in hash order of their key: a per-task top-k and one merge, no full sort.
    """
    rows = df.count() if row_count is None else row_count
    if rows <= limit:
        return df.withColumn("sample_method", F.lit("full"))
    order = F.xxhash64(F.lit(seed), *key)
    return df.orderBy(order, *key).limit(limit).withColumn("sample_method", F.lit("random"))
