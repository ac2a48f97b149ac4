"""Profile whole tables: one row per column, assembled from a handful of jobs per table."""
from __future__ import annotations

import datetime as dt
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import vocab
from plumbline.functions import text
from plumbline.functions.skew import written
from plumbline.model import Constraints
from plumbline.operators import profiling as p
from plumbline.sources.inventory import generic_type

_SENSITIVE = re.compile(vocab.SENSITIVE_NAME, re.IGNORECASE)
PROFILE = """
table string, column string, ordinal int, generic_type string, native_type string, is_primary_key boolean,
row_count bigint, null_count bigint, null_rate double, distinct_count bigint, uniqueness double, is_constant boolean,
sensitive_hint boolean, detected_format struct<format:string,match_rate:double>,
top_values array<struct<value:string,count:bigint,share:double>>,
patterns array<struct<pattern:string,count:bigint,share:double>>, pattern_mode string, examples array<string>,
text struct<min_length:int,avg_length:double,max_length:int,blank_count:bigint,untrimmed_count:bigint,
            upper_count:bigint,lower_count:bigint,mixed_case_count:bigint>,
numeric struct<min:double,max:double,zero_count:bigint,negative_count:bigint,mean:double,std:double,p01:double,p05:double,
               median:double,p95:double,p99:double,outlier_lo:double,outlier_hi:double,outlier_count:bigint>,
date struct<min:string,max:string,future_count:bigint,placeholder_count:bigint,unparseable_count:bigint>,
boolean struct<true_count:bigint,false_count:bigint,invalid_values:array<string>>
"""
_TEXT = ("min_length", "avg_length", "max_length", "blank_count", "untrimmed_count", "upper_count", "lower_count",
         "mixed_case_count")
_NUMERIC = ("min", "max", "zero_count", "negative_count", "mean", "std", "p01", "p05", "median", "p95", "p99",
            "outlier_lo", "outlier_hi", "outlier_count")
_DATE = ("min", "max", "future_count", "placeholder_count", "unparseable_count")


def _by_column(df: DataFrame) -> dict[str, dict]:
    return {r["column"]: r.asDict() for r in df.collect()}


def profile_table(df: DataFrame, table: str, as_of: dt.date, constraints: Constraints = Constraints(),
                  text_dates: tuple[str, ...] = (), at_once: int = 4, kept: dict[tuple[str, str], DataFrame] | None = None) -> list[tuple]:
    """Rows of PROFILE for one table. ``text_dates`` are text columns that are meant to hold dates.

    A column's values are counted and stored once; facts, quantiles, top values and patterns read these. ``kept`` collects them by
    (table, column) for who comes after. Only numbers per column reach the driver: at most 50 values and 10 patterns of a column are kept.
    """
    kinds = {f.name: generic_type(f.dataType) for f in df.schema.fields}
    kinds |= {c: "date" for c in text_dates if c in kinds}
    dates = [c for c, k in kinds.items() if k in vocab.DATE_GENERIC]
    numbers = [c for c, k in kinds.items() if k in vocab.NUMERIC_GENERIC]
    words = [c for c, k in kinds.items() if k == "string"]

    counted: dict[str, DataFrame] = {}

    def facts_of(c: str) -> dict:
        grouped = p.can_be_grouped(df, c)
        n = p.count_name(c) if grouped else None
        measures = (p.null_measures(c, n) | (p.distinct_measures(c) if grouped else {})
                    | (p.numeric_measures(c, n) if c in numbers else {}) | (p.date_measures(df, c, as_of, n) if c in dates else {})
                    | (p.text_measures(c, n) | p.format_measures(c, n) if c in words else {}))
        rows = df
        if grouped:
            rows = counted[c] = p.stored_values(df, c)
        return rows.selectExpr(*[f"{e} AS `{name}`" for name, e in measures.items()]).first().asDict()

    with ThreadPoolExecutor(at_once) as pool:       # a column's job reads that column only
        facts = dict(zip(df.columns, pool.map(facts_of, df.columns)))
    if kept is not None:
        kept.update({(table, c): values for c, values in counted.items()})
    distinct = {c: fact for c, fact in facts.items() if "distinct_count" in fact}
    shape = _by_column(p.numeric_shape(df, table, numbers, counted=counted)) if numbers else {}

    sensitive = {c: bool(_SENSITIVE.search(c)) or facts[c].get("format") in vocab.SENSITIVE_FORMATS for c in df.columns}
    top: dict[str, list] = {}
    few = [c for c in df.columns if not sensitive[c] and c in distinct and distinct[c]["distinct_count"] <= vocab.TOP_VALUES]
    if few:
        for r in p.top_values(df, table, few, known_few=True, counted=counted).orderBy("column", "rank").collect():
            top.setdefault(r["column"], []).append((r["value"], r["count"], r["share"]))
    seen: dict[str, list] = {}
    if words:
        found = written(p.shapes(df, table, words, with_example=True, counted=counted), "shapes")      # read four times below
        for r in p.patterns(found).withColumn("masked", F.expr(text.mask("example"))).orderBy("column", "rank").collect():
            seen.setdefault(r["column"], []).append(r)

    rows = []
    pk = constraints.pk(table)
    for i, f in enumerate(df.schema.fields, 1):
        c, fact, d = f.name, facts[f.name], distinct.get(f.name)
        total, nulls = fact["row_count"], fact["null_count"]
        n_distinct = d["distinct_count"] if d else None
        shown = seen.get(c, [])
        flags = None
        if kinds[c] == "boolean" and top.get(c):
            known = [(str(v).lower(), n) for v, n, _ in top[c] if v is not None]
            flags = (sum(n for v, n in known if v in vocab.TRUE_WORDS), sum(n for v, n in known if v in vocab.FALSE_WORDS), [])
        rows.append((
            table, c, i, kinds[c], f.dataType.simpleString(), c in pk, total, nulls, round(nulls / total, 6) if total else 0.0,
            n_distinct, round(n_distinct / (total - nulls), 6) if d and total > nulls else None, n_distinct == 1, sensitive[c],
            (fact["format"], fact["match_rate"]) if fact.get("format") else None, top.get(c),
            [(r["pattern"], r["count"], r["share"]) for r in shown] or None, shown[0]["mode"] if shown else None,
            [r["masked"] if sensitive[c] else r["example"] for r in shown[:3]],
            tuple(fact[k] for k in _TEXT) if c in words and total > nulls else None,
            tuple((fact | shape[c])[k] for k in _NUMERIC) if c in numbers else None,
            tuple(fact[k] for k in _DATE) if c in dates else None, flags))
    return rows


def profile_tables(tables: dict[str, DataFrame], as_of: dt.date, constraints: Constraints = Constraints(),
                   text_dates: dict[str, tuple[str, ...]] | None = None, at_once: int = 4,
                   kept: dict[tuple[str, str], DataFrame] | None = None) -> DataFrame:
    """One PROFILE row per column of every table. Tables are profiled side by side: their jobs fill the cluster."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(profile_table, df, name, as_of, constraints, (text_dates or {}).get(name, ()), kept=kept)
                for name, df in sorted(tables.items())]
        rows = [r for j in jobs for r in j.result()]
    return spark.createDataFrame(rows, PROFILE)


def signals(profiles: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """(table, column, signal, detail) for everything suspicious a profile shows."""
    rare = f"filter(top_values, v -> v.value IS NOT NULL AND v.share < {vocab.RARE_SHARE})"
    dominant = f"aggregate(filter(top_values, v -> v.share >= {vocab.RARE_SHARE}), 0D, (s, v) -> s + v.share)"
    minority = f"filter(slice(patterns, 2, {vocab.TOP_PATTERNS}), p -> p.share < {vocab.RARE_SHARE})"
    signs = (
        ("nulls", "null_count > 0", "null_count"),
        ("near_unique", f"uniqueness >= {vocab.NEAR_UNIQUE} AND uniqueness < 1", "uniqueness"),
        ("rare_values", f"size(top_values) > 1 AND size({rare}) > 0 AND {dominant} >= {vocab.DOMINANT_SHARE}",
         f"array_join(transform(slice({rare}, 1, 6), v -> v.value), ',')"),
        ("minority_patterns", f"size(patterns) > 1 AND size({minority}) > 0",
         f"array_join(transform(slice({minority}, 1, 4), p -> p.pattern), ',')"),
        ("format_mismatch", "detected_format.match_rate < 1", "detected_format.match_rate"),
        ("negatives", "numeric.negative_count > 0", "numeric.negative_count"),
        ("zeros", "numeric.zero_count > 0", "numeric.zero_count"),
        ("outliers", "numeric.outlier_count > 0", "numeric.outlier_count"),
        ("placeholders", "date.placeholder_count > 0", "date.placeholder_count"),
        ("future_dates", "date.future_count > 0", "date.future_count"))
    found = F.expr("array_compact(array(" + ", ".join(
        f"CASE WHEN {when} THEN struct('{name}' AS signal, CAST({detail} AS STRING) AS detail) END" for name, when, detail in signs) + "))")
    out = profiles.select("table", "column", F.inline(found))
    if orphans is None:
        return out
    lost = (orphans.where(F.col("orphans") > 0).select(
        "table", F.explode(F.split("columns", ",")).alias("column"), F.lit("orphans").alias("signal"),
        F.concat(F.col("orphans").cast("string"), F.lit(" -> "), F.col("ref_table")).alias("detail")))
    return out.unionByName(lost)


def summary(profiles: DataFrame, orphans: DataFrame) -> DataFrame:
    """(table, row_count, columns, columns_with_nulls, sensitive_columns, fk_orphans) per table."""
    per_table = profiles.groupBy("table").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
        F.count_if("sensitive_hint").alias("sensitive_columns"))
    links = orphans.groupBy("table").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("columns", F.lit("="), F.col("orphans").cast("string")))), ", ").alias("fk_orphans"))
    return (per_table.join(links, "table", "left").withColumn("fk_orphans", F.coalesce("fk_orphans", F.lit("-")))
            .withColumn("sample", F.concat(F.col("row_count").cast("string"), F.lit(" full"))))
