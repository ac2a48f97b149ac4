"""Column statistics. Every family is a set of aggregate expressions over rows, or over (value, n) of one column.

A column's values are counted first where its distinct count is wanted too: one shuffle of that column alone, and patterns are
matched once per value. All columns in one distinct aggregate would copy every row once per column.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline import vocab
from plumbline.functions import text
from plumbline.functions.text import ident, q
from plumbline.functions.quantiles import DIRECT_VALUES, exact_quantiles
from plumbline.functions.skew import written
from plumbline.model import Constraints
from plumbline.sources.inventory import generic_type

def union(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if generic_type(f.dataType) in kinds]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, *vocab.NUMERIC_GENERIC)


def per_column(df: DataFrame, table: str, measures: dict[str, dict[str, str]]) -> DataFrame:
    """One aggregate over the table, unfolded to one row (table, column, measures...) per column."""
    one = df.selectExpr(*[f"{e} AS `{i}_{name}`" for i, m in enumerate(measures.values()) for name, e in m.items()])
    rows = ", ".join(f"struct({q(table)} AS table, {q(c)} AS column, " + ", ".join(f"`{i}_{name}` AS {name}" for name in m) + ")"
                     for i, (c, m) in enumerate(measures.items()))
    return one.selectExpr(f"inline(array({rows}))")


# ---- measures of one column: name -> SQL aggregate ------------------------------------------------
# ``n``: name of a column that says how often a row's value occurs; None when every row counts once.
def _count_if(test: str, n: str | None) -> str:
    return f"count_if({test})" if n is None else f"coalesce(sum(CASE WHEN {test} THEN {n} END), 0L)"


def _mean(number: str, c: str, n: str | None) -> str:
    """``number`` is NULL where the column ``c`` is, and nowhere else."""
    return f"avg({number})" if n is None else f"try_divide(sum(CAST({number} AS BIGINT) * {n}), sum(CASE WHEN {c} IS NOT NULL THEN {n} END))"


def null_measures(name: str, n: str | None = None) -> dict[str, str]:
    if n is None:
        return {"row_count": "count(1)", "null_count": f"count(1) - count({ident(name)})"}
    return {"row_count": f"coalesce(sum({n}), 0L)", "null_count": _count_if(f"{ident(name)} IS NULL", n)}


def numeric_measures(name: str, n: str | None = None) -> dict[str, str]:
    c = text.missing_nan(ident(name))
    return {"min": f"min({c})", "max": f"max({c})", "zero_count": _count_if(f"{c} = 0", n), "negative_count": _count_if(f"{c} < 0", n)}


def spread_measures(name: str) -> dict[str, str]:
    c = text.missing_nan(ident(name))
    return {"mean": f"round(avg({c}), 4)", "std": f"round(stddev_samp({c}), 4)"}


def date_measures(df: DataFrame, name: str, as_of: dt.date, n: str | None = None) -> dict[str, str]:
    """Dates as text too: a text value counts as a date of the future only if it starts with a year."""
    c = ident(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        day = f"substring({c}, 1, 10)"
        future = f"{c} > '{as_of}' AND substring({c}, 1, 4) BETWEEN '0000' AND '9999'"
        broken = f"{c} IS NOT NULL AND NOT ({iso_date(c)})"
    else:
        day = f"CAST(CAST({c} AS DATE) AS STRING)"
        future, broken = f"{c} > DATE '{as_of}'", "false"
    return {"min": f"CAST(min({c}) AS STRING)", "max": f"CAST(max({c}) AS STRING)", "future_count": _count_if(future, n),
            "placeholder_count": _count_if(text.one_of(day, vocab.PLACEHOLDER_DATES), n), "unparseable_count": _count_if(broken, n)}


def iso_date(c: str) -> str:
    """TRUE for text that is an existing ISO-8601 day, with or without a time."""
    shape = q(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return f"{c} RLIKE {shape} AND try_to_timestamp({c}) IS NOT NULL"


def text_measures(name: str, n: str | None = None) -> dict[str, str]:
    c = ident(name)
    bare = f"CASE WHEN {c} RLIKE {q(r'\s')} THEN {text.strip(c)} ELSE {c} END"      # most values hold no white space
    letters = f"{c} RLIKE '[A-Za-z]'"
    upper = f"{letters} AND NOT {c} RLIKE {q(r'[\p{IsLowercase}\p{Lt}]')}"
    lower = f"{letters} AND NOT {c} RLIKE {q(r'[\p{IsUppercase}\p{Lt}]')}"
    return {"min_length": f"min(length({c}))", "avg_length": f"round({_mean(f'length({c})', c, n)}, 2)", "max_length": f"max(length({c}))",
            "blank_count": _count_if(f"{bare} = ''", n), "untrimmed_count": _count_if(f"{c} <> {bare}", n),
            "upper_count": _count_if(upper, n), "lower_count": _count_if(lower, n),
            "mixed_case_count": f"{_count_if(letters, n)} - {_count_if(upper, n)} - {_count_if(lower, n)}"}


def _has_format(c: str, name: str, regex: str) -> str:
    """The regex, tried only on values that have what it asks for at the least: a sign, a length or the first character."""
    numeric = f"{c} >= '+' AND {c} < ':'"       # begins with a digit or one of + , - . /
    least = {"email": f"contains({c}, '@')", "uuid": f"length({c}) BETWEEN 36 AND 38", "url": f"startswith({c}, 'http')"}
    least |= dict.fromkeys(("iso_datetime", "iso_date", "phone", "decimal_text", "integer_text"), numeric)
    return f"({least[name]} AND {c} RLIKE {q(regex)})" if name in least else f"({c} RLIKE {q(regex)})"


def format_measures(name: str, n: str | None = None) -> dict[str, str]:
    """Best matching format at 80 % or more; an earlier format wins a tie."""
    c = ident(name)
    rates = ", ".join(f"struct({_mean(f'CAST({_has_format(c, f, rx)} AS INT)', c, n)} AS rate, {-i} AS place, {q(f)} AS format)"
                      for i, (f, rx) in enumerate(vocab.FORMATS))
    best = f"array_max(filter(array({rates}), r -> r.rate >= {vocab.FORMAT_MIN_RATE}))"
    return {"format": f"{best}.format", "match_rate": f"round({best}.rate, 6)"}


# ---- families as tables ---------------------------------------------------------------------------
def null_counts(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    out = per_column(df, table, {c: null_measures(c) for c in columns or df.columns})
    return out.withColumn("null_rate", F.round(F.coalesce(F.try_divide("null_count", "row_count"), F.lit(0.0)), 6))


def counted_values(df: DataFrame, column: str) -> DataFrame:
    """The column's values under its own name, each once, and how often it occurs."""
    return df.groupBy(F.col(ident(column)).alias(column)).agg(F.count(F.lit(1)).alias(count_name(column)))


def stored_values(df: DataFrame, column: str) -> DataFrame:
    """``counted_values``, stored: whatever a profile asks of a column later reads each value once. Parquet has no NULL type and no intervals."""
    found = counted_values(df, column)
    kind = df.schema[column].dataType.simpleString()
    return found if "void" in kind or "interval" in kind else written(found, "counted")


def count_name(column: str) -> str:
    return "n" if column.lower() != "n" else "n_"


def can_be_grouped(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (T.MapType, T.VariantType))


def distinct_measures(name: str) -> dict[str, str]:
    """Over ``counted_values``."""
    return {"non_null": _count_if(f"{ident(name)} IS NOT NULL", count_name(name)), "distinct_count": f"count({ident(name)})"}


def distinct_counts(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """(table, column, row_count, non_null, distinct_count): exact, each column's values shuffled once and without the others."""
    return union(per_column(counted_values(df, c), table, {
        c: {"row_count": null_measures(c, count_name(c))["row_count"]} | distinct_measures(c)})
        for c in columns or df.columns if can_be_grouped(df, c))


def uniqueness(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    return distinct_counts(df, table, columns).select(
        "table", "column", F.round(F.try_divide("distinct_count", "non_null"), 6).alias("uniqueness"),
        (F.col("distinct_count") == 1).alias("is_constant"))


def low_cardinality(df: DataFrame, columns: list[str], limit: int = vocab.TOP_VALUES) -> list[str]:
    """Columns that may have at most ``limit`` distinct values.

    The sketch cannot overestimate so few values by more than a few (each value sets one of its registers), so no
    such column is lost; a column let through by mistake is dropped by the exact count later.
    """
    if not columns:
        return []
    row = df.selectExpr(*[f"approx_count_distinct({ident(c)})" for c in columns]).first()
    return [c for c, n in zip(columns, row) if n <= 2 * limit]


def _stacked(columns: list[str]) -> str:
    return "inline(array(" + ", ".join(f"struct({q(c)} AS column, CAST({ident(c)} AS STRING) AS value)" for c in columns) + "))"


def _listed(counted: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(column, value, n) from the counted values of several columns."""
    return union(counted[c].select(F.lit(c).alias("column"), F.col(ident(c)).cast("string").alias("value"), F.col(ident(count_name(c))).alias("n"))
                 for c in columns)


def value_counts(df: DataFrame, table: str, columns: list[str], counted: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table, column, value, n) of several columns in one shuffle; the NULL group is kept."""
    values = df.selectExpr(_stacked(columns)).withColumn("n", F.lit(1).cast("bigint")) if counted is None else _listed(counted, columns)
    return (values.groupBy("column", "value").agg(F.sum("n").alias("n"))
            .select(F.lit(table).alias("table"), "column", "value", "n"))


def top_values(df: DataFrame, table: str, columns: list[str], limit: int = vocab.TOP_VALUES,
               known_few: bool = False, counted: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table, column, value, count, share, rank) for columns with at most ``limit`` distinct values."""
    few = columns if known_few else low_cardinality(df, columns, limit)
    if not few:
        return df.sparkSession.createDataFrame(
            [], "table string, column string, value string, count bigint, share double, rank int")
    counts = value_counts(df, table, few, counted)
    sizes = counts.groupBy("column").agg(F.count("value").alias("distinct_count"), F.sum("n").alias("rows"))
    ranked = counts.join(F.broadcast(sizes.where(F.col("distinct_count") <= limit)), "column")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()))
    return (ranked.withColumn("rank", rank).where(F.col("rank") <= limit)
            .select("table", "column", "value", F.col("n").alias("count"), F.round(F.col("n") / F.col("rows"), 6).alias("share"),
                    "rank"))


def boolean_stats(values: DataFrame) -> DataFrame:
    """(table, column, true_count, false_count, invalid_values) from value counts (``count`` column)."""
    known = values.where(F.col("value").isNotNull()).withColumn("word", F.expr(text.bool_word("value")))
    return known.groupBy("table", "column").agg(
        F.coalesce(F.sum(F.when(F.col("word") == "true", F.col("count"))), F.lit(0)).alias("true_count"),
        F.coalesce(F.sum(F.when(F.col("word") == "false", F.col("count"))), F.lit(0)).alias("false_count"),
        F.array_sort(F.collect_list(F.when(F.col("word") == "invalid", F.col("value")))).alias("invalid_values"))


def shapes(df: DataFrame, table: str, columns: list[str], with_example: bool = False, counted: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table, column, pattern, collapsed, n[, example]): how often each value shape occurs.

    With examples equal values are merged first: the smallest text needs sorted rows, and so one row per value is sorted.
    ``counted`` holds the columns' values where they are merged already.
    """
    values = (df.selectExpr(_stacked(columns)) if counted is None else _listed(counted, columns)).where(F.col("value").isNotNull())
    measures = [F.count(F.lit(1)).alias("n") if counted is None else F.sum("n").alias("n")]
    if with_example and counted is not None:
        measures.append(F.min("value").alias("example"))
    elif with_example:
        values = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        measures = [F.sum("n").alias("n"), F.min("value").alias("example")]
    return (values.groupBy("column", F.expr(text.signature("value")).alias("pattern")).agg(*measures)
            .withColumn("collapsed", F.expr(text.collapse("pattern"))).withColumn("table", F.lit(table)))


def _ranked_patterns(found: DataFrame, pattern: str, mode: str, limit: int) -> DataFrame:
    measures = [F.sum("n").alias("count")] + ([F.min("example").alias("example")] if "example" in found.columns else [])
    counts = found.groupBy("table", "column", F.col(pattern).alias("shape")).agg(*measures)
    rank = F.row_number().over(Window.partitionBy("table", "column").orderBy(F.col("count").desc(), "shape"))
    return (counts.withColumn("rank", rank).where(F.col("rank") <= limit).withColumnRenamed("shape", "pattern")
            .withColumn("mode", F.lit(mode)))


def patterns(found: DataFrame, limit: int = vocab.TOP_PATTERNS) -> DataFrame:
    """Top patterns per column. Where exact shapes cover less than half of the values, collapsed ones are used.

    ``found`` comes from ``shapes``: (table, column, mode, rank, pattern, count, share[, example]).
    """
    keys = ["table", "column"]
    exact = _ranked_patterns(found, "pattern", "exact", limit)
    loose = _ranked_patterns(found, "collapsed", "collapsed", limit)
    totals = found.groupBy(*keys).agg(F.sum("n").alias("total"))
    covered = exact.groupBy(*keys).agg(F.sum("count").alias("covered"))
    chosen = totals.join(covered, keys).withColumn(
        "chosen", F.when(F.col("covered") / F.col("total") < vocab.PATTERN_COVERAGE, "collapsed").otherwise("exact"))
    both = exact.unionByName(loose).join(F.broadcast(chosen), keys).where(F.col("mode") == F.col("chosen"))
    extra = ["example"] if "example" in found.columns else []
    return both.select(*keys, "mode", "rank", "pattern", "count", F.round(F.col("count") / F.col("total"), 6).alias("share"),
                       *extra)


def numeric_shape(df: DataFrame, table: str, columns: list[str], direct_values: int = DIRECT_VALUES,
                  counted: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table, column, mean, std, p01, p05, median, p95, p99, outlier_lo, outlier_hi, outlier_count).

    Quantiles are schema-sized numbers, so they go into the outlier count as literals: no join, no shuffle.
    """
    quantiles = exact_quantiles(df, columns, vocab.PERCENTILES, direct_values, counted)
    measures = {}
    for c in columns:
        shown = dict.fromkeys(("p01", "p05", "median", "p95", "p99", "outlier_lo", "outlier_hi"))
        outside = "CAST(NULL AS BOOLEAN)"
        if quantiles[c] is not None:
            shown["p01"], shown["p05"], q1, shown["median"], q3, shown["p95"], shown["p99"] = quantiles[c]
            if q3 > q1:
                shown["outlier_lo"], shown["outlier_hi"] = lo, hi = q1 - vocab.FENCE * (q3 - q1), q3 + vocab.FENCE * (q3 - q1)
                value = text.missing_nan(ident(c))
                outside = f"{value} < {lo!r}D OR {value} > {hi!r}D"
        numbers = {k: "CAST(NULL AS DOUBLE)" if v is None else f"round({v!r}D, 4)" for k, v in shown.items()}
        measures[c] = spread_measures(c) | numbers | {"outlier_count": f"count_if({outside})"}
    return per_column(df, table, measures)


def fk_orphans(tables, constraints: Constraints, counted: dict[tuple[str, str], DataFrame] | None = None) -> DataFrame:
    """(table, columns, ref_table, checked, orphans, orphan_rate) per declared foreign key.

    Child keys are counted first, so a hot key is one row when it meets the parent table. ``counted``: (table, column) -> its counted values,
    where a profile has stored them.
    """
    stored = counted or {}
    parts = []
    for child, columns, parent, ref_columns in constraints.foreign_keys:
        keys = [f"k{i}" for i in range(len(columns))]
        if len(keys) == 1 and (child, columns[0]) in stored:
            met = stored[child, columns[0]].select(F.col(ident(columns[0])).alias("k0"), F.col(ident(count_name(columns[0]))).alias("n")).dropna()
        else:
            met = (tables[child].select(*[F.col(c).alias(k) for c, k in zip(columns, keys)]).dropna()
                   .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        if len(keys) == 1 and (parent, ref_columns[0]) in stored:
            known = stored[parent, ref_columns[0]].select(F.col(ident(ref_columns[0])).alias("k0")).dropna()
        else:
            known = tables[parent].select(*[F.col(c).alias(k) for c, k in zip(ref_columns, keys)]).dropna().distinct()
        met = met.join(known.withColumn("found", F.lit(True)), keys, "left")
        parts.append(met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
                             F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("orphans"))
                     .select(F.lit(child).alias("table"), F.lit(",".join(columns)).alias("columns"),
                             F.lit(parent).alias("ref_table"), "checked", "orphans"))
    return union(parts).withColumn(
        "orphan_rate", F.round(F.coalesce(F.try_divide("orphans", "checked"), F.lit(0.0)), 6))
