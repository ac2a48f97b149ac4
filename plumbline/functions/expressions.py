"""Guard for the small SQL expressions inside rules. Spark parses them; this only decides what may run."""
from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession, functions as F

from plumbline import vocab


class ExpressionError(ValueError):
    pass


_DATE_ADD = re.compile(r"(?i)\bdate_add\s*\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*,\s*'(day|month|year)'\s*\)")


def portable(text: str) -> str:
    """DATE_ADD(col, n, 'UNIT') is the portable spelling in rules; Spark has one function per unit."""
    def spark_form(m: re.Match) -> str:
        col, n, unit = m.group(1), m.group(2), m.group(3).lower()
        if unit == "day":
            return f"date_add({col}, {n})"
        return f"add_months({col}, {n})" if unit == "month" else f"add_months({col}, 12 * ({n}))"
    return _DATE_ADD.sub(spark_form, text)


def _nodes(tree):
    """All nodes of an expression Spark has parsed, the root first."""
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))


def parsed_names(spark: SparkSession, text: str) -> tuple[set[str], set[str], bool]:
    """(columns, functions, has a subquery) of an expression, as Spark's own parser sees it.

    The parser is reached through the session: the only JVM-internal call of this package.
    """
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(portable(text))
    except Exception as e:  # noqa: BLE001 - py4j wraps every parser error
        raise ExpressionError(f"cannot parse '{text}'") from e
    columns, functions, subquery = set(), set(), False
    for node in _nodes(tree):
        kind = node.getClass().getSimpleName()
        if kind in ("UnresolvedAttribute", "UnresolvedFunction"):
            parts = node.nameParts()
            name = ".".join(parts.apply(i) for i in range(parts.size()))
            (columns if kind == "UnresolvedAttribute" else functions).add(name)
        elif "Subquery" in kind or kind in ("Exists", "ListQuery"):
            subquery = True
    return columns, functions, subquery


def check_expression(spark: SparkSession, text: str, known: set[str], aggregate: bool = False) -> None:
    columns, functions, subquery = parsed_names(spark, text)
    if subquery:
        raise ExpressionError(f"'{text}' must be a plain expression (no SELECT, subqueries or statements)")
    qualified = sorted(c for c in columns if "." in c)
    if qualified:
        raise ExpressionError(f"'{text}': use bare column names, not {qualified}")
    unknown = sorted({c.lower() for c in columns} - {k.lower() for k in known})
    if unknown:
        raise ExpressionError(f"'{text}': unknown column(s) {unknown}")
    called = {f.lower() for f in functions}
    aggregates = called & set(vocab.AGGREGATE_FUNCTIONS)
    refused = sorted(called - set(vocab.ROW_FUNCTIONS) - set(vocab.AGGREGATE_FUNCTIONS))
    if refused:
        raise ExpressionError(f"'{text}': function(s) {refused} are not allowed in rules")
    if aggregate and not aggregates:
        raise ExpressionError(f"'{text}' must be an aggregate (SUM, MIN, MAX, COUNT, AVG)")
    if not aggregate and aggregates:
        raise ExpressionError(f"'{text}' must not contain aggregates")


def rule_expression(spark: SparkSession, text: str, known: set[str], aggregate: bool = False) -> Column:
    check_expression(spark, text, known, aggregate)
    return F.expr(portable(text))


def check_regex(spark: SparkSession, regex: str) -> None:
    try:
        spark._jvm.java.util.regex.Pattern.compile(regex)
    except Exception as e:  # noqa: BLE001
        raise ExpressionError(f"invalid regex '{regex}'") from e


@contextmanager
def null_on_error(spark: SparkSession):
    """Rules are CHECK constraints: an expression without a value (1/0, a bad cast) is NULL, not a lost job."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


# ---- the same guard for whole tables of candidate rules -------------------------------------------
_KEYWORDS = ("and", "or", "not", "in", "is", "null", "between", "like", "true", "false", "case", "when", "then",
             "else", "end", "date", "timestamp", "as", "distinct", "interval", "escape")


def bare_words(text: Column) -> Column:
    """Lower-case identifiers of an expression column that are neither keywords nor allowed functions."""
    plain = F.regexp_replace(F.lower(text), r"'([^']|'')*'", " ")
    words = F.regexp_extract_all(plain, F.lit(r"([a-z_][a-z0-9_]*)(?!\s*\()(?![a-z0-9_])"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*_KEYWORDS)))


def expression_issue(text: Column, known: Column, aggregate: bool = False) -> Column:
    """NULL when an expression column is fine, else why it is not. ``known`` = array of lower-case names."""
    plain = F.regexp_replace(F.lower(text), r"'([^']|'')*'", " ")
    calls = F.regexp_extract_all(plain, F.lit(r"([a-z_][a-z0-9_]*)\s*\("), F.lit(1))
    aggregates = F.size(F.filter(calls, lambda f: f.isin(*vocab.AGGREGATE_FUNCTIONS))) > 0
    refused = F.filter(calls, lambda f: ~f.isin(*vocab.ROW_FUNCTIONS, *vocab.AGGREGATE_FUNCTIONS, *_KEYWORDS))
    unknown = F.array_except(bare_words(text), known)
    wrong_aggregate = ~aggregates if aggregate else aggregates
    return (F.when(text.isNull(), F.lit(None))
            .when(plain.rlike(r";|\b(select|insert|update|delete|drop|alter|create|merge)\b"),
                  F.lit("must be a plain expression"))
            .when(plain.rlike(r"[a-z_][a-z0-9_]*\s*\.\s*[a-z_]"), F.lit("use bare column names"))
            .when(F.size(refused) > 0, F.concat(F.lit("function not allowed: "), F.array_join(refused, ",")))
            .when(F.size(unknown) > 0,
                  F.concat(F.lit("unknown column(s): "), F.array_join(F.array_sort(unknown), ",")))
            .when(wrong_aggregate, F.lit("must be an aggregate" if aggregate else "must not contain aggregates")))
