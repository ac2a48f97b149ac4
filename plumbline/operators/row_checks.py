"""Checks one row can answer by itself. Each becomes one boolean column: TRUE = the row fails.

NULL never fails a check, except in not_null and null_rate_max. The predicates are plain built-in
expressions, so any number of them share a single scan.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.expressions import check_regex, rule_expression
from plumbline.rules import Rule

ROW_CHECKS = ("not_null", "null_rate_max", "allowed_values", "pattern", "range", "length_range", "date_not_future",
              "not_placeholder", "row_condition", "conditional")


def as_text(df: DataFrame, column: str) -> Column:
    """The text a value is compared by: dates and timestamps by their day."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(column).cast("date").cast("string")
    return F.col(column).cast("string")


def _literal_text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def scope_of(rule: Rule, df: DataFrame) -> Column | None:
    """Rows the rule looks at; None = all of them."""
    spark, known = df.sparkSession, set(df.columns)
    parts = [rule.filter] if rule.filter else []
    if rule.type == "conditional":
        parts.append(rule.check["when"])
    scope = None
    for text in parts:
        part = F.coalesce(rule_expression(spark, text, known), F.lit(False))
        scope = part if scope is None else scope & part
    return scope


def fails(rule: Rule, df: DataFrame, as_of: dt.date) -> Column:
    spark, known = df.sparkSession, set(df.columns)
    kind = rule.type
    name = rule.columns[0] if rule.columns else None
    c = F.col(name) if name else None

    if kind in ("not_null", "null_rate_max"):
        return c.isNull()
    if kind == "allowed_values":
        wanted = [_literal_text(v) for v in rule.check["values"]]
        text = as_text(df, name)
        if not rule.param("case_sensitive", True):
            text, wanted = F.upper(text), [v.upper() for v in wanted]
        return ~text.isin(wanted)
    if kind == "pattern":
        check_regex(spark, rule.check["regex"])
        return ~as_text(df, name).rlike(rule.check["regex"])
    if kind == "range":
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast("double"))
        closed = rule.param("inclusive", True)
        bounds = []
        if rule.param("min") is not None:
            bounds.append(c < rule.check["min"] if closed else c <= rule.check["min"])
        if rule.param("max") is not None:
            bounds.append(c > rule.check["max"] if closed else c >= rule.check["max"])
        return bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
    if kind == "length_range":
        size = F.length(as_text(df, name))
        low = size < rule.check["min_length"] if rule.param("min_length") is not None else F.lit(False)
        high = size > rule.check["max_length"] if rule.param("max_length") is not None else F.lit(False)
        return low | high
    if kind == "date_not_future":
        if isinstance(df.schema[name].dataType, T.StringType):
            c = F.try_to_timestamp(c)
        return c > F.lit(as_of)
    if kind == "not_placeholder":
        return as_text(df, name).isin([_literal_text(v) for v in rule.check["values"]])
    if kind == "row_condition":
        return ~rule_expression(spark, rule.check["expression"], known)
    if kind == "conditional":
        return ~rule_expression(spark, rule.check["then"], known)
    raise ValueError(f"'{kind}' is not a row check")
