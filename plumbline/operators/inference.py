"""What columns mean: evidence scoring over profile rows, valid codes, patterns, PII.

Inputs are schema-sized (one row per column), the expressions are large; so they are SQL text that reaches
Spark in a few calls.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from plumbline import vocab
from plumbline.functions import text
from plumbline.functions.text import array_of, one_of, q

_NAMED = f"concat({q("name '")}, column, {q("'")})"


def name_hint(name: str, group: str) -> str:
    """First hint of a group that the snake_case name matches: struct(type, weight), else NULL."""
    cases = " ".join(f"WHEN {name} RLIKE {q(rx)} THEN struct({q(kind)} AS type, {weight!r}D AS weight)"
                     for g, rx, kind, weight in vocab.NAME_HINTS if g == group)
    return f"CASE {cases} END"


def name_hints(columns: DataFrame, name: str = "bare_name") -> DataFrame:
    """(table, column, group, semantic_type, weight) for every hint a column name gives."""
    hints = ", ".join(f"struct({q(g)} AS group, {name_hint('_name', g)} AS hint)" for g in vocab.NAME_HINT_GROUPS)
    return (columns.withColumn("_name", F.expr(text.snake(name))).selectExpr("table", "column", f"inline(array({hints}))")
            .where("hint IS NOT NULL").selectExpr("table", "column", "group", "hint.type AS semantic_type", "hint.weight"))


def _ev(kind: str, weight, reason: str) -> str:
    return f"struct({kind} AS type, CAST({weight} AS DOUBLE) AS weight, {reason} AS reason)"


def _total(evidence: str, kind: str | None = None) -> str:
    chosen = evidence if kind is None else f"filter({evidence}, e -> e.type = {kind})"
    return f"aggregate({chosen}, 0D, (s, e) -> s + e.weight)"


def _credited(family: Iterable[str], default: str) -> str:
    """The type of a family the evidence already favours, else the default."""
    scored = ", ".join(f"struct({_total('_base', q(t))} AS s, {-i} AS i, {q(t)} AS t)" for i, t in enumerate(family))
    return f"coalesce(array_max(filter(array({scored}), x -> x.s > 0)).t, {default})"


def _compatible() -> str:
    """Types a column of this storage type and format can have."""
    plain = [t for t in vocab.SEMANTIC_TYPES if t not in vocab.NUMERIC_TYPES + vocab.DATE_TYPES]
    numbers = vocab.NUMERIC_TYPES + vocab.KEY_TYPES + vocab.CODE_TYPES + ("flag", "postal_code", "phone", "other")
    return (f"CASE WHEN {one_of('generic_type', vocab.DATE_GENERIC)} THEN {array_of(vocab.DATE_TYPES + ('other',))} "
            f"WHEN generic_type = 'boolean' THEN array('flag', 'other') "
            f"WHEN {one_of('generic_type', vocab.NUMERIC_GENERIC)} THEN {array_of(numbers)} "
            f"WHEN detected_format.format IN ('integer_text', 'decimal_text') THEN {array_of(plain + list(vocab.NUMERIC_TYPES))} "
            f"WHEN detected_format.format IN ('iso_date', 'iso_datetime') THEN {array_of(plain + list(vocab.DATE_TYPES))} "
            f"ELSE {array_of(plain)} END")


def semantic_types(facts: DataFrame) -> DataFrame:
    """Adds semantic_type, confidence and reasons to profile rows.

    ``facts``: PROFILE columns plus bare_name, fk_target, is_self_fk, self_referencing (of the table).
    Every signal adds its weight to a type; the winner's share of all weights is the confidence.
    """
    hinted = [f"CASE WHEN _h_{g} IS NOT NULL THEN {_ev(f'_h_{g}.type', f'_h_{g}.weight', _NAMED)} END" for g in vocab.NAME_HINT_GROUPS]
    formats = "map(" + ", ".join(f"{q(k)}, {q(v)}" for k, v in vocab.FORMAT_HINTS.items()) + ")[detected_format.format]"
    has_hint = f"coalesce({one_of('detected_format.format', vocab.FORMAT_HINTS)}, false)"
    looks = "concat(CAST(round(detected_format.match_rate * 100) AS INT), '% have the format ', detected_format.format)"
    base = ", ".join([
        f"CASE WHEN is_primary_key THEN {_ev(q('identifier'), 5, q('declared as key'))} END",
        f"CASE WHEN is_self_fk THEN {_ev(q('parent_key'), 5, q('points to its own table'))} "
        f"WHEN fk_target IS NOT NULL THEN {_ev(q('foreign_key'), 5, '''concat('points to ', fk_target)''')} END",
        *hinted,
        f"CASE WHEN self_referencing AND _h_code.type = 'hierarchy_level' "
        f"THEN {_ev(q('hierarchy_level'), 2, q('level of a table that points to itself'))} END",
        f"CASE WHEN {has_hint} THEN {_ev(formats, 3, looks)} END"])

    numeric = one_of("generic_type", vocab.NUMERIC_GENERIC)
    only_01 = ("distinct_count = 2 AND size(array_except(filter(transform(top_values, v -> v.value), v -> v IS NOT NULL), "
               "array('0', '1'))) = 0")
    code_like, unique = "coalesce(detected_format.format = 'code', false)", "coalesce(uniqueness, 0)"
    text_named = f"exists(_base, e -> {one_of('e.type', vocab.TEXT_TYPES)})"
    date_type = _credited(vocab.DATE_TYPES, "CASE WHEN generic_type = 'datetime' THEN 'event_timestamp' ELSE 'event_date' END")
    number_type = _credited(vocab.NUMERIC_TYPES, "CASE WHEN generic_type = 'integer' THEN 'count' ELSE 'amount' END")
    text_type = _credited(vocab.TEXT_TYPES, "CASE WHEN text.avg_length > 40 THEN 'free_text' ELSE 'label' END")
    near_unique = f"concat('codes that seldom repeat (', format_number({unique} * 100, 1), '% different)')"
    code_type = _credited(vocab.CODE_TYPES, "'category_code'")
    distinct_values = "concat(distinct_count, ' different values')"
    shape = (
        f"CASE WHEN generic_type = 'boolean' THEN {_ev(q('flag'), 4, q('stored as boolean'))} "
        f"WHEN {one_of('generic_type', vocab.DATE_GENERIC)} THEN {_ev(date_type, 3, q('stored as date or time'))} "
        f"WHEN is_primary_key OR fk_target IS NOT NULL THEN NULL "
        f"WHEN {numeric} AND {only_01} THEN {_ev(q('flag'), 2, q('holds 0 and 1 only'))} "
        f"WHEN {numeric} THEN {_ev(number_type, 2, q('stored as number'))} "
        f"WHEN generic_type = 'string' AND NOT {has_hint} THEN CASE "
        f"  WHEN {code_like} AND {unique} >= {vocab.NEAR_UNIQUE} AND null_rate < 0.05 THEN {_ev(q('business_key'), 3, near_unique)} "
        f"  WHEN distinct_count <= {vocab.TOP_VALUES} AND {unique} < 0.5 AND NOT {text_named} "
        f"    THEN {_ev(code_type, f'CASE WHEN {code_like} THEN 2.5 ELSE 1.5 END', distinct_values)} "
        f"  ELSE {_ev(text_type, 1, q('text of many forms'))} END END")

    hints = {f"_h_{g}": F.expr(name_hint("_name", g)) for g in vocab.NAME_HINT_GROUPS}
    scored = f"transform(array_distinct(transform(_ev, e -> e.type)), (t, i) -> struct({_total('_ev', 't')} AS s, -i AS i, t AS t))"
    return (facts.withColumn("_name", F.expr(text.snake("bare_name"))).withColumns(hints)
            .withColumn("_base", F.expr(f"array_compact(array({base}))"))
            .withColumn("_all", F.expr(f"concat(_base, array_compact(array({shape}, {_ev(q('other'), 0.5, q('default'))})))"))
            .withColumn("_ev", F.expr(f"filter(_all, e -> array_contains({_compatible()}, e.type))"))
            .withColumn("_best", F.expr(f"array_max({scored})"))
            .withColumns({"semantic_type": F.expr("_best.t"), "confidence": F.expr(f"round(_best.s / {_total('_ev')}, 2)"),
                          "reasons": F.expr("array_join(transform(filter(_ev, e -> e.type = _best.t), e -> e.reason), '; ')")})
            .drop("_name", "_base", "_all", "_ev", "_best", *hints))


def role(kind: str) -> str:
    return (f"CASE WHEN {kind} IN ('identifier', 'business_key') THEN 'key' WHEN {kind} IN ('foreign_key', 'parent_key') THEN 'foreign_key' "
            f"WHEN {one_of(kind, vocab.NUMERIC_TYPES)} THEN 'measure' WHEN {one_of(kind, vocab.CODE_TYPES + ('flag',))} THEN 'dimension' "
            f"ELSE 'attribute' END")


def pii(kind: str, sensitive_hint: str, column: str) -> str:
    return (f"coalesce({one_of(kind, vocab.PII_TYPES)}, false) OR coalesce({sensitive_hint}, false) "
            f"OR {text.snake(column)} RLIKE {q(vocab.PII_NAME)}")


def expected_pattern() -> str:
    """Over profile rows with a semantic type: the regex values should follow, or NULL."""
    return (f"CASE WHEN semantic_type = 'email' THEN {q(vocab.EMAIL_REGEX)} "
            f"WHEN semantic_type IN ('business_key', 'phone', 'postal_code') AND pattern_mode = 'exact' "
            f"AND patterns[0].share >= {vocab.DOMINANT_PATTERN} THEN {text.signature_regex('patterns[0].pattern')} END")


# ---- valid codes and their look-alikes ------------------------------------------------------------
def lookalike_reason(value: str, valid: str) -> str:
    """Why a rare value looks like a valid one: misspelling, abbreviation, spelled-out or short form; else NULL."""
    v, c = f"lower({value})", f"lower({valid})"
    letters = f"array_join(transform(split({v}, ''), ch -> regexp_replace(ch, {q(r'([^\w\s])')}, {q(r'\\$1')})), '.*')"

    def because(kind: str) -> str:
        return f"concat({q(kind + " of '")}, {valid}, {q("'")})"
    return (f"CASE WHEN length({v}) >= 4 AND levenshtein({v}, {c}) <= CASE WHEN length({c}) < 8 THEN 1 ELSE 2 END THEN {because('misspelling')} "
            f"WHEN length({v}) >= 2 AND length({v}) < length({c}) AND {c} RLIKE concat('(?s)^', {letters}) THEN {because('abbreviation')} "
            f"WHEN length({c}) <= 3 AND startswith({v}, {c}) AND length({v}) > length({c}) THEN {because('spelled-out form')} "
            f"WHEN length({v}) >= 3 AND array_contains(split({c}, {q(r'[_\-\s]+')}), {v}) THEN {because('short form')} END")


def _style(value: str) -> str:
    return (f"concat_ws('/', CASE WHEN NOT {value} RLIKE {q(r'\p{L}')} THEN 'none' "
            f"WHEN NOT {value} RLIKE {q(r'[\p{L}&&[^\p{IsUppercase}]]')} THEN 'upper' "
            f"WHEN NOT {value} RLIKE {q(r'[\p{L}&&[^\p{IsLowercase}]]')} THEN 'lower' ELSE 'mixed' END, "
            f"CAST({value} RLIKE {q(r'\p{Nd}')} AS STRING), CAST({value} RLIKE {q(r'[^\w]')} AS STRING))")


def _once(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` bound to ``value``, computed one time however often it is mentioned."""
    return f"transform(array({value}), {name} -> {use})[0]"


_ANOMALIES = "array<struct<value:string,count:bigint,looks_like:string,reason:string>>"


def classify_values(values: str) -> str:
    """Split a column's value frequencies (most frequent first) into struct(allowed, anomalies).

    A fold inside the JVM: the first value is valid; a case variant of a valid value never is; below 1 % a value
    that looks like a valid one is an anomaly, and so is one that also has an unfamiliar style.
    """
    known = f"filter({values}, v -> v.value IS NOT NULL)"
    total = f"aggregate({known}, 0L, (s, v) -> s + v.count)"
    near = (f"filter(transform(acc.allowed, c -> struct(c AS c, {lookalike_reason('v.value', 'c')} AS why)), "
            f"n -> n.why IS NOT NULL)")
    seen = (f"struct(v.share < {vocab.CANONICAL_SHARE} AS rare, {_style('v.value')} AS style, "
            f"CASE WHEN v.share < {vocab.CANONICAL_SHARE} THEN get({near}, 0) END AS near, "
            f"get(filter(acc.allowed, c -> lower(c) = lower(v.value)), 0) AS same)")
    rare_text = "concat('rare (', format_number(v.share * 100, 2), '%) and unlike any valid value')"
    looks = "coalesce(x.same, x.near.c)"
    judged = (f"struct(size(acc.allowed) = 0 OR ({looks} IS NULL AND (NOT x.rare OR (v.share >= {vocab.STYLE_SHARE} "
              f"AND array_contains(acc.styles, x.style)))) AS ok, x.style AS style, struct(v.value AS value, v.count AS count, "
              f"{looks} AS looks_like, coalesce(concat({q("case variant of '")}, x.same, {q("'")}), x.near.why, {rare_text}) AS reason) AS bad)")
    grown = ("struct(CASE WHEN y.ok THEN concat(acc.allowed, array(v.value)) ELSE acc.allowed END AS allowed, "
             "CASE WHEN y.ok THEN concat(acc.styles, array(y.style)) ELSE acc.styles END AS styles, "
             "CASE WHEN y.ok THEN acc.anomalies ELSE concat(acc.anomalies, array(y.bad)) END AS anomalies)")
    step = _once(_once(seen, "x", judged), "y", grown)
    start = (f"struct(CAST(array() AS array<string>) AS allowed, CAST(array() AS array<string>) AS styles, "
             f"CAST(array() AS {_ANOMALIES}) AS anomalies)")
    shares = _once(total, "rows", f"transform({known}, v -> struct(v.value AS value, v.count AS count, v.count / rows AS share))")
    return (f"aggregate({shares}, {start}, (acc, v) -> {step}, acc -> struct(acc.allowed AS allowed, acc.anomalies AS anomalies))")


def value_arrays(top: DataFrame) -> DataFrame:
    """(table, column, values): the top values of a column in rank order. At most TOP_VALUES per column."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    return top.groupBy("table", "column").agg(F.transform(pairs, lambda p: F.struct(p["value"], p["count"])).alias("values"))
