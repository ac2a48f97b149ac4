"""Score profiles, rules and models against an answer key."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import vocab
from plumbline.functions.text import q


def profile_coverage(issues: DataFrame, signals: DataFrame) -> DataFrame:
    """(issue_id, dimension, status): does the profile show the issue? visible, hint or not visible.

    issues: issue_id, table, columns (array), dimension. signals: table, column, signal.
    """
    wanted = ("map(" + ", ".join(f"{q(d)}, CAST(array({', '.join(q(s) for s in names)}) AS array<string>)"
                                 for d, names in vocab.SIGNALS_BY_DIMENSION.items()) + ")[dimension]")
    seen = signals.groupBy("table", "column").agg(F.collect_set("signal").alias("signals"))
    at = issues.select("issue_id", "table", "dimension", F.explode_outer("columns").alias("column"))
    met = at.join(seen, ["table", "column"], "left").withColumn("direct", F.expr(f"coalesce(arrays_overlap(signals, {wanted}), false)"))
    return met.groupBy("issue_id", "dimension").agg(
        F.when(F.bool_or("direct"), "visible").when(F.bool_or(F.col("signals").isNotNull()), "hint").otherwise("not visible").alias("status"))


def by_dimension(scored: DataFrame, hit: str) -> DataFrame:
    """(dimension, hit, total) with one row for all dimensions together ('all')."""
    return (scored.rollup("dimension").agg(F.count_if(F.expr(hit)).alias("hit"), F.count(F.lit(1)).alias("total"))
            .withColumn("dimension", F.coalesce("dimension", F.lit("all"))))


def execution_coverage(issues: DataFrame, results: DataFrame, violations: DataFrame) -> DataFrame:
    """(issue_id, dimension, affected, flagged, status): caught when failing rules flag half of the planted keys.

    issues: issue_id, dimension, entity, key (one row per planted key). Only rules that fail overall raise an alert.
    """
    alarms = violations.join(results.where(~F.col("passed")).select("rule_id"), "rule_id", "left_semi").select("entity", "key").distinct()
    return coverage_of_alarms(issues, alarms)


def coverage_of_alarms(issues: DataFrame, alarms: DataFrame) -> DataFrame:
    """The same from the distinct (entity, key) that failing rules flag."""
    met = (issues.select("issue_id", "dimension", "entity", "key").distinct()
           .join(alarms.withColumn("hit", F.lit(True)), ["entity", "key"], "left"))
    share = F.try_divide("flagged", "affected")
    return met.groupBy("issue_id", "dimension").agg(F.count(F.lit(1)).alias("affected"), F.count("hit").alias("flagged")).withColumn(
        "status", F.when(share >= vocab.CAUGHT_SHARE, "caught").when(F.col("flagged") > 0, "partial").otherwise("missed"))


def unexplained(issues: DataFrame, results: DataFrame, violations: DataFrame) -> DataFrame:
    """(rule_id, unexplained): keys a failing rule flags that no planted issue of its entity names."""
    planted = issues.select("entity", "key").distinct()
    flagged = violations.join(results.where(~F.col("passed")).select("rule_id"), "rule_id", "left_semi")
    odd = flagged.select("rule_id", "entity", "key").distinct().join(planted, ["entity", "key"], "left_anti")
    counted = odd.groupBy("rule_id").agg(F.count(F.lit(1)).alias("unexplained"))
    return results.select("rule_id").join(counted, "rule_id", "left").withColumn("unexplained", F.coalesce("unexplained", F.lit(0)))


_BARE = r"([a-z_][a-z0-9_]*)(?!\s*\()(?![a-z0-9_])"
_WORDS = "array('and', 'or', 'not', 'in', 'is', 'null', 'between', 'like', 'true', 'false', 'case', 'when', 'then', 'else', 'end', 'date', 'as')"


def _columns_in(c: str) -> str:
    plain = f"regexp_replace(lower(coalesce({c}, '')), '\\'([^\\']|\\'\\')*\\'', ' ')"
    return f"array_except(regexp_extract_all({plain}, {q(_BARE)}, 1), {_WORDS})"


def _comparable(rules: DataFrame, tag: str) -> DataFrame:
    """What two rules are compared by. rules: rule_id, entity, columns, check (JSON), filter[, covers]."""
    family = "map(" + ", ".join(f"{q(k)}, {q(v)}" for k, v in vocab.CHECK_FAMILY.items()) + ")[k['type']]"
    used = "array_distinct(concat(cols, " + ", ".join(_columns_in(x) for x in (
        "filter", "k['expression']", "k['when']", "k['then']", "k['parent_expression']")) + "))"
    out = (rules.withColumn("k", F.from_json("check", "map<string,string>"))
           .withColumn("cols", F.expr("array_sort(array_distinct(transform(columns, c -> lower(c))))"))
           .withColumn("family", F.expr(family)).withColumn("used", F.expr(used)))
    keep = ["rule_id", "k", "cols", "family", "used", *[c for c in ("covers", "origin", "tree") if c in out.columns]]
    return out.select("entity", F.struct(*keep).alias(tag))


def rule_coverage(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """(reference_id, rule_id): generated rules that check the same thing at least as strictly as a reference rule.

    Rules meet by entity, check family and columns (a row condition also meets a range on one of its columns).
    ``tree`` (optional column on both) is the entity a rule's hierarchy lives on.
    """
    def meets(side: str) -> str:
        """Keys two rules must share to be compared at all, so that no pairs of unrelated rules are made."""
        tree_of = f"coalesce({side}.tree, {side}.k['hierarchy'])" if "tree" in generated.columns else f"{side}.k['hierarchy']"
        return (f"CASE WHEN {side}.family IN ('children', 'aggregate') THEN array(concat_ws('|', {side}.family, {side}.k['child_entity'])) "
                f"WHEN {side}.family IN ('h_parent', 'h_acyclic') THEN array(concat_ws('|', {side}.family, {tree_of})) "
                f"WHEN {side}.family = 'custom' THEN CAST(array() AS array<string>) "
                f"WHEN {side}.family = 'row' THEN {{row}} ELSE array(concat_ws('|', {side}.family, array_join({side}.cols, ','))) END")
    own = meets("r").format(row="CAST(array() AS array<string>)")
    ref = _comparable(reference, "r").withColumn("meets", F.explode(F.expr(
        f"concat({own}, CASE WHEN r.family IN ('row', 'range') THEN array(concat('row|', array_min(r.used))) ELSE array() END)")))
    gen = _comparable(generated, "g").withColumn("meets", F.explode(F.expr(
        meets("g").format(row="transform(g.used, c -> concat('row|', c))"))))

    def num(side: str, p: str) -> str:
        return f"try_cast({side}.k['{p}'] AS DOUBLE)"

    def closed(side: str) -> str:
        return f"coalesce({side}.k['inclusive'], 'true') = 'true'"

    def listed(side: str, p: str = "values") -> str:
        return f"from_json({side}.k['{p}'], 'array<string>')"
    same = "g.cols = r.cols"
    tight = {b: f"({num('r', b)} IS NULL OR coalesce({num('g', b)} {op} {num('r', b)} OR ({num('g', b)} = {num('r', b)} "
                f"AND (NOT {closed('g')} OR {closed('r')})), false))" for b, op in (("min", ">"), ("max", "<"))}
    tree = "coalesce(g.tree = r.tree, g.k['hierarchy'] = r.k['hierarchy'])" if "tree" in generated.columns else "g.k['hierarchy'] = r.k['hierarchy']"
    overlap = " AND ".join(f"arrays_overlap({_columns_in(f'''g.k['{p}']''')}, {_columns_in(f'''r.k['{p}']''')})"
                           for p in ("child_expression", "parent_expression"))
    covers = f"""CASE g.family
 WHEN 'row' THEN size(array_except(r.used, g.used)) = 0
 WHEN 'completeness' THEN {same} AND (g.k['type'] = 'not_null' OR {num('g', 'max_rate')} <= coalesce({num('r', 'max_rate')}, 0))
 WHEN 'allowed' THEN {same} AND coalesce(g.k['case_sensitive'], 'true') = 'true' AND size(array_except({listed('g')}, {listed('r')})) = 0
 WHEN 'range' THEN {same} AND {tight['min']} AND {tight['max']}
 WHEN 'placeholder' THEN {same} AND arrays_overlap({listed('g')}, {listed('r')})
 WHEN 'fk' THEN {same} AND g.k['ref_entity'] = r.k['ref_entity']
 WHEN 'children' THEN g.k['child_entity'] = r.k['child_entity']
 WHEN 'aggregate' THEN g.k['child_entity'] = r.k['child_entity'] AND {overlap}
 WHEN 'h_parent' THEN {tree} WHEN 'h_acyclic' THEN {tree} WHEN 'h_attach' THEN {same} AND g.k['level'] = r.k['level'] AND {tree}
 WHEN 'custom' THEN false ELSE {same} END"""
    return ref.join(gen, ["entity", "meets"]).where(covers).selectExpr("r.rule_id AS reference_id", "g.rule_id AS rule_id").distinct()


def issue_coverage(covered: DataFrame, reference: DataFrame) -> DataFrame:
    """(issue_id, covered): an issue is covered when a rule covers any reference rule written for it."""
    met = reference.select("rule_id", F.explode("covers").alias("issue_id")).join(
        covered.select(F.col("reference_id").alias("rule_id")).distinct().withColumn("hit", F.lit(True)), "rule_id", "left")
    return met.groupBy("issue_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("covered"))


def semantic_accuracy(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """(aspect, hit, total) over attributes matched by table and column: semantic_type, role, allowed values, PII.

    Both sides: table, column, semantic_type, role, pii, allowed_values (sorted array or NULL).
    """
    rest = ["semantic_type", "role", "pii", "allowed_values"]
    joined = (generated.select("table", "column", F.struct(*rest).alias("g"))
              .join(reference.select("table", "column", F.struct(*rest).alias("r")), ["table", "column"], "full_outer"))
    both = "g IS NOT NULL AND r IS NOT NULL"
    aspects = {
        "semantic_type": (f"{both} AND g.semantic_type = r.semantic_type", both),
        "role": (f"{both} AND g.role = r.role", both),
        "allowed_values": (f"{both} AND r.allowed_values IS NOT NULL AND array_sort(coalesce(g.allowed_values, array())) = array_sort(r.allowed_values)",
                           f"{both} AND r.allowed_values IS NOT NULL"),
        "pii_recall": (f"{both} AND g.pii AND r.pii", f"{both} AND r.pii"),
        "pii_precision": (f"{both} AND g.pii AND r.pii", f"{both} AND g.pii"),
        "attribute_found": (both, "r IS NOT NULL"),
    }
    one = joined.selectExpr(*[f"count_if({h}) AS h{i}" for i, (h, _) in enumerate(aspects.values())],
                            *[f"count_if({t}) AS t{i}" for i, (_, t) in enumerate(aspects.values())])
    rows = ", ".join(f"struct({q(a)} AS aspect, h{i} AS hit, t{i} AS total)" for i, a in enumerate(aspects))
    return one.selectExpr(f"inline(array({rows}))")


def set_accuracy(generated: DataFrame, reference: DataFrame, keys: list[str], aspect: str) -> DataFrame:
    """(aspect, hit, total, extra): rows of the reference that were found, and rows that are not in it."""
    g, r = generated.select(*keys).distinct().withColumn("g", F.lit(True)), reference.select(*keys).distinct().withColumn("r", F.lit(True))
    return g.join(r, keys, "full_outer").agg(F.count_if(F.col("g") & F.col("r")).alias("hit"), F.count("r").alias("total"),
                                             F.count_if(F.col("r").isNull()).alias("extra")).withColumn("aspect", F.lit(aspect))
