"""Validate tables of candidate rules (JSON text, wherever it came from): shape, references, triage."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline import vocab
from plumbline.functions.expressions import expression_issue
from plumbline.functions.skew import cut_lineage
from plumbline.functions.text import array_of, one_of, q

CANDIDATE = ("name string, category string, dimension string, scope string, target struct<entity:string,columns:array<string>>, "
             "check map<string,string>, filter string, severity string, tolerance double")


@F.pandas_udf(T.StringType())
def _regex_problem(patterns: pd.Series) -> pd.Series:
    """Why a regex does not compile. Spark has no way to ask without failing the job."""
    def problem(p):
        if p is None:
            return None
        try:
            re.compile(p)
        except re.error as e:
            return str(e)
        return None
    return patterns.map(problem)


def parsed(candidates: DataFrame, column: str = "rule") -> DataFrame:
    """Adds ``r`` (the rule's fields; unreadable JSON gives NULL fields) and ``type``."""
    return (candidates.withColumn("r", F.from_json(F.col(column), CANDIDATE)).withColumn("type", F.expr("r.check['type']")))


def _map_of(values: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{q(k)}, {v}" for k, v in values.items()) + ")[type]"


def shape_errors(candidates: DataFrame) -> DataFrame:
    """Adds ``errors`` (array<string>, empty = well-formed) to parsed candidates."""
    def one_word(field: str, words) -> str:
        return f"CASE WHEN r.{field} IS NULL OR NOT {one_of(f'r.{field}', words)} THEN '{field}: not one of {'/'.join(words)}' END"

    required = _map_of({k: array_of(v[0]) if v[0] else "CAST(array() AS array<string>)" for k, v in vocab.CHECK_PARAMETERS.items()})
    accepted = _map_of({k: array_of(("type", *v[0], *v[1])) for k, v in vocab.CHECK_PARAMETERS.items()})
    scopes = _map_of({k: array_of(v[0]) for k, v in vocab.CHECKS.items()})
    fewest = _map_of({k: str(v[1]) for k, v in vocab.CHECKS.items()})
    most = _map_of({k: str(v[2] or 1_000_000) for k, v in vocab.CHECKS.items()})

    def number(p: str) -> str:
        return f"try_cast(r.check['{p}'] AS DOUBLE)"
    words = [p for p in ("max_rate", "min", "max", "min_length", "max_length", "min_children", "tolerance_abs")]
    bad_numbers = [f"CASE WHEN r.check['{p}'] IS NOT NULL AND {number(p)} IS NULL THEN 'check.{p}: not a number' END" for p in words]
    known = f"type IS NOT NULL AND {one_of('type', vocab.CHECKS)}"
    problems = [
        "CASE WHEN r.name IS NULL THEN 'name: missing' END",
        one_word("category", vocab.CATEGORIES), one_word("dimension", vocab.DIMENSIONS), one_word("scope", vocab.SCOPES),
        f"CASE WHEN r.severity IS NOT NULL AND NOT {one_of('r.severity', vocab.SEVERITIES)} THEN 'severity: not one of {'/'.join(vocab.SEVERITIES)}' END",
        "CASE WHEN r.tolerance < 0 OR r.tolerance > 1 THEN 'tolerance: not between 0 and 1' END",
        "CASE WHEN r.target.entity IS NULL THEN 'target.entity: missing' END",
        f"CASE WHEN NOT ({known}) THEN 'check.type: unknown' END",
        f"CASE WHEN {known} AND size(array_except({required}, map_keys(map_filter(r.check, (k, v) -> v IS NOT NULL)))) > 0 THEN "
        f"concat('check: missing ', array_join(array_except({required}, map_keys(map_filter(r.check, (k, v) -> v IS NOT NULL))), ',')) END",
        f"CASE WHEN {known} AND size(array_except(map_keys(r.check), {accepted})) > 0 THEN "
        f"concat('check: unknown ', array_join(array_sort(array_except(map_keys(r.check), {accepted})), ',')) END",
        *bad_numbers,
        f"CASE WHEN type = 'null_rate_max' AND NOT {number('max_rate')} BETWEEN 0 AND 1 THEN 'check.max_rate: not between 0 and 1' END",
        "CASE WHEN type = 'range' AND r.check['min'] IS NULL AND r.check['max'] IS NULL THEN 'range needs min and/or max' END",
        f"CASE WHEN type = 'range' AND {number('min')} > {number('max')} THEN 'range min > max' END",
        f"CASE WHEN type = 'length_range' AND least({number('min_length')}, {number('max_length')}) < 0 THEN 'length_range: negative length' END",
        "CASE WHEN type IN ('allowed_values', 'not_placeholder') AND coalesce(size(from_json(r.check['values'], 'array<string>')), 0) < 1 "
        "AND r.check['values'] IS NOT NULL THEN 'check.values: empty' END",
        f"CASE WHEN type = 'has_children' AND {number('min_children')} < 1 THEN 'check.min_children: below 1' END",
        f"CASE WHEN type = 'aggregate_compare' AND {number('tolerance_abs')} < 0 THEN 'check.tolerance_abs: negative' END",
        f"CASE WHEN type = 'aggregate_compare' AND NOT {one_of('''r.check['operator']''', vocab.OPERATORS)} THEN 'check.operator: unknown' END",
        "CASE WHEN regex_problem IS NOT NULL THEN 'check.regex: invalid regex' END",
        f"CASE WHEN {known} AND r.scope IS NOT NULL AND NOT array_contains({scopes}, r.scope) THEN "
        f"concat('check \\'', type, '\\' needs scope ', array_join({scopes}, '/'), ', got \\'', r.scope, '\\'') END",
        f"CASE WHEN {known} AND NOT coalesce(size(r.target.columns), 0) BETWEEN {fewest} AND {most} THEN "
        f"concat('check \\'', type, '\\' needs ', CASE WHEN {fewest} = {most} THEN concat('exactly ', {fewest}) "
        f"ELSE concat('at least ', {fewest}) END, ' target column(s), got ', coalesce(size(r.target.columns), 0)) END",
        "CASE WHEN type = 'foreign_key' AND size(from_json(r.check['ref_columns'], 'array<string>')) <> size(r.target.columns) "
        "THEN 'foreign_key: ref_columns must pair 1:1 with target columns' END",
        "CASE WHEN startswith(type, 'hierarchy_') AND r.category <> 'hierarchy' THEN 'hierarchy checks must have category \\'hierarchy\\'' END"]
    return (candidates.withColumn("regex_problem", _regex_problem(F.expr("CASE WHEN type = 'pattern' THEN r.check['regex'] END")))
            .withColumn("errors", F.expr(f"array_compact(array({', '.join(problems)}))")).drop("regex_problem"))


def reference_errors(candidates: DataFrame, columns: DataFrame, hierarchies: DataFrame) -> DataFrame:
    """Adds ``ref_errors`` to parsed candidates: entities, columns, hierarchies, levels and expressions that do not exist.

    columns: entity, column. hierarchies: hierarchy_id, entity, levels. Both are schema-sized, so each is folded into
    one map and looked up in place - the candidates are not shuffled.
    """
    entities = columns.groupBy("entity").agg(F.array_sort(F.collect_set(F.lower("column"))).alias("known"))
    entity_map = entities.agg(F.map_from_entries(F.collect_list(F.struct("entity", "known"))).alias("m")).first()["m"]
    tree_map = hierarchies.agg(F.map_from_entries(F.collect_list(F.struct("hierarchy_id", F.struct("entity", "levels")))).alias("m")).first()["m"]
    ents = "map(" + ", ".join(f"{q(k)}, {array_of(v)}" for k, v in sorted(entity_map.items())) + ")"
    trees = "map(" + ", ".join(f"{q(k)}, struct({q(v['entity'])} AS entity, {array_of(v['levels'])} AS levels)"
                               for k, v in sorted(tree_map.items())) + ")" if tree_map else \
        "CAST(map() AS map<string, struct<entity:string,levels:array<string>>>)"

    def listed(param: str) -> str:
        return f"from_json(r.check['{param}'], 'array<string>')"

    def missing(names: str, entity: str, label: str) -> str:
        lost = f"array_except(transform({names}, c -> lower(c)), _e[{entity}])"
        return (f"CASE WHEN {names} IS NULL THEN NULL WHEN _e[{entity}] IS NULL THEN concat('{label}: unknown entity \\'', {entity}, '\\'') "
                f"WHEN size({lost}) > 0 THEN concat('{label}: unknown column(s) ', array_join(array_sort({lost}), ','), ' in \\'', {entity}, '\\'') END")

    child = "r.check['child_entity']"
    tree = "_h[r.check['hierarchy']]"
    problems = [
        "CASE WHEN _t IS NULL THEN concat('unknown entity \\'', r.target.entity, '\\'') END",
        *[f"CASE WHEN _t IS NOT NULL THEN {p} END" for p in (
            missing("r.target.columns", "r.target.entity", "target"),
            f"CASE WHEN type = 'foreign_key' THEN {missing(listed('ref_columns'), '''r.check['ref_entity']''', 'ref')} END",
            f"CASE WHEN type IN ('has_children', 'aggregate_compare') THEN {missing(listed('child_join_columns'), child, 'child join')} END",
            f"CASE WHEN type IN ('has_children', 'aggregate_compare') THEN {missing(listed('parent_join_columns'), 'r.target.entity', 'parent join')} END",
            f"CASE WHEN size({listed('child_join_columns')}) <> size({listed('parent_join_columns')}) THEN "
            "'child_join_columns and parent_join_columns must pair 1:1' END",
            f"CASE WHEN startswith(type, 'hierarchy_') AND {tree} IS NULL THEN concat('unknown hierarchy \\'', r.check['hierarchy'], '\\'') END",
            f"CASE WHEN type = 'hierarchy_attach_level' AND NOT array_contains({tree}.levels, r.check['level']) THEN "
            f"concat('level \\'', r.check['level'], '\\' is not one of ', array_join({tree}.levels, ',')) END",
            f"CASE WHEN type IN ('hierarchy_parent_level', 'hierarchy_acyclic') AND {tree}.entity <> r.target.entity THEN "
            f"concat('hierarchy \\'', r.check['hierarchy'], '\\' lives on \\'', {tree}.entity, '\\', not \\'', r.target.entity, '\\'') END",
            "CASE WHEN type = 'custom_sql' AND NOT r.check['sql'] RLIKE '(?is)^\\\\s*(select|with)\\\\b[^;]*$' THEN "
            "'custom_sql must be a single SELECT returning failing rows' END")]]
    out = (candidates.withColumn("_e", F.expr(ents)).withColumn("_h", F.expr(trees))
           .withColumn("_t", F.expr("_e[r.target.entity]")).withColumn("_c", F.expr(f"_e[{child}]")))
    checked = [("filter", F.col("r.filter"), "_t", False)] + [
        (p, F.expr(f"r.check['{p}']"), "_c" if p == "child_expression" else "_t", p == "child_expression")
        for p in ("expression", "when", "then", "child_expression", "parent_expression")]
    issues = [F.when(F.col(known).isNotNull(), F.concat(F.lit(f"{label}: "), expression_issue(text, F.col(known), aggregate)))
              for label, text, known, aggregate in checked]
    found = F.array_compact(F.concat(F.expr(f"array({', '.join(problems)})"), F.array(*issues)))
    return out.withColumn("ref_errors", found).drop("_e", "_h", "_t", "_c")


def primary_key_rule(primary_keys: dict[str, tuple[str, ...]]) -> str:
    """SQL over parsed candidates: a uniqueness or completeness rule on primary-key columns only."""
    known = "map(" + ", ".join(f"{q(e)}, {array_of(c)}" for e, c in primary_keys.items() if c) + ")"
    return (f"coalesce(type IN ('unique', 'not_null', 'null_rate_max') AND size(r.target.columns) > 0 "
            f"AND size(array_except(r.target.columns, {known}[r.target.entity])) = 0, false)")


def triage(candidates: DataFrame, columns: DataFrame, hierarchies: DataFrame, primary_keys: dict[str, tuple[str, ...]],
           asked_entity: str | None = None) -> DataFrame:
    """Adds outcome (valid, invalid, off_target, key_check) and problems. ``asked_entity`` names the column that holds
    the entity the candidate was requested for."""
    judged = reference_errors(shape_errors(parsed(candidates)), columns, hierarchies)
    off = f"r.target.entity <> {asked_entity}" if asked_entity else "false"
    outcome = (f"CASE WHEN size(errors) > 0 OR size(ref_errors) > 0 THEN 'invalid' WHEN {off} THEN 'off_target' "
               f"WHEN {primary_key_rule(primary_keys)} THEN 'key_check' ELSE 'valid' END")
    return judged.withColumn("outcome", F.expr(outcome)).withColumn(
        "problems", F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.col("ref_errors")))


def intake(candidates: DataFrame, columns: DataFrame, hierarchies: DataFrame) -> DataFrame:
    """Rule rows of the candidates that are well-formed and name only what exists: origin steward, approved.

    The judged rows are written once before they are filtered: a filter over the checks would be pushed into them and
    every later use would check again.
    """
    judged = reference_errors(shape_errors(parsed(candidates)), columns, hierarchies)
    kept = [c for c in candidates.columns if c != "rule"]
    rows = judged.selectExpr(*kept, "r.name AS name", "r.target.entity AS entity", "r.target.columns AS columns",
                             "get_json_object(rule, '$.check') AS check", "r.filter AS filter", "r.severity AS severity",
                             "coalesce(r.tolerance, 0D) AS tolerance", "'steward' AS origin", "'approved' AS status",
                             "size(errors) + size(ref_errors) AS problems")
    return cut_lineage(rows).where("problems = 0").drop("problems")
