"""The 18 checks, the fused suite, failing rows and examples."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Entity, Model, Rule
from plumbline.plans.bitmap import run_rules
from plumbline.plans.suite import execute_rules
from queries.dirty import AS_OF, MODEL, Tables, pick, with_views

EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
O, C, L, G = "order", "customer", "lineitem", "geo_node"
VIEW_OF = {O: "orders_dirty", C: "customer_dirty", L: "lineitem_dirty", G: "geo_nodes"}


def _rule(key: str, entity: str, check: dict, *columns: str, **more) -> Rule:
    return Rule(key, entity, check, tuple(columns), name=key.replace("_", " "), **more)


# query key -> (rule, views it needs, oracle: rows in scope, oracle: failing rows)
CHECKS: dict[str, tuple[Rule, tuple[str, ...], str, str]] = {
    "chk_not_null": (
        _rule("chk_not_null", O, {"type": "not_null"}, "o_custkey", dimension="completeness"), ("orders_dirty",),
        "SELECT * FROM orders_dirty", "SELECT * FROM orders_dirty WHERE o_custkey IS NULL"),
    "chk_null_rate": (
        _rule("chk_null_rate", C, {"type": "null_rate_max", "max_rate": 0.05}, "email", dimension="completeness"),
        ("customer_dirty",), "SELECT * FROM customer_dirty", "SELECT * FROM customer_dirty WHERE email IS NULL"),
    "chk_unique": (
        _rule("chk_unique", O, {"type": "unique"}, "order_number", dimension="uniqueness"), ("orders_dirty",),
        "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty WHERE order_number IN (SELECT order_number FROM orders_dirty GROUP BY 1 HAVING count(*) > 1)"),
    "chk_unique_filtered": (
        _rule("chk_unique_filtered", C, {"type": "unique"}, "email", dimension="uniqueness", filter="c_acctbal > 0"),
        ("customer_dirty",), "SELECT * FROM customer_dirty WHERE c_acctbal > 0",
        "SELECT * FROM customer_dirty WHERE c_acctbal > 0 AND email IN "
        "(SELECT email FROM customer_dirty WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
    "chk_unique_composite": (
        _rule("chk_unique_composite", L, {"type": "unique"}, "l_orderkey", "l_linenumber", dimension="uniqueness",
              scope="table"), ("lineitem_dirty",), "SELECT * FROM lineitem_dirty",
        "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem_dirty "
        "WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) WHERE copies > 1"),
    "chk_allowed_values": (
        _rule("chk_allowed_values", O, {"type": "allowed_values", "values": ["O", "F", "P"]}, "o_orderstatus"),
        ("orders_dirty",), "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty WHERE o_orderstatus NOT IN ('O', 'F', 'P')"),
    "chk_allowed_values_ci": (
        _rule("chk_allowed_values_ci", O, {"type": "allowed_values", "values": ["o", "f", "p"], "case_sensitive": False},
              "o_orderstatus"), ("orders_dirty",), "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty WHERE upper(o_orderstatus) NOT IN ('O', 'F', 'P')"),
    "chk_allowed_values_number": (
        _rule("chk_allowed_values_number", L, {"type": "allowed_values", "values": [1, 2, 3, 4, 5, 6]}, "l_linenumber"),
        ("lineitem_dirty",), "SELECT * FROM lineitem_dirty",
        "SELECT * FROM lineitem_dirty WHERE l_linenumber NOT IN (1, 2, 3, 4, 5, 6)"),
    "chk_pattern": (
        _rule("chk_pattern", C, {"type": "pattern", "regex": EMAIL}, "email"), ("customer_dirty",),
        "SELECT * FROM customer_dirty",
        f"SELECT * FROM customer_dirty WHERE NOT regexp_matches(email, '{EMAIL}')"),
    "chk_pattern_filtered": (
        _rule("chk_pattern_filtered", C, {"type": "pattern", "regex": r"^\+91\d{10}$"}, "phone",
              filter="c_mktsegment = 'BUILDING'"), ("customer_dirty",),
        "SELECT * FROM customer_dirty WHERE c_mktsegment = 'BUILDING'",
        r"SELECT * FROM customer_dirty WHERE c_mktsegment = 'BUILDING' AND NOT regexp_matches(phone, '^\+91\d{10}$')"),
    "chk_range": (
        _rule("chk_range", O, {"type": "range", "min": 0}, "o_totalprice"), ("orders_dirty",),
        "SELECT * FROM orders_dirty", "SELECT * FROM orders_dirty WHERE o_totalprice < 0"),
    "chk_range_both": (
        _rule("chk_range_both", L, {"type": "range", "min": 1, "max": 100}, "l_quantity"), ("lineitem_dirty",),
        "SELECT * FROM lineitem_dirty", "SELECT * FROM lineitem_dirty WHERE l_quantity < 1 OR l_quantity > 100"),
    "chk_range_open": (
        _rule("chk_range_open", L, {"type": "range", "min": 0, "max": 1, "inclusive": False}, "l_discount"),
        ("lineitem_dirty",), "SELECT * FROM lineitem_dirty",
        "SELECT * FROM lineitem_dirty WHERE l_discount <= 0 OR l_discount >= 1"),
    "chk_length_range": (
        _rule("chk_length_range", C, {"type": "length_range", "min_length": 13, "max_length": 13}, "phone"),
        ("customer_dirty",), "SELECT * FROM customer_dirty",
        "SELECT * FROM customer_dirty WHERE length(phone) < 13 OR length(phone) > 13"),
    "chk_date_not_future": (
        _rule("chk_date_not_future", O, {"type": "date_not_future"}, "o_orderdate", dimension="timeliness"),
        ("orders_dirty",), "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty WHERE o_orderdate > DATE '2026-01-01'"),
    "chk_not_placeholder": (
        _rule("chk_not_placeholder", O, {"type": "not_placeholder", "values": ["1900-01-01", "9999-12-31"]},
              "o_orderdate", dimension="accuracy"), ("orders_dirty",), "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty WHERE CAST(o_orderdate AS VARCHAR) IN ('1900-01-01', '9999-12-31')"),
    "chk_row_condition": (
        _rule("chk_row_condition", L, {"type": "row_condition", "expression": "l_extendedprice >= l_quantity"},
              "l_extendedprice", "l_quantity", scope="row", dimension="consistency"), ("lineitem_dirty",),
        "SELECT * FROM lineitem_dirty", "SELECT * FROM lineitem_dirty WHERE NOT (l_extendedprice >= l_quantity)"),
    "chk_row_condition_dates": (
        _rule("chk_row_condition_dates", L,
              {"type": "row_condition", "expression": "l_shipdate <= DATE_ADD(DATE '1996-02-29', 4, 'YEAR')"},
              "l_shipdate", scope="row", dimension="timeliness", filter="l_linestatus = 'F'"), ("lineitem_dirty",),
        "SELECT * FROM lineitem_dirty WHERE l_linestatus = 'F'",
        "SELECT * FROM lineitem_dirty WHERE l_linestatus = 'F' AND NOT (l_shipdate <= DATE '2000-02-29')"),
    "chk_conditional": (
        _rule("chk_conditional", O, {"type": "conditional", "when": "o_orderstatus = 'F'", "then": "o_totalprice IS NOT NULL"},
              "o_orderstatus", "o_totalprice", scope="row", dimension="consistency"), ("orders_dirty",),
        "SELECT * FROM orders_dirty WHERE o_orderstatus = 'F'",
        "SELECT * FROM orders_dirty WHERE o_orderstatus = 'F' AND o_totalprice IS NULL"),
    "chk_foreign_key": (
        _rule("chk_foreign_key", O, {"type": "foreign_key", "ref_entity": C, "ref_columns": ["c_custkey"]}, "o_custkey",
              scope="cross_table", dimension="referential_integrity"), ("orders_dirty", "customer_dirty"),
        "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty t WHERE o_custkey IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM customer_dirty p WHERE p.c_custkey = t.o_custkey)"),
    "chk_foreign_key_composite": (
        _rule("chk_foreign_key_composite", O,
              {"type": "foreign_key", "ref_entity": L, "ref_columns": ["l_orderkey", "l_linenumber"]},
              "o_orderkey", "o_custkey", scope="cross_table", dimension="referential_integrity"),
        ("orders_dirty", "lineitem_dirty"), "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty t WHERE o_custkey IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM lineitem_dirty p WHERE p.l_orderkey = t.o_orderkey AND p.l_linenumber = t.o_custkey)"),
    "chk_has_children": (
        _rule("chk_has_children", O, {"type": "has_children", "child_entity": L, "child_join_columns": ["l_orderkey"],
                                      "parent_join_columns": ["o_orderkey"]},
              scope="cross_table", category="business", dimension="consistency"), ("orders_dirty", "lineitem_dirty"),
        "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem_dirty)"),
    "chk_has_children_min": (
        _rule("chk_has_children_min", C, {"type": "has_children", "child_entity": O, "child_join_columns": ["o_custkey"],
                                          "parent_join_columns": ["c_custkey"], "min_children": 8},
              scope="cross_table", category="business", dimension="consistency", tolerance=0.5),
        ("orders_dirty", "customer_dirty"), "SELECT * FROM customer_dirty",
        "SELECT * FROM customer_dirty LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders_dirty GROUP BY 1) "
        "ON o_custkey = c_custkey WHERE coalesce(n, 0) < 8"),
    "chk_aggregate_equal": (
        _rule("chk_aggregate_equal", O,
              {"type": "aggregate_compare", "child_entity": L, "child_join_columns": ["l_orderkey"],
               "parent_join_columns": ["o_orderkey"], "child_expression": "SUM(l_extendedprice)", "operator": "=",
               "parent_expression": "o_totalprice", "tolerance_abs": 100000.015},
              scope="cross_table", category="business", dimension="consistency"), ("orders_dirty", "lineitem_dirty"),
        "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem_dirty GROUP BY 1) "
        "ON l_orderkey = o_orderkey WHERE abs(o_totalprice - s) > 100000.015"),
    "chk_aggregate_order": (
        _rule("chk_aggregate_order", O,
              {"type": "aggregate_compare", "child_entity": L, "child_join_columns": ["l_orderkey"],
               "parent_join_columns": ["o_orderkey"], "child_expression": "MIN(l_shipdate)", "operator": "<=",
               "parent_expression": "o_orderdate"},
              scope="cross_table", category="business", dimension="timeliness"), ("orders_dirty", "lineitem_dirty"),
        "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem_dirty GROUP BY 1) "
        "ON l_orderkey = o_orderkey WHERE NOT (o_orderdate <= s)"),
    "chk_hierarchy_parent_level": (
        _rule("chk_hierarchy_parent_level", G, {"type": "hierarchy_parent_level", "hierarchy": "geo"},
              scope="table", category="hierarchy", dimension="consistency"), ("geo_nodes",),
        "SELECT * FROM geo_nodes",
        "SELECT * FROM geo_nodes t LEFT JOIN geo_nodes p ON p.node_id = t.parent_id WHERE "
        "(t.node_level = 'REGION' AND t.parent_id IS NOT NULL) "
        "OR (t.node_level = 'NATION' AND (p.node_level IS NULL OR p.node_level <> 'REGION')) "
        "OR (t.node_level = 'SITE' AND (p.node_level IS NULL OR p.node_level <> 'NATION')) "
        "OR t.node_level IS NULL OR t.node_level NOT IN ('REGION', 'NATION', 'SITE')"),
    "chk_hierarchy_acyclic": (
        _rule("chk_hierarchy_acyclic", G, {"type": "hierarchy_acyclic", "hierarchy": "geo"}, scope="table",
              category="hierarchy", dimension="consistency", severity="critical"), ("geo_nodes",),
        "SELECT * FROM geo_nodes",
        "SELECT * FROM geo_nodes WHERE node_id IN (SELECT start FROM walk WHERE start = node)"),
    "chk_hierarchy_attach_level": (
        _rule("chk_hierarchy_attach_level", C, {"type": "hierarchy_attach_level", "hierarchy": "geo", "level": "NATION"},
              "home_node", scope="cross_table", category="hierarchy", dimension="consistency"),
        ("customer_dirty", "geo_nodes"), "SELECT * FROM customer_dirty",
        "SELECT * FROM customer_dirty JOIN geo_nodes ON node_id = home_node WHERE node_level <> 'NATION'"),
    "chk_custom_sql": (
        _rule("chk_custom_sql", O,
              {"type": "custom_sql", "sql": "SELECT o_orderkey, o_totalprice FROM orders_dirty WHERE o_totalprice < 0 AND "
                                            "o_custkey IN (SELECT c_custkey FROM customer_dirty WHERE c_acctbal > 0)"},
              scope="cross_table", category="business"), ("orders_dirty", "customer_dirty"), "SELECT * FROM orders_dirty",
        "SELECT * FROM orders_dirty WHERE o_totalprice < 0 AND o_custkey IN "
        "(SELECT c_custkey FROM customer_dirty WHERE c_acctbal > 0)"),
}
KEY_OF = {O: "o_orderkey", C: "c_custkey", G: "node_id",
          L: "'{' || concat_ws(',', '\"l_orderkey\":' || l_orderkey, '\"l_linenumber\":' || l_linenumber) || '}'"}
# failing rows of lineitem are named by two columns; other queries use it without a key
LISTING = Model(MODEL.entities | {L: Entity(L, VIEW_OF[L], ("l_orderkey", "l_linenumber"))}, MODEL.hierarchies)

_WALK = (", walk AS (SELECT node_id AS start, parent_id AS node FROM geo_nodes WHERE parent_id IN (SELECT node_id FROM geo_nodes) "
         "UNION SELECT w.start, g.parent_id FROM walk w JOIN geo_nodes g ON g.node_id = w.node "
         "WHERE g.parent_id IN (SELECT node_id FROM geo_nodes))")


def _with(keys: list[str]) -> str:
    views = list(dict.fromkeys(v for k in keys for v in CHECKS[k][1]))
    acyclic = "chk_hierarchy_acyclic" in keys
    return with_views(*views, recursive=acyclic) + (_WALK if acyclic else "")


def _totals_sql(key: str) -> str:
    rule, _, scope, failing = CHECKS[key]
    return (f"SELECT '{key}' AS rule_id, (SELECT count(*) FROM ({scope})) AS total, "
            f"(SELECT count(*) FROM ({failing})) AS failed, {rule.limit} AS allowed")


def _result_sql(keys: list[str]) -> str:
    return (_with(keys) + ", counted AS (" + "\nUNION ALL ".join(_totals_sql(k) for k in keys) + ")\n"
            "SELECT rule_id, total, failed, round(failed / total, 6) AS failure_rate, "
            "round(failed / total, 6) <= allowed AS passed FROM counted")


def _single(key: str):
    def run(spark, sf_dir):
        rule, views, _, _ = CHECKS[key]
        out = execute_rules(pick(Tables(spark, sf_dir), *views), [rule], MODEL, AS_OF)
        return out.select("rule_id", "total", "failed", "failure_rate", "passed")
    return run


ALL_VIEWS = ("orders_dirty", "customer_dirty", "lineitem_dirty", "geo_nodes")
SUITE = list(CHECKS)
LISTED = [k for k in SUITE if k != "chk_custom_sql"]
RULES = [CHECKS[k][0] for k in SUITE]


def rule_suite_results(spark, sf_dir):
    out = run_rules(pick(Tables(spark, sf_dir), *ALL_VIEWS), RULES, MODEL, AS_OF).results()
    return out.select("rule_id", "entity", "check_type", "severity", "total", "failed", "failure_rate", "passed", "error")


def _suite_sql() -> str:
    facts = ", ".join(f"('{k}', '{CHECKS[k][0].entity}', '{CHECKS[k][0].type}', '{CHECKS[k][0].severity}')" for k in SUITE)
    return (f"SELECT r.rule_id, entity, check_type, severity, total, failed, failure_rate, passed, CAST(NULL AS VARCHAR) AS error "
            f"FROM ({_result_sql(SUITE)}) r JOIN (VALUES {facts}) f(rule_id, entity, check_type, severity) ON r.rule_id = f.rule_id")


def rule_violations(spark, sf_dir):
    out = run_rules(pick(Tables(spark, sf_dir), *ALL_VIEWS), [CHECKS[k][0] for k in LISTED], LISTING, AS_OF).violations()
    return out.select("rule_id", "entity", "key")


def _violations_sql() -> str:
    parts = []
    for k in LISTED:
        rule = CHECKS[k][0]
        failing = CHECKS[k][3].replace("SELECT * FROM geo_nodes t LEFT", "SELECT t.node_id FROM geo_nodes t LEFT")
        parts.append(f"SELECT '{k}' AS rule_id, '{rule.entity}' AS entity, CAST({KEY_OF[rule.entity]} AS VARCHAR) AS key FROM ({failing})")
    return _with(LISTED) + "\n" + "\nUNION ALL ".join(parts)


def violation_examples_query(spark, sf_dir):
    rules = [CHECKS[k][0] for k in LISTED + ["chk_custom_sql"]]
    out = run_rules(pick(Tables(spark, sf_dir), *ALL_VIEWS), rules, LISTING, AS_OF).examples()
    return out.select("rule_id", "entity", F.col("example_no").cast("bigint").alias("example_no"), "key",
                      F.array_join(F.transform(F.array_sort(F.map_entries("shown")),
                                               lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))),
                                   "; ").alias("shown"))


_MASK = ("CASE WHEN {0} IS NULL THEN NULL WHEN contains({0}, '@') THEN concat(substr({0}, 1, 1), '***@', substr(split_part({0}, '@', 2), 1, 1), '***.', "
         "split_part({0}, '.', -1)) WHEN length({0}) <= 4 THEN repeat('*', length({0})) "
         "ELSE concat(substr({0}, 1, 2), regexp_replace(substr({0}, 3, length({0}) - 4), '[A-Za-z0-9]', '*', 'g'), right({0}, 2)) END")


def _examples_sql() -> str:
    pii = MODEL.entities[C].pii
    parts = []
    for k in LISTED:
        rule = CHECKS[k][0]
        failing = CHECKS[k][3].replace("SELECT * FROM geo_nodes t LEFT", "SELECT t.* FROM geo_nodes t LEFT")
        key = KEY_OF[rule.entity]
        columns = ["node_id", "parent_id"] if k == "chk_hierarchy_acyclic" else list(dict.fromkeys([*LISTING.entities[rule.entity].primary_key, *rule.columns]))
        value = {c: _MASK.format(c) if c in pii else f"CAST({c} AS VARCHAR)" for c in columns}
        as_json = " || ',' || ".join(f"'\"{c}\":' || coalesce('\"' || {value[c]} || '\"', 'null')" for c in columns)
        shown = " || '; ' || ".join(
            f"'{c}=' || coalesce({value[c]}, '-')" for c in sorted(columns))
        parts.append(f"SELECT '{k}' AS rule_id, '{rule.entity}' AS entity, CAST({key} AS VARCHAR) AS key, {as_json} AS pos, {shown} AS shown "
                     f"FROM ({failing})")
    parts.append("SELECT 'chk_custom_sql' AS rule_id, 'order' AS entity, NULL AS key, "
                 "'\"o_orderkey\":\"' || o_orderkey || '\"' AS pos, "
                 "'o_orderkey=' || o_orderkey || '; o_totalprice=' || o_totalprice AS shown FROM (" + CHECKS["chk_custom_sql"][3] + ")")
    return (_with(LISTED + ["chk_custom_sql"]) + ", listed AS (" + "\nUNION ALL ".join(parts) + "), numbered AS (SELECT *, row_number() OVER "
            "(PARTITION BY rule_id ORDER BY length(key), key, pos) AS example_no FROM listed) "
            "SELECT rule_id, entity, example_no, key, shown FROM numbered WHERE example_no <= 5")


QUERIES = {k: _single(k) for k in CHECKS}
QUERIES |= {"rule_suite_results": rule_suite_results, "rule_violations": rule_violations,
            "violation_examples": violation_examples_query}
ORACLE = {k: _result_sql([k]) for k in CHECKS}
ORACLE |= {"rule_suite_results": _suite_sql(), "rule_violations": _violations_sql(), "violation_examples": _examples_sql()}
