"""Recommended rules, and scoring of profiles and rules against the planted defects."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import ledger, profiling as p, score
from plumbline.plans import profile as plan, recommend
from plumbline.plans.bitmap import RuleRun, run_rules
from plumbline.plans.suite import execute_rules
from plumbline import Constraints, Rule
from queries import checks
from queries.dirty import AS_OF, CONSTRAINTS, MODEL, Tables, _Bare, pick, with_views
from queries.ledger import DOCS, docs
from queries.profiling import profiles
from queries.semantic import model

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# ---- recommended rules ----------------------------------------------------------------------------
_BASE = """SELECT * FROM (VALUES
 ('customer_dirty', 'customer_dirty_nation', 'foreign_key', 'c_nationkey'), ('customer_dirty', 'customer_dirty_geo_tree', 'foreign_key', 'home_node'),
 ('customer_dirty', 'x', 'not_null', 'c_nationkey'), ('customer_dirty', 'x', 'not_null', 'home_node'), ('customer_dirty', 'x', 'allowed_values', 'c_mktsegment'),
 ('customer_dirty', 'x', 'pattern', 'email'), ('customer_dirty', 'x', 'pattern', 'phone'), ('customer_dirty', 'x', 'hierarchy_attach_level', 'home_node'),
 ('geo_tree', 'x', 'foreign_key', 'parent_id'), ('geo_tree', 'x', 'allowed_values', 'node_level'), ('geo_tree', 'x', 'hierarchy_parent_level', ''), ('geo_tree', 'x', 'hierarchy_acyclic', ''),
 ('lineitem_dirty', 'x', 'foreign_key', 'l_orderkey'), ('lineitem_dirty', 'x', 'not_null', 'l_orderkey'), ('lineitem_dirty', 'x', 'range', 'l_quantity'),
 ('lineitem_dirty', 'x', 'allowed_values', 'l_returnflag'), ('lineitem_dirty', 'x', 'allowed_values', 'l_linestatus'), ('lineitem_dirty', 'x', 'date_not_future', 'l_shipdate'),
 ('nation', 'x', 'unique', 'n_name'), ('nation', 'x', 'foreign_key', 'n_regionkey'), ('nation', 'x', 'not_null', 'n_regionkey'), ('region', 'x', 'unique', 'r_name'),
 ('orders_dirty', 'x', 'unique', 'order_number'), ('orders_dirty', 'x', 'foreign_key', 'o_custkey'), ('orders_dirty', 'x', 'not_null', 'o_custkey'),
 ('orders_dirty', 'x', 'allowed_values', 'o_orderstatus'), ('orders_dirty', 'x', 'allowed_values', 'o_orderpriority'), ('orders_dirty', 'x', 'pattern', 'order_number'),
 ('orders_dirty', 'x', 'date_not_future', 'o_orderdate')) v(entity, why, check_type, columns)"""


@register("baseline_rules", f"SELECT entity, check_type, columns FROM ({_BASE})")
def baseline_rules(spark, sf_dir):
    out = recommend.baseline_rules(model(spark, sf_dir))
    return out.select("entity", F.get_json_object("check", "$.type").alias("check_type"), F.array_join("columns", ",").alias("columns"))


@register("baseline_rule_texts")
def baseline_rule_texts(spark, sf_dir):
    return recommend.baseline_rules(model(spark, sf_dir)).select("entity", "name", "severity", "dimension", "check", "rationale")


def _baseline_objects(spark, sf_dir) -> list[Rule]:
    rows = recommend.baseline_rules(model(spark, sf_dir)).orderBy("entity", "name").collect()
    import json
    return [Rule(f"b{i}", r["entity"], json.loads(r["check"]), tuple(r["columns"]), r["name"], r["category"], r["dimension"], r["scope"],
                 severity=r["severity"], origin="heuristic") for i, r in enumerate(rows)]


@register("baseline_results")
def baseline_results(spark, sf_dir):
    """Recommended rules, run: the whole loop from tables to results."""
    m = model(spark, sf_dir)
    names = ("orders_dirty", "customer_dirty", "lineitem_dirty", "geo_tree", "nation", "region")
    out = execute_rules(pick(Tables(spark, sf_dir), *names), _baseline_objects(spark, sf_dir), m.rules_model, AS_OF, m.counted)
    return out.select("name", "entity", "check_type", "severity", "total", "failed", "failure_rate", "passed", "error")


# ---- the answer key: one issue per planted branch ---------------------------------------------------
# issue -> (dimension, entity, table, column, key, predicate over the clean table's key)
ISSUES = {
    "PI01": ("completeness", "order", "orders_dirty", "o_custkey", "o_orderkey", "o_orderkey % 89 = 1 AND o_orderkey % 97 <> 0"),
    "PI02": ("referential_integrity", "order", "orders_dirty", "o_custkey", "o_orderkey", "o_orderkey % 97 = 0"),
    "PI03": ("validity", "order", "orders_dirty", "o_orderstatus", "o_orderkey", "o_orderkey % 401 = 3"),
    "PI04": ("validity", "order", "orders_dirty", "o_orderstatus", "o_orderkey", "o_orderkey % 409 = 4 AND o_orderkey % 401 <> 3"),
    "PI05": ("validity", "order", "orders_dirty", "o_orderstatus", "o_orderkey", "o_orderkey % 419 = 5 AND o_orderkey % 409 <> 4 AND o_orderkey % 401 <> 3"),
    "PI06": ("validity", "order", "orders_dirty", "o_totalprice", "o_orderkey", "o_orderkey % 301 = 6"),
    "PI07": ("completeness", "order", "orders_dirty", "o_totalprice", "o_orderkey", "o_orderkey % 307 = 7 AND o_orderkey % 301 <> 6"),
    "PI08": ("timeliness", "order", "orders_dirty", "o_orderdate", "o_orderkey", "o_orderkey % 701 = 8"),
    "PI09": ("accuracy", "order", "orders_dirty", "o_orderdate", "o_orderkey", "o_orderkey % 709 = 9 AND o_orderkey % 701 <> 8"),
    "PI10": ("uniqueness", "order", "orders_dirty", "order_number", "o_orderkey", "o_orderkey % 503 IN (9, 10)"),
    "PI11": ("completeness", "customer", "customer_dirty", "email", "c_custkey", "c_custkey % 31 = 0"),
    "PI12": ("validity", "customer", "customer_dirty", "email", "c_custkey", "c_custkey % 101 = 1 AND c_custkey % 31 <> 0"),
    "PI13": ("uniqueness", "customer", "customer_dirty", "email", "c_custkey", "c_custkey % 51 = 2 AND c_custkey % 101 <> 1 AND c_custkey % 31 <> 0"),
    "PI14": ("validity", "customer", "customer_dirty", "phone", "c_custkey", "c_custkey % 61 = 0"),
    "PI15": ("completeness", "customer", "customer_dirty", "phone", "c_custkey", "c_custkey % 67 = 1 AND c_custkey % 61 <> 0"),
    "PI16": ("referential_integrity", "customer", "customer_dirty", "c_nationkey", "c_custkey", "c_custkey % 71 = 0"),
    "PI17": ("validity", "customer", "customer_dirty", "c_mktsegment", "c_custkey", "c_custkey % 131 = 0"),
    "PI18": ("validity", "customer", "customer_dirty", "c_mktsegment", "c_custkey", "c_custkey % 137 = 1 AND c_custkey % 131 <> 0"),
    "PI19": ("business_rule", "order", "orders_dirty", "o_orderkey", "o_orderkey", "NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_orderkey FROM {lineitem}) l WHERE l_orderkey = o_orderkey)"),
}
SOURCE = {"orders_dirty": "orders", "customer_dirty": "customer"}
KEYS = " UNION ALL ".join(f"SELECT '{i}' AS issue_id, '{d}' AS dimension, '{e}' AS entity, '{t}' AS table_name, '{c}' AS column_name, CAST({k} AS STRING) AS key "
                          f"FROM {{{SOURCE[t]}}} WHERE {w}" for i, (d, e, t, c, k, w) in ISSUES.items())
_KEYS_SQL = "(" + KEYS.format_map(_Bare()) + ")"


def issue_keys(spark, sf_dir):
    """The planted keys: one scan of a table for all issues that a row shows by itself, and one for each that needs another table."""
    tables, parts = Tables(spark, sf_dir), []
    for source in sorted(set(SOURCE.values())):
        own = {i: x for i, x in ISSUES.items() if SOURCE[x[2]] == source}
        hits = [F.when(F.expr(w), F.struct(*[F.lit(v).alias(n) for n, v in (("issue_id", i), ("dimension", d), ("entity", e), ("table_name", t), ("column_name", c))],
                                           F.col(k).cast("string").alias("key"))) for i, (d, e, t, c, k, w) in own.items() if "{" not in w]
        parts.append(tables[source].select(F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull()))))
        parts += [tables.sql(text) for text in KEYS.split(" UNION ALL ") if "FROM {" + source + "}" in text and "EXISTS" in text]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_COVERED_RULES = ["chk_not_null", "chk_foreign_key", "chk_allowed_values", "chk_range", "chk_date_not_future", "chk_not_placeholder", "chk_unique",
                  "chk_null_rate", "chk_pattern", "chk_length_range", "chk_unique_filtered", "chk_has_children"]
_WITH = checks._with(_COVERED_RULES)
_ALARMS = " UNION ".join(
    f"SELECT '{k}' AS rule_id, '{checks.CHECKS[k][0].entity}' AS entity, CAST({checks.KEY_OF[checks.CHECKS[k][0].entity]} AS VARCHAR) AS key FROM ({checks.CHECKS[k][3]}) "
    f"WHERE (SELECT round((SELECT count(*) FROM ({checks.CHECKS[k][3]})) / count(*), 6) FROM ({checks.CHECKS[k][2]})) > {checks.CHECKS[k][0].limit}"
    for k in _COVERED_RULES)
_EXECUTION = (_WITH + f", keys AS {_KEYS_SQL}, alarms AS ({_ALARMS}), scored AS (SELECT issue_id, any_value(dimension) AS dimension, count(*) AS affected, "
              "count(*) FILTER ((entity, key) IN (SELECT (entity, key) FROM alarms)) AS flagged FROM keys GROUP BY 1), "
              "status AS (SELECT *, CASE WHEN flagged / affected >= 0.5 THEN 'caught' WHEN flagged > 0 THEN 'partial' ELSE 'missed' END AS status FROM scored)\n")


def _executed(spark, sf_dir) -> RuleRun:
    rules = [checks.CHECKS[k][0] for k in _COVERED_RULES]
    tables = pick(Tables(spark, sf_dir), "orders_dirty", "customer_dirty", "lineitem_dirty")
    return run_rules(tables, rules, MODEL, AS_OF)


@register("execution_coverage", _EXECUTION + "SELECT issue_id, dimension, affected, flagged, status FROM status")
def execution_coverage(spark, sf_dir):
    return score.coverage_of_alarms(issue_keys(spark, sf_dir), _executed(spark, sf_dir).alarms())


@register("unexplained_failures", _EXECUTION + f"""SELECT rule_id, (SELECT count(*) FROM alarms a WHERE a.rule_id = r.rule_id AND (entity, key) NOT IN (SELECT (entity, key) FROM keys)) AS unexplained
 FROM (VALUES {", ".join(f"('{k}')" for k in _COVERED_RULES)}) r(rule_id)""")
def unexplained_failures(spark, sf_dir):
    return _executed(spark, sf_dir).unexplained(issue_keys(spark, sf_dir).select("entity", "key"))


@register("coverage_by_dimension", _EXECUTION + """SELECT coalesce(dimension, 'all') AS dimension, count(*) FILTER (status = 'caught') AS hit, count(*) AS total
 FROM status GROUP BY ROLLUP (dimension)""")
def coverage_by_dimension(spark, sf_dir):
    return score.by_dimension(execution_coverage(spark, sf_dir), "status = 'caught'")


@register("profile_coverage", with_views("orders_dirty", "customer_dirty") + f""", keys AS {_KEYS_SQL}
SELECT issue_id, dimension, CASE WHEN dimension IN ('completeness', 'referential_integrity', 'timeliness') OR issue_id IN ('PI06', 'PI09', 'PI10', 'PI12') THEN 'visible'
 WHEN issue_id IN ('PI03', 'PI04', 'PI05') THEN CASE WHEN (SELECT sum(n) FILTER (n / t >= 0.02) / any_value(t) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM orders_dirty GROUP BY o_orderstatus)) >= 0.9 THEN 'visible' ELSE 'hint' END
 WHEN issue_id IN ('PI17', 'PI18') THEN CASE WHEN (SELECT sum(n) FILTER (n / t >= 0.02) / any_value(t) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM customer_dirty GROUP BY c_mktsegment)) >= 0.9 THEN 'visible' ELSE 'hint' END
 WHEN issue_id = 'PI13' THEN CASE WHEN (SELECT count(DISTINCT email) / count(email) FROM customer_dirty) >= 0.95 THEN 'visible' ELSE 'hint' END
 WHEN issue_id = 'PI14' THEN CASE WHEN (SELECT count(*) FILTER (length(phone) = 8) / count(phone) FROM customer_dirty) < 0.02 THEN 'visible' ELSE 'hint' END
 WHEN issue_id = 'PI19' THEN 'hint' ELSE 'not visible' END AS status
FROM (SELECT DISTINCT issue_id, dimension FROM keys)""")
def profile_coverage(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    links = Constraints(foreign_keys=tuple(k for k in CONSTRAINTS.foreign_keys if k[0] in SOURCE))
    found = plan.signals(profiles(spark, sf_dir, tuple(SOURCE)), p.fk_orphans(tables, links))
    issues = (issue_keys(spark, sf_dir).groupBy("issue_id", "dimension", F.col("table_name").alias("table"))
              .agg(F.collect_set("column_name").alias("columns")))
    return score.profile_coverage(issues, found)



@register("rule_coverage", f"""WITH d AS (SELECT *, created_at < TIMESTAMP '2024-01-16' AS early FROM ({DOCS.format_map(_Bare())})),
 lib AS (SELECT min(seq) AS rule_id, early, entity, event_type, CASE event_type WHEN 'click' THEN floor(value) END AS top,
  CASE event_type WHEN 'purchase' THEN user_id % 5 WHEN 'error' THEN user_id % 7 END AS k, scope_filter FROM d GROUP BY ALL)
SELECT r.rule_id AS reference_id, count(*) AS covering FROM lib r JOIN lib g ON g.entity = r.entity AND r.early AND NOT g.early WHERE CASE g.event_type
 WHEN 'error' THEN (r.event_type = 'error' OR r.event_type = 'click') AND (r.scope_filter IS NULL OR g.scope_filter IS NOT NULL)
 WHEN 'click' THEN r.event_type = 'click' AND g.top <= r.top WHEN 'purchase' THEN r.event_type = 'purchase' AND r.k = g.k
 ELSE r.event_type = g.event_type END GROUP BY 1""")
def rule_coverage(spark, sf_dir):
    """How far later rules cover the earlier ones; a library holds each fingerprint once."""
    every = ledger.canonical(docs(spark, sf_dir))
    early = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    sides = [ledger.first_of_each(every.where(when)).select("rule_id", "entity", "columns", "check", "filter") for when in (~early, early)]
    return score.rule_coverage(*sides).groupBy("reference_id").agg(F.count(F.lit(1)).alias("covering"))
