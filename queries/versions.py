"""Model versions: drift, merging, proposals, integrity. Two versions are derived from the event stream."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import merge, score
from plumbline.plans.digest import entity_digest as build_digest
from queries.dirty import Tables, _Bare
from queries.semantic import model

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def _sql(view: str) -> str:
    return "(" + view.format_map(_Bare()) + ")"


_ATTRIBUTES = """
SELECT concat('t', CAST(user_id AS STRING)) AS table_name, concat('c', CAST(event_id % 6 AS STRING)) AS column_name, concat('name', CAST(min(event_id) AS STRING)) AS name,
 CASE WHEN sum(event_id) % 3 = 0 THEN concat('text', CAST(max(event_id) AS STRING)) END AS description,
 CASE sum(event_id) % 4 WHEN 0 THEN 'amount' WHEN 1 THEN 'label' WHEN 2 THEN 'status_code' ELSE 'email' END AS semantic_type,
 CASE sum(event_id) % 4 WHEN 0 THEN 'measure' WHEN 1 THEN 'attribute' WHEN 2 THEN 'dimension' ELSE 'attribute' END AS role,
 CAST(sum(event_id) % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN sum(event_id) % 5 < 2 THEN 'llm' ELSE 'heuristic' END AS source,
 concat('note', CAST(sum(event_id) AS STRING)) AS note, sum(event_id) % 11 = 0 AS locked, sum(event_id) % 7 = 0 AS pii,
 split(concat_ws(',', max(CASE WHEN event_type = 'click' THEN 'click' END), max(CASE WHEN event_type = 'error' THEN 'error' END), max(CASE WHEN event_type = 'view' THEN 'view' END)), ',') AS allowed_values,
 split('x,y', ',') AS anomalies
FROM {{events}} WHERE {when} GROUP BY user_id, event_id % 6"""
V1 = _ATTRIBUTES.format(when="ts < TIMESTAMP_NTZ '2024-01-16' AND user_id % 17 <> 3")
V2 = _ATTRIBUTES.format(when="ts >= TIMESTAMP_NTZ '2024-01-16' AND user_id % 19 <> 4")
_D1, _D2 = (_sql(v.replace("TIMESTAMP_NTZ", "TIMESTAMP")) for v in (V1, V2))


def _versions(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return [tables.sql(v).withColumnsRenamed({"table_name": "table", "column_name": "column"}) for v in (V2, V1)]


@register("schema_drift", f"""WITH n AS (SELECT DISTINCT table_name AS t, column_name AS c FROM {_D2}), o AS (SELECT DISTINCT table_name AS t, column_name AS c FROM {_D1})
SELECT 'table added' AS change, t AS "table", NULL AS "column" FROM (SELECT DISTINCT t FROM n WHERE t NOT IN (SELECT t FROM o))
UNION ALL SELECT 'table removed', t, NULL FROM (SELECT DISTINCT t FROM o WHERE t NOT IN (SELECT t FROM n))
UNION ALL SELECT 'column added', t, c FROM n WHERE t IN (SELECT t FROM o) AND (t, c) NOT IN (SELECT (t, c) FROM o)
UNION ALL SELECT 'column removed', t, c FROM o WHERE t IN (SELECT t FROM n) AND (t, c) NOT IN (SELECT (t, c) FROM n)""")
def schema_drift(spark, sf_dir):
    return merge.schema_drift(*_versions(spark, sf_dir))


_UNCERTAIN = "n.source = 'heuristic' AND n.confidence < 0.9"
_SAME = ("list_sort(list_distinct(list_concat(n.allowed_values, n.anomalies))) = list_sort(list_distinct(list_concat(o.allowed_values, o.anomalies)))")


def _kept(column: str, when: str, shown: str = "{}") -> str:
    return (f"CASE WHEN o.table_name IS NOT NULL AND (o.locked OR coalesce({when}, false)) THEN {shown.format('o.' + column)} "
            f"ELSE {shown.format('n.' + column)} END AS {column}")


_SETTLED = f"({_UNCERTAIN} AND o.source = 'llm')"
_CONFIRMED = f"({_UNCERTAIN} AND o.source <> 'llm' AND o.semantic_type = n.semantic_type AND o.confidence > n.confidence)"


@register("merge_model_versions", f"""SELECT n.table_name AS "table", n.column_name AS "column", {_kept('name', 'n.description IS NULL')}, {_kept('description', 'n.description IS NULL')},
 {_kept('semantic_type', _SETTLED)}, {_kept('role', _SETTLED)}, {_kept('confidence', f'{_SETTLED} OR {_CONFIRMED}')}, {_kept('source', f'{_SETTLED} OR {_CONFIRMED}')},
 {_kept('note', f'{_SETTLED} OR {_CONFIRMED}')}, CASE WHEN o.locked THEN o.pii ELSE n.pii OR coalesce(o.pii, false) END AS pii,
 coalesce(o.locked, false) OR n.locked AS locked, {_kept('allowed_values', _SAME, "array_to_string({}, ',')")}, coalesce(o.locked, false) AS kept_locked
FROM {_D2} n LEFT JOIN {_D1} o ON o.table_name = n.table_name AND o.column_name = n.column_name""")
def merge_model_versions(spark, sf_dir):
    out = merge.merge_attributes(*_versions(spark, sf_dir))
    return out.withColumn("allowed_values", F.array_join("allowed_values", ",")).drop("anomalies")


_ENTITIES = """SELECT concat('t', CAST(c_custkey AS STRING)) AS table_name, concat('{v}', c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS description,
 concat('{v} row') AS grain, CASE WHEN c_nationkey {op} 10 THEN 'master' ELSE 'reference' END AS entity_type, CASE WHEN c_custkey % {m} = 1 THEN 'llm' ELSE 'heuristic' END AS source,
 c_custkey % {k} = 0 AS locked FROM {{customer}}"""
_E_NEW, _E_OLD = _ENTITIES.format(v="new", op="<", m=5, k=1000003), _ENTITIES.format(v="old", op=">", m=3, k=7)
_TEXT = "o.locked OR (n.source = 'heuristic' AND o.source <> 'heuristic')"


@register("merge_model_entities", f"""SELECT n.table_name AS "table", {", ".join(f"CASE WHEN {_TEXT} THEN o.{c} ELSE n.{c} END AS {c}" for c in ("name", "description", "grain", "source"))},
 CASE WHEN o.locked THEN o.entity_type ELSE n.entity_type END AS entity_type, CASE WHEN o.locked THEN o.locked ELSE n.locked END AS locked
FROM {_sql(_E_NEW)} n LEFT JOIN {_sql(_E_OLD)} o ON o.table_name = n.table_name""")
def merge_model_entities(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return merge.merge_entities(*[tables.sql(v).withColumnRenamed("table_name", "table") for v in (_E_NEW, _E_OLD)])


_R_OLD = """SELECT concat('r', CAST(o_custkey AS STRING)) AS relationship_id, concat('e', CAST(min(o_orderkey) % 50 AS STRING)) AS from_entity,
 concat('e', CAST(max(o_orderkey) % 50 AS STRING)) AS to_entity, sum(o_orderkey) % 3 = 0 AS locked FROM {orders} GROUP BY o_custkey"""
_R_NEW = """SELECT concat('r', CAST(c_custkey AS STRING)) AS relationship_id, concat('e', CAST(c_custkey % 45 AS STRING)) AS from_entity,
 concat('e', CAST(c_nationkey AS STRING)) AS to_entity, false AS locked FROM {customer} WHERE c_acctbal > 0"""
_E_IDS = "SELECT DISTINCT concat('e', CAST(c_custkey % 45 AS STRING)) AS entity_id FROM {customer}"
_LOST = "from_entity NOT IN (SELECT entity_id FROM e) OR to_entity NOT IN (SELECT entity_id FROM e)"


@register("merge_locked_relationships", f"""WITH n AS {_sql(_R_NEW)}, o AS (SELECT * FROM {_sql(_R_OLD)} WHERE locked), e AS {_sql(_E_IDS)}, kept AS (SELECT * FROM o WHERE NOT ({_LOST}))
SELECT relationship_id, from_entity, to_entity, locked, false AS dropped FROM n WHERE relationship_id NOT IN (SELECT relationship_id FROM kept)
UNION ALL SELECT relationship_id, from_entity, to_entity, locked, false FROM kept UNION ALL SELECT relationship_id, NULL, NULL, true, true FROM o WHERE {_LOST}""")
def merge_locked_relationships(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    merged, dropped = merge.merge_locked(tables.sql(_R_NEW), tables.sql(_R_OLD), "relationship_id", ["from_entity", "to_entity"], tables.sql(_E_IDS))
    gone = dropped.select("relationship_id", F.lit(None).cast("string").alias("from_entity"), F.lit(None).cast("string").alias("to_entity"),
                          F.lit(True).alias("locked"), F.lit(True).alias("dropped"))
    return merged.withColumn("dropped", F.lit(False)).unionByName(gone)


_PII = ", ".join(f"'{t}'" for t in vocab.PII_TYPES)
_ROLE = ("CASE {0} WHEN 'amount' THEN 'measure' WHEN 'status_code' THEN 'dimension' ELSE 'attribute' END")
_OPEN = "(p.table_name IS NOT NULL AND NOT a.locked)"
_CHANGED = f"({_OPEN} AND p.semantic_type <> a.semantic_type AND a.confidence < 0.9)"


@register("apply_proposals", f"""SELECT a.table_name AS entity_id, a.column_name AS "column", CASE WHEN {_OPEN} THEN coalesce(p.name, a.name) ELSE a.name END AS name,
 CASE WHEN {_OPEN} THEN coalesce(p.description, a.description) ELSE a.description END AS description,
 CASE WHEN {_CHANGED} THEN p.semantic_type ELSE a.semantic_type END AS semantic_type, CASE WHEN {_CHANGED} THEN {_ROLE.format('p.semantic_type')} ELSE a.role END AS role,
 a.pii OR coalesce({_OPEN} AND p.pii, false) OR coalesce({_CHANGED} AND p.semantic_type IN ({_PII}), false) AS pii,
 CASE WHEN {_CHANGED} THEN 0.8 WHEN {_OPEN} AND p.semantic_type = a.semantic_type AND a.confidence < 0.9 THEN 0.9 ELSE a.confidence END AS confidence,
 CASE WHEN {_CHANGED} THEN 'llm' ELSE a.source END AS source,
 nullif(concat_ws('; ', CASE WHEN {_CHANGED} THEN concat('semantic_type ', a.semantic_type, ' -> ', p.semantic_type, ' (', p.note, ')')
  WHEN {_OPEN} AND p.semantic_type <> a.semantic_type THEN concat('suggested ', p.semantic_type, ', kept ', a.semantic_type) END,
  CASE WHEN {_OPEN} AND p.pii AND NOT a.pii THEN 'flagged as PII' END), '') AS change
FROM {_D2} a LEFT JOIN {_D1} p ON p.table_name = a.table_name AND p.column_name = a.column_name""")
def apply_proposals(spark, sf_dir):
    new, old = (v.withColumnRenamed("table", "entity_id") for v in _versions(spark, sf_dir))
    proposals = old.select("entity_id", "column", "name", "description", "semantic_type", F.col("note").alias("reason"), "pii")
    own = new.select("entity_id", "column", "name", "description", "semantic_type", "role", "pii", "confidence", "source", "locked")
    return merge.apply_proposals(own, proposals).drop("locked")


_VERDICTS = """SELECT table_name AS entity_id, column_name, 'x' AS value, 'valid' AS verdict FROM {d} WHERE source = 'llm'
 UNION ALL SELECT table_name, column_name, 'click', 'invalid' FROM {d} WHERE pii OR confidence < 0.5"""
_GOOD, _BAD = "list_intersect(good, anomalies)", "list_intersect(bad, allowed_values)"
_LEFT = f"list_concat(list_filter(allowed_values, lambda v: NOT list_contains(coalesce({_BAD}, []), v)), coalesce({_GOOD}, []))"


@register("apply_verdicts", f"""WITH j AS (SELECT entity_id, column_name, coalesce(list(DISTINCT value) FILTER (verdict = 'valid'), []) AS good, coalesce(list(DISTINCT value) FILTER (verdict = 'invalid'), []) AS bad
  FROM ({_VERDICTS.format(d=_D1)}) GROUP BY 1, 2)
SELECT a.table_name AS entity_id, a.column_name AS "column", array_to_string(list_sort(CASE WHEN good IS NOT NULL AND NOT locked AND len({_LEFT}) > 0 THEN {_LEFT} ELSE allowed_values END), ',') AS allowed_values,
 array_to_string(list_sort(CASE WHEN good IS NOT NULL AND NOT locked THEN list_concat(list_filter(anomalies, lambda v: NOT list_contains({_GOOD}, v)), {_BAD}) ELSE anomalies END), ',') AS anomalies
FROM {_D2} a LEFT JOIN j ON j.entity_id = a.table_name AND j.column_name = a.column_name""")
def apply_verdicts(spark, sf_dir):
    new, old = (v.withColumnRenamed("table", "entity_id") for v in _versions(spark, sf_dir))
    verdicts = old.where("source = 'llm'").select("entity_id", "column", F.lit("x").alias("value"), F.lit("valid").alias("verdict")).unionByName(
        old.where("pii OR confidence < 0.5").select("entity_id", "column", F.lit("click").alias("value"), F.lit("invalid").alias("verdict")))
    out = merge.apply_verdicts(new.select("entity_id", "column", "locked", "allowed_values", "anomalies"), verdicts)
    return out.select("entity_id", "column", F.array_join(F.array_sort("allowed_values"), ",").alias("allowed_values"),
                      F.array_join(F.array_sort("anomalies"), ",").alias("anomalies"))


_REFS = """SELECT concat('order ', CAST(o_orderkey AS STRING)) AS place, concat('e', CAST(o_orderkey % 50 AS STRING)) AS entity_id, concat('c', CAST(o_custkey % 8 AS STRING)) AS col FROM {orders}"""
_HAVE = """SELECT DISTINCT concat('e', CAST(c_custkey % 45 AS STRING)) AS entity_id, concat('c', CAST(c_nationkey % 7 AS STRING)) AS col FROM {customer}"""


@register("model_dangling_refs", f"""SELECT place, r.entity_id, r.col AS "column", CASE WHEN r.entity_id NOT IN (SELECT entity_id FROM {_sql(_E_IDS)}) THEN 'unknown entity' ELSE 'unknown attribute' END AS problem
FROM {_sql(_REFS)} r LEFT JOIN {_sql(_HAVE)} h ON h.entity_id = r.entity_id AND h.col = r.col WHERE h.col IS NULL""")
def model_dangling_refs(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return merge.dangling_references(tables.sql(_E_IDS), tables.sql(_HAVE).withColumnRenamed("col", "column"),
                                     tables.sql(_REFS).withColumnRenamed("col", "column"))


@register("entity_digest")
def entity_digest(spark, sf_dir):
    return build_digest(model(spark, sf_dir))


@register("semantic_accuracy", f"""WITH g AS (SELECT * FROM {_D2}), r AS (SELECT * FROM {_D1}), b AS (SELECT g.semantic_type AS gt, r.semantic_type AS rt, g.role AS gr, r.role AS rr, g.pii AS gp, r.pii AS rp,
  list_sort(g.allowed_values) AS ga, list_sort(r.allowed_values) AS ra FROM g JOIN r ON g.table_name = r.table_name AND g.column_name = r.column_name)
SELECT 'semantic_type' AS aspect, count(*) FILTER (gt = rt) AS hit, count(*) AS total FROM b UNION ALL SELECT 'role', count(*) FILTER (gr = rr), count(*) FROM b
UNION ALL SELECT 'allowed_values', count(*) FILTER (ga = ra), count(*) FROM b UNION ALL SELECT 'pii_recall', count(*) FILTER (gp AND rp), count(*) FILTER (rp) FROM b
UNION ALL SELECT 'pii_precision', count(*) FILTER (gp AND rp), count(*) FILTER (gp) FROM b UNION ALL SELECT 'attribute_found', count(*), (SELECT count(*) FROM r) FROM b""")
def semantic_accuracy(spark, sf_dir):
    return score.semantic_accuracy(*_versions(spark, sf_dir))


@register("relationship_accuracy", f"""WITH g AS (SELECT DISTINCT from_entity, to_entity FROM {_sql(_R_NEW)}), r AS (SELECT DISTINCT from_entity, to_entity FROM {_sql(_R_OLD)})
SELECT 'relationships' AS aspect, (SELECT count(*) FROM g SEMI JOIN r USING (from_entity, to_entity)) AS hit, (SELECT count(*) FROM r) AS total,
 (SELECT count(*) FROM g ANTI JOIN r USING (from_entity, to_entity)) AS extra""")
def relationship_accuracy(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return score.set_accuracy(tables.sql(_R_NEW), tables.sql(_R_OLD), ["from_entity", "to_entity"], "relationships")
