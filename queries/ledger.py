"""Rule identity, duplicates, review ledger, candidate validation."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.skew import cut_lineage
from plumbline.operators import ledger, validate
from queries.dirty import Tables, _Bare, with_views

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def _sql(view: str) -> str:
    """A view text for DuckDB."""
    return "(" + view.format_map(_Bare()) + ")"


# a library of rule documents, one per event
DOCS = """
SELECT event_id AS rule_id, event_id AS seq, concat('src', CAST(user_id % 3 AS STRING)) AS source_id, ts AS created_at,
 concat('rule ', CAST(event_id AS STRING)) AS name, concat('e', CAST(user_id % 40 AS STRING)) AS entity,
 CASE event_type WHEN 'signup' THEN split('Part,ID', ',') ELSE split('Col_1', ',') END AS cols,
 CASE event_type
  WHEN 'click' THEN concat('{{"type":"range","min":0,"max":', CAST(CAST(floor(value) AS INT) AS STRING), CASE WHEN event_id % 2 = 0 THEN ',"inclusive":true' ELSE '' END, '}}')
  WHEN 'purchase' THEN concat('{{"values":["b","a","', CAST(user_id % 5 AS STRING), '","b"],"type":"allowed_values"}}')
  WHEN 'error' THEN concat('{{"type":"row_condition","expression":"', CASE event_id % 3 WHEN 0 THEN 'Col_1>=' WHEN 1 THEN 'col_1  >= ' ELSE 'COL_1 >=' END, CAST(user_id % 7 AS STRING), '"}}')
  WHEN 'signup' THEN '{{"type":"foreign_key","ref_entity":"e1","ref_columns":["Part_Ref","ID_Ref"]}}'
  ELSE '{{"type":"not_null"}}' END AS doc,
 CASE WHEN event_id % 10 = 0 THEN 'Col_2 != ''Open''' END AS scope_filter, event_type, user_id, value
FROM {events}"""


def docs(spark, sf_dir):
    return (Tables(spark, sf_dir).sql(DOCS).withColumnsRenamed({"cols": "columns", "doc": "check", "scope_filter": "filter"}))


_CANONICAL = f"""SELECT seq, 'entity=' || entity || ' | columns=' || CASE event_type WHEN 'signup' THEN 'id,part' ELSE 'col_1' END || ' | ' ||
 CASE event_type WHEN 'click' THEN 'inclusive=true | max=' || CAST(CAST(floor(value) AS DOUBLE) AS VARCHAR) || ' | min=0.0 | type=range'
  WHEN 'purchase' THEN 'case_sensitive=true | type=allowed_values | values=' || (user_id % 5) || ',a,b'
  WHEN 'error' THEN 'expression=col_1 >= ' || (user_id % 7) || ' | type=row_condition'
  WHEN 'signup' THEN 'ref_columns=id_ref,part_ref | ref_entity=e1 | type=foreign_key' ELSE 'type=not_null' END
 || CASE WHEN scope_filter IS NULL THEN '' ELSE ' | filter=col_2 <> ''Open''' END AS canonical,
 CASE event_type WHEN 'click' THEN 'range' WHEN 'purchase' THEN 'allowed_values' WHEN 'error' THEN 'row_condition' WHEN 'signup' THEN 'foreign_key'
  ELSE 'not_null' END || '|' || entity || '|' || CASE event_type WHEN 'signup' THEN 'id,part|e1' ELSE 'col_1' END AS similarity_key
FROM {_sql(DOCS)}"""


@register("canonical_rules", f"SELECT seq, canonical FROM ({_CANONICAL})")
def canonical_rules(spark, sf_dir):
    return ledger.canonical(docs(spark, sf_dir)).select("seq", "canonical")


@register("rule_fingerprints", f"SELECT seq, substr(sha256(canonical), 1, 16) AS fingerprint FROM ({_CANONICAL})")
def rule_fingerprints(spark, sf_dir):
    return ledger.canonical(docs(spark, sf_dir)).select("seq", "fingerprint")


@register("similarity_keys", f"SELECT similarity_key, count(*) AS rules FROM ({_CANONICAL}) GROUP BY 1")
def similarity_keys(spark, sf_dir):
    return ledger.canonical(docs(spark, sf_dir)).groupBy("similarity_key").agg(F.count(F.lit(1)).alias("rules"))


@register("dedup_rules", with_views("rule_candidates") + """
SELECT fingerprint, min(seq) AS seq, arg_min(similarity_key, seq) AS similarity_key, count(*) AS copies FROM rule_candidates GROUP BY 1""")
def dedup_rules(spark, sf_dir):
    return ledger.first_of_each(Tables(spark, sf_dir)["rule_candidates"]).select("fingerprint", "seq", "similarity_key", "copies")


_ORIGINAL = ("CASE WHEN seq % 7 = 0 THEN md5(concat_ws('|', check_type, CAST(entity_no AS STRING), CAST(max_value + 1 AS STRING))) "
             "ELSE fingerprint END AS original_fingerprint")


@register("classify_candidates", with_views("rule_candidates") + f""",
history AS (SELECT *, {_ORIGINAL} FROM rule_candidates WHERE created_at < TIMESTAMP '2024-01-16'),
run AS (SELECT fingerprint, min(seq) AS seq, arg_min(similarity_key, seq) AS similarity_key FROM rule_candidates WHERE created_at >= TIMESTAMP '2024-01-16' GROUP BY 1),
judged AS (SELECT *, fingerprint IN (SELECT fingerprint FROM history UNION ALL SELECT original_fingerprint FROM history) AS known FROM run),
newest AS (SELECT similarity_key, arg_max(seq, created_at) AS on_file FROM history GROUP BY 1)
SELECT seq, fingerprint, similarity_key, CASE WHEN known THEN 'duplicate' WHEN similar_to IS NULL THEN 'stored' ELSE 'similar' END AS outcome, similar_to
FROM (SELECT seq, fingerprint, j.similarity_key, known, CASE WHEN NOT known THEN coalesce(lag(seq) OVER (PARTITION BY j.similarity_key, known ORDER BY seq), on_file) END AS similar_to
 FROM judged j LEFT JOIN newest n ON n.similarity_key = j.similarity_key)""")
def classify_candidates(spark, sf_dir):
    every = Tables(spark, sf_dir)["rule_candidates"]
    split = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    history = every.where(split).withColumn("original_fingerprint", F.expr(_ORIGINAL.rsplit(" AS ", 1)[0]))
    return ledger.classify(every.where(~split), history)


# ---- reviews: a rule per customer, decisions from the event stream ---------------------------------
RULES = """
SELECT c_custkey AS rule_id, concat('src', CAST(c_custkey % 3 AS STRING)) AS source_id, concat('e', CAST(c_nationkey AS STRING)) AS entity,
 concat('rule ', CAST(c_custkey AS STRING)) AS name, CASE c_custkey % 5 WHEN 0 THEN 'range' WHEN 1 THEN 'custom_sql' WHEN 2 THEN 'not_null' WHEN 3 THEN 'pattern' ELSE 'unique' END AS check_type,
 CASE c_custkey % 3 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'llm' ELSE 'steward' END AS origin, c_mktsegment AS segment
FROM {customer}"""
REVIEWS = """
SELECT *, CASE WHEN decision = 'rejected' AND seq % 5 <> 0 THEN concat('because ', CAST(seq AS STRING)) WHEN decision = 'rejected' AND seq % 2 = 0 THEN '  ' END AS reason
FROM {reviews}"""
_STATUS = """SELECT rule_id, CASE last_decision WHEN 'modified' THEN 'approved' ELSE last_decision END AS status, last_decision, reason_code, reason, decisions, edits FROM (
 SELECT rule_id, decision AS last_decision, reason_code, reason, count(*) OVER (PARTITION BY rule_id) AS decisions, count(*) FILTER (decision = 'modified') OVER (PARTITION BY rule_id) AS edits,
  row_number() OVER (PARTITION BY rule_id ORDER BY decided_at DESC, seq DESC) AS rn FROM r) WHERE rn = 1"""
_R = with_views("reviews") + f", r AS {_sql(REVIEWS)}, rules AS {_sql(RULES)}, status AS ({_STATUS})\n"


def _reviews(spark, sf_dir):
    return Tables(spark, sf_dir).sql(REVIEWS)


def _rules(spark, sf_dir):
    return Tables(spark, sf_dir).sql(RULES)


def _decided(spark, sf_dir):
    return ledger.with_status(_rules(spark, sf_dir), _reviews(spark, sf_dir))


@register("rule_status", _R + "SELECT rule_id, status, last_decision, reason_code, decisions FROM status")
def rule_status(spark, sf_dir):
    return ledger.rule_status(_reviews(spark, sf_dir))


@register("invalid_reviews", _R + """SELECT rule_id, seq, CASE WHEN coalesce(trim(reason), '') = '' THEN 'a rejection needs a reason' END AS problem
 FROM r WHERE decision = 'rejected' AND coalesce(trim(reason), '') = ''""")
def invalid_reviews(spark, sf_dir):
    return ledger.invalid_reviews(_reviews(spark, sf_dir))


@register("bulk_approve", _R + """SELECT rule_id, 'approved' AS decision, 'lead' AS reviewer, 'bulk approval' AS reason FROM rules
 WHERE rule_id NOT IN (SELECT rule_id FROM status) AND origin = 'heuristic' AND check_type = 'range'""")
def bulk_approve(spark, sf_dir):
    out = ledger.bulk_approve(_decided(spark, sf_dir), "lead", F.lit("2024-02-01").cast("timestamp_ntz"), origin="heuristic", check_type="range")
    return out.select("rule_id", "decision", "reviewer", "reason")


_RESULTS = """SELECT c_custkey AS rule_id, c_custkey % 50 + 10 AS total, c_custkey % 13 AS failed,
 round((c_custkey % 13) / CAST(c_custkey % 50 + 10 AS DOUBLE), 6) AS failure_rate, 0.05 AS allowed,
 CASE WHEN c_custkey % 17 = 0 THEN 'column is gone' END AS error FROM {customer}"""
_SIMILAR = """SELECT c_custkey AS rule_id, concat('rule ', CAST(c_custkey - 1 AS STRING)) AS similar_name,
 CASE WHEN c_custkey % 2 = 0 THEN 'rejected' ELSE 'approved' END AS similar_status, CASE WHEN c_custkey % 4 = 0 THEN 'too many alarms' END AS similar_reason
FROM {customer} WHERE c_custkey % 6 IN (2, 3, 4)"""


@register("review_queue", _R + f""", res AS {_sql(_RESULTS)}, sim AS {_sql(_SIMILAR)}
SELECT rule_id, name, entity, check_type, concat_ws('; ', CASE WHEN check_type = 'custom_sql' THEN 'free SQL: read it before approving' END,
 CASE WHEN similar_name IS NOT NULL THEN 'similar to ' || similar_status || ' rule ''' || similar_name || '''' ||
  CASE WHEN similar_status = 'rejected' AND similar_reason IS NOT NULL THEN ' (rejected: ' || similar_reason || ')' ELSE '' END END,
 CASE WHEN error IS NOT NULL THEN 'cannot run: ' || error WHEN failure_rate > 0.1 THEN 'fails ' || CAST(round(failure_rate * 100) AS INT) || '% of rows: the rule may be wrong'
  WHEN failed > 0 AND failure_rate <= allowed THEN 'passes with ' || failed || ' failing rows (limit 5.0%)' END) AS flags
FROM rules LEFT JOIN res USING (rule_id) LEFT JOIN sim USING (rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM status)""")
def review_queue(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    results = tables.sql(_RESULTS).withColumn("allowed", F.col("allowed").cast("double")).withColumn(
        "passed", F.col("error").isNull() & (F.col("failure_rate") <= F.col("allowed")))
    out = ledger.review_queue(_decided(spark, sf_dir), tables.sql(_SIMILAR), results)
    return out.withColumn("flags", F.array_join("flags", "; "))


@register("rule_counts", _R + """SELECT entity, origin, coalesce(status, 'proposed') AS status, count(*) AS rules FROM rules LEFT JOIN status USING (rule_id) GROUP BY 1, 2, 3""")
def rule_counts(spark, sf_dir):
    return ledger.rule_counts(_decided(spark, sf_dir), "entity", "origin", "status")


_HISTORY = """SELECT rule_id, entity, check_type, CASE status WHEN 'approved' THEN 'approved' WHEN 'rejected' THEN 'rejected' ELSE 'pending' END AS "group",
 CASE WHEN status = 'rejected' THEN reason END AS reason, reason_code, CASE WHEN status = 'approved' THEN edits ELSE 0 END AS superseded
FROM rules LEFT JOIN status USING (rule_id)"""


@register("decision_history", _R + _HISTORY)
def decision_history(spark, sf_dir):
    return ledger.decision_history(_rules(spark, sf_dir), _reviews(spark, sf_dir))


_PATTERNS = """, h AS ({history}), code AS (SELECT {k} check_type, string_agg(code || ' x' || n, ', ' ORDER BY n DESC, code) AS codes FROM (
  SELECT {k} check_type, coalesce(reason_code, 'no code') AS code, count(*) AS n FROM h WHERE "group" = 'rejected' GROUP BY ALL) GROUP BY ALL),
 n AS (SELECT {k} check_type, count(*) FILTER ("group" = 'approved') AS approved, count(*) FILTER ("group" = 'rejected') AS rejected,
  arg_max(reason, rule_id) FILTER ("group" = 'rejected' AND reason IS NOT NULL) AS example FROM h GROUP BY ALL)
SELECT {k} check_type, approved, rejected, check_type || ': approved ' || approved || ', rejected ' || rejected || CASE WHEN rejected > 0 THEN ' (' || codes || ')' ||
 CASE WHEN example IS NOT NULL THEN ' - e.g. "' || example || '"' ELSE '' END ELSE '' END AS line FROM n LEFT JOIN code USING ({u} check_type) WHERE {keep}"""


@register("decision_patterns", _R + _PATTERNS.format(history=_HISTORY, k="entity,", u="entity,", keep="rejected > 0 OR approved + rejected >= 2"))
def decision_patterns(spark, sf_dir):
    return ledger.decision_patterns(decision_history(spark, sf_dir))


@register("decision_patterns_source", _R + _PATTERNS.format(history=_HISTORY, k="", u="", keep="rejected >= 3"))
def decision_patterns_source(spark, sf_dir):
    return ledger.decision_patterns(decision_history(spark, sf_dir), None)


_ITEMS = """SELECT event_id AS item_id, concat('src', CAST(user_id % 3 AS STRING)) AS source_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('e', CAST(user_id % 40 AS STRING)) END AS entity,
 props AS note FROM {events} WHERE event_type = 'view'"""
_RETIRED = "SELECT event_id - 1 AS item_id FROM {events} WHERE event_type = 'error'"


@register("active_context", f"""SELECT item_id, source_id, coalesce(entity, 'whole source') AS scope, note FROM {_sql(_ITEMS)}
 WHERE item_id NOT IN (SELECT item_id FROM {_sql(_RETIRED)})""")
def active_context(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return ledger.active_context(tables.sql(_ITEMS), tables.sql(_RETIRED)).select(
        "item_id", "source_id", F.coalesce("entity", F.lit("whole source")).alias("scope"), "note")


_OUTCOMES = "SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'duplicate' WHEN 'view' THEN 'similar' ELSE 'stored' END AS outcome FROM {events} WHERE event_type <> 'error'"
_ATTEMPTS = "SELECT user_id AS run_id, event_id % 4 AS invalid, event_id % 3 AS repaired FROM {events} WHERE event_type = 'error'"


@register("run_summary", f"""WITH o AS {_sql(_OUTCOMES)}, a AS {_sql(_ATTEMPTS)}
SELECT coalesce(o.run_id, a.run_id) AS run_id, coalesce(generated, 0) AS generated, coalesce(duplicate, 0) AS duplicate, coalesce("similar", 0) AS "similar",
 CAST(coalesce(invalid, 0) AS BIGINT) AS invalid, CASE WHEN coalesce(generated, 0) >= 20 THEN 5 ELSE 12 END AS next_budget FROM
 (SELECT run_id, count(*) FILTER (outcome <> 'duplicate') AS generated, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'similar') AS "similar" FROM o GROUP BY 1) o
 FULL JOIN (SELECT run_id, sum(greatest(0, invalid - repaired)) AS invalid FROM a GROUP BY 1) a ON a.run_id = o.run_id""")
def run_summary(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return ledger.run_summary(tables.sql(_OUTCOMES), tables.sql(_ATTEMPTS)).withColumn("next_budget", ledger.rule_budget(F.col("generated")))


@register("stale_rules", _R + """SELECT rule_id, 'orders' AS "table", CASE segment WHEN 'BUILDING' THEN 'o_comment' ELSE 'o_clerk' END AS "column" FROM rules JOIN status USING (rule_id)
 WHERE status = 'approved' AND segment IN ('BUILDING', 'MACHINERY')""")
def stale_rules(spark, sf_dir):
    """Targets: BUILDING and MACHINERY rules name columns that orders does not have."""
    tables = Tables(spark, sf_dir)
    wanted = F.expr("CASE segment WHEN 'BUILDING' THEN array('o_custkey', 'o_comment') WHEN 'MACHINERY' THEN array('o_clerk') ELSE array('o_orderdate') END")
    rules = _decided(spark, sf_dir).withColumn("table", F.lit("orders")).withColumn("columns", wanted)
    inventory = spark.createDataFrame([("orders", c) for c in tables["orders"].columns], "table string, column string")
    return ledger.stale_rules(rules, inventory)


_LINES = f"""SELECT d.rule_id, d.entity, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'covered' END AS section, substr(sha256(canonical), 1, 16) AS fingerprint,
 name || ' [' || CASE event_type WHEN 'click' THEN 'range' WHEN 'purchase' THEN 'allowed_values' WHEN 'error' THEN 'row_condition' WHEN 'signup' THEN 'foreign_key' ELSE 'not_null' END
 || ' on ' || d.entity || '(' || CASE event_type WHEN 'signup' THEN 'Part,ID' ELSE 'Col_1' END || ')' ||
 CASE event_type WHEN 'click' THEN ': ' || CASE WHEN d.rule_id % 2 = 0 THEN 'inclusive=true, ' ELSE '' END || 'max=' || CAST(floor(value) AS INT) || ', min=0'
  WHEN 'purchase' THEN ': values=["b","a","' || (user_id % 5) || '","b"]' WHEN 'signup' THEN ': ref_columns=["Part_Ref","ID_Ref"], ref_entity=e1'
  WHEN 'error' THEN ': expression=' || CASE d.rule_id % 3 WHEN 0 THEN 'Col_1>=' WHEN 1 THEN 'col_1  >= ' ELSE 'COL_1 >=' END || (user_id % 7) ELSE '' END ||
 CASE WHEN scope_filter IS NULL THEN '' ELSE ' WHERE ' || scope_filter END || ']' || CASE WHEN event_type = 'error' AND d.rule_id % 2 = 0 THEN ' - steward''s reason: because ' || d.rule_id ELSE '' END AS line
FROM {_sql(DOCS)} d JOIN ({_CANONICAL}) c ON c.seq = d.rule_id"""
_PREFERRED = _R + _PATTERNS.format(history=_HISTORY, k="entity,", u="entity,", keep="rejected > 0 OR approved + rejected >= 2")


@register("rules_digest", f"""SELECT entity, section, fingerprint, arg_max(line, rule_id) AS line FROM ({_LINES}) GROUP BY ALL
UNION ALL SELECT entity, 'preference', NULL, line FROM ({_PREFERRED})""")
def rules_digest(spark, sf_dir):
    library = ledger.canonical(docs(spark, sf_dir)).withColumn("status", F.expr("CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END"))
    return ledger.rules_digest(library.withColumn("reason", F.expr("CASE WHEN seq % 2 = 0 THEN concat('because ', seq) END")), decision_patterns(spark, sf_dir))


_SOURCES = "SELECT DISTINCT concat('src', CAST(c_custkey % 4 AS STRING)) AS source_id FROM {customer}"
_VERSIONS = "SELECT concat('src', CAST(user_id % 2 AS STRING)) AS source_id, count(*) AS version FROM {events} GROUP BY 1"


@register("source_overview", _R + f""", s AS {_sql(_SOURCES)}, v AS {_sql(_VERSIONS)}, c AS {_sql(_ITEMS)},
 k AS (SELECT source_id, coalesce(status, 'proposed') AS status FROM rules LEFT JOIN status USING (rule_id))
SELECT s.source_id, (SELECT max(version) FROM v WHERE v.source_id = s.source_id) AS version,
 (SELECT count(*) FROM k WHERE k.source_id = s.source_id AND status = 'proposed') AS proposed, (SELECT count(*) FROM k WHERE k.source_id = s.source_id AND status = 'approved') AS approved,
 (SELECT count(*) FROM k WHERE k.source_id = s.source_id AND status = 'rejected') AS rejected, (SELECT count(*) FROM c WHERE c.source_id = s.source_id) AS context_items FROM s""")
def source_overview(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return ledger.source_overview(tables.sql(_SOURCES), tables.sql(_VERSIONS), _decided(spark, sf_dir), tables.sql(_ITEMS))


# ---- edits ----------------------------------------------------------------------------------------
EDITS = """SELECT event_id AS rule_id, 1 AS seq, CASE event_id % 5 WHEN 0 THEN 'check.max' WHEN 1 THEN 'name' WHEN 2 THEN 'status' WHEN 3 THEN 'color' ELSE 'check.inclusive' END AS path,
 CASE event_id % 5 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN 'renamed' WHEN 2 THEN 'approved' WHEN 3 THEN 'red' ELSE 'false' END AS value FROM {events} WHERE event_type = 'click'"""


@register("apply_edits", f"""SELECT e.rule_id, CASE WHEN e.path = 'name' THEN e.value ELSE d.name END AS name,
 CASE e.path WHEN 'status' THEN '''status'' cannot be edited' WHEN 'color' THEN 'unknown field ''color''' ELSE '' END AS errors,
 CASE WHEN e.path = 'check.max' THEN CAST(e.value AS DOUBLE) ELSE floor(d.value) END AS max_value, CASE WHEN e.path = 'check.inclusive' THEN 'false' WHEN e.rule_id % 2 = 0 THEN 'true' END AS inclusive
FROM {_sql(EDITS)} e JOIN {_sql(DOCS)} d ON d.rule_id = e.rule_id""")
def apply_edits(spark, sf_dir):
    out = ledger.apply_edits(docs(spark, sf_dir), Tables(spark, sf_dir).sql(EDITS))
    return out.select("rule_id", "name", F.array_join("errors", "; ").alias("errors"), F.expr("CAST(get_json_object(check, '$.max') AS DOUBLE)").alias("max_value"),
                      F.expr("get_json_object(check, '$.inclusive')").alias("inclusive"))


REVISIONS = """SELECT event_id AS rule_id, 1 AS seq, CASE event_id % 8 WHEN 0 THEN 'check.max' WHEN 1 THEN 'check.max' WHEN 2 THEN 'check.color' WHEN 3 THEN 'tolerance' WHEN 4 THEN 'tolerance'
  WHEN 5 THEN 'severity' WHEN 6 THEN 'target.columns' ELSE 'filter' END AS path,
 CASE event_id % 8 WHEN 0 THEN 'lots' WHEN 1 THEN '-5' WHEN 2 THEN 'red' WHEN 3 THEN 'abc' WHEN 4 THEN '7' WHEN 5 THEN 'urgent' WHEN 6 THEN '["ghost"]' ELSE 'Col_1 > 0' END AS value
FROM {events} WHERE event_type = 'click'"""


@register("revalidated_edits", f"""SELECT rule_id, CASE rule_id % 8 WHEN 0 THEN 'check.max: not a number' WHEN 1 THEN 'range min > max' WHEN 2 THEN 'check: unknown color' WHEN 3 THEN 'tolerance: not a number'
 WHEN 4 THEN 'tolerance: not between 0 and 1' WHEN 5 THEN 'severity: not one of critical/high/medium/low' WHEN 6 THEN 'target: unknown column(s) ghost in ''' || entity || '''' ELSE '' END AS errors
FROM {_sql(DOCS)} WHERE event_type = 'click'""")
def revalidated_edits(spark, sf_dir):
    """What is wrong with rules after an edit: the edit itself, the shape of the rule, what it refers to."""
    tables = Tables(spark, sf_dir)
    library = docs(spark, sf_dir).withColumn("severity", F.lit("medium")).withColumn("tolerance", F.lit(0.0))
    columns = library.select("entity").distinct().select("entity", F.explode(F.array(F.lit("Col_1"), F.lit("Col_2"))).alias("column"))
    trees = _model_columns(spark, sf_dir)[1]
    out = ledger.revalidated(ledger.apply_edits(library, tables.sql(REVISIONS)), columns, trees)
    return out.select("rule_id", F.array_join("errors", "; ").alias("errors"))


_EVENTS_OF_EDITS = """SELECT event_id AS rule_id, 1 AS seq, 'check.max' AS path, CAST(user_id AS STRING) AS value FROM {events} WHERE event_type = 'click'
UNION ALL SELECT event_id, 2, CASE event_id % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'check.max' ELSE 'name' END,
 CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN CAST(event_id % 100 AS STRING) ELSE 'renamed' END FROM {events} WHERE event_type = 'click'
UNION ALL SELECT event_id, 2, 'description', 'with its event' FROM {events} WHERE event_type = 'click' AND event_id % 3 = 0
UNION ALL SELECT event_id, 3, CASE event_id % 2 WHEN 0 THEN 'check.max' ELSE 'name' END, CASE event_id % 2 WHEN 0 THEN '1000' ELSE concat('n', CAST(event_id AS STRING)) END
 FROM {events} WHERE event_type = 'click'
UNION ALL SELECT event_id, 4, 'description', 'after all' FROM {events} WHERE event_type = 'click' AND event_id % 3 = 0"""


@register("edit_history", f"""WITH j AS (SELECT *, CASE WHEN path = 'status' THEN '''status'' cannot be edited' END AS problem FROM {_sql(_EVENTS_OF_EDITS)}),
 k AS (SELECT *, NOT bool_or(problem IS NOT NULL) OVER (PARTITION BY rule_id, seq) AS accepted FROM j),
 s AS (SELECT *, last_value(CASE WHEN accepted THEN value END IGNORE NULLS) OVER (PARTITION BY rule_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k),
 o AS (SELECT s.rule_id, s.seq, path, coalesce(was, CASE path WHEN 'name' THEN d.name WHEN 'check.max' THEN CAST(CAST(floor(d.value) AS INT) AS VARCHAR) END) AS b, s.value AS a, accepted, problem
  FROM s JOIN {_sql(DOCS)} d ON d.rule_id = s.rule_id)
SELECT rule_id, seq, path, b AS "before", a AS "after", accepted, problem, path || ': ' || coalesce(b, '(empty)') || ' -> ' || coalesce(a, '(empty)') AS line FROM o""")
def edit_history(spark, sf_dir):
    """Every edit with the value before and after it; an event with a refused edit changes nothing."""
    return ledger.edit_history(docs(spark, sf_dir), Tables(spark, sf_dir).sql(_EVENTS_OF_EDITS))


@register("edit_clashes", f"""WITH f AS (SELECT rule_id, CASE WHEN path = 'check.max' THEN CAST(e.value AS DOUBLE) ELSE floor(d.value) END AS m, entity, path,
  CASE WHEN path = 'check.inclusive' THEN 'false' ELSE 'true' END AS inc, scope_filter FROM {_sql(EDITS)} e JOIN {_sql(DOCS)} d USING (rule_id)),
 d AS (SELECT rule_id, floor(value) AS m, entity, 'true' AS inc, scope_filter FROM {_sql(DOCS)} WHERE event_type = 'click')
SELECT f.rule_id, CASE WHEN min(d.rule_id) <> f.rule_id THEN min(d.rule_id) ELSE max(d.rule_id) END AS other_id FROM f JOIN d ON d.m = f.m AND d.entity = f.entity AND d.inc = f.inc
 AND d.scope_filter IS NOT DISTINCT FROM f.scope_filter GROUP BY f.rule_id HAVING min(d.rule_id) <> f.rule_id OR max(d.rule_id) <> f.rule_id""")
def edit_clashes(spark, sf_dir):
    library = docs(spark, sf_dir)
    edited = ledger.apply_edits(library, Tables(spark, sf_dir).sql(EDITS))
    return ledger.clashes(*[cut_lineage(ledger.canonical(x).select("rule_id", "fingerprint")) for x in (edited.drop("errors"), library)])


# ---- candidates: one JSON rule per event, damaged by its number ------------------------------------
CANDIDATES = """
SELECT event_id AS seq, CASE WHEN event_id % 19 = 7 THEN 'customer' ELSE 'order' END AS asked, concat('{{"name":"c', CAST(event_id AS STRING), '","category":"',
 CASE WHEN event_id % 19 = 1 THEN 'quality' ELSE 'data_quality' END, '","dimension":"validity","scope":"', CASE WHEN event_id % 19 = 2 THEN 'row' ELSE 'column' END,
 '","target":{{"entity":"', CASE WHEN event_id % 19 = 8 THEN 'ghost' ELSE 'order' END, '","columns":[', CASE event_id % 19 WHEN 3 THEN '' WHEN 9 THEN '"nope"' WHEN 10 THEN '"o_orderkey"' ELSE '"o_totalprice"' END, ']}},"check":',
 CASE event_id % 19 WHEN 4 THEN '{{"type":"range"}}' WHEN 5 THEN '{{"type":"pattern","regex":"["}}' WHEN 6 THEN '{{"type":"sounds_like"}}' WHEN 10 THEN '{{"type":"not_null"}}'
  WHEN 11 THEN '{{"type":"null_rate_max","max_rate":1.5}}' WHEN 12 THEN '{{"type":"range","min":5,"max":1}}' WHEN 13 THEN '{{"type":"not_null","extra":1}}' WHEN 14 THEN '{{"type":"allowed_values","values":[]}}'
  ELSE concat('{{"type":"range","min":', CAST(user_id AS STRING), '}}') END,
 CASE event_id % 19 WHEN 15 THEN ',"filter":"o_orderstatus = ''F'' AND o_nothing > 1"' WHEN 16 THEN ',"filter":"o_custkey IN (SELECT 1)"' WHEN 17 THEN ',"filter":"o_orderstatus = ''F'' AND o_custkey IS NOT NULL"' ELSE '' END,
 CASE WHEN event_id % 19 = 18 THEN ',"tolerance":7' ELSE '' END, '}}') AS rule
FROM {events}"""
_SHAPE = """CASE seq % 19 WHEN 1 THEN 'category: not one of data_quality/hierarchy/business' WHEN 2 THEN 'check ''range'' needs scope column, got ''row'''
 WHEN 3 THEN 'check ''range'' needs exactly 1 target column(s), got 0' WHEN 4 THEN 'range needs min and/or max' WHEN 5 THEN 'check.regex: invalid regex' WHEN 6 THEN 'check.type: unknown'
 WHEN 11 THEN 'check.max_rate: not between 0 and 1' WHEN 12 THEN 'range min > max' WHEN 13 THEN 'check: unknown extra' WHEN 14 THEN 'check.values: empty' WHEN 18 THEN 'tolerance: not between 0 and 1' ELSE '' END"""
_REFS = """CASE seq % 19 WHEN 8 THEN 'unknown entity ''ghost''' WHEN 9 THEN 'target: unknown column(s) nope in ''order''' WHEN 15 THEN 'filter: unknown column(s): o_nothing'
 WHEN 16 THEN 'filter: must be a plain expression' ELSE '' END"""
PKS = {"order": ("o_orderkey",), "customer": ("c_custkey",)}


def _model_columns(spark, sf_dir):
    """(entity, column) and hierarchies as the dirty tables have them."""
    tables = Tables(spark, sf_dir)
    rows = [(e, c) for e, t in (("order", "orders_dirty"), ("customer", "customer_dirty")) for c in tables[t].columns]
    trees = spark.createDataFrame([("geo", "geo_node", ["REGION", "NATION", "SITE"])], "hierarchy_id string, entity string, levels array<string>")
    return spark.createDataFrame(rows, "entity string, column string"), trees


@register("validate_rule_shape", f"SELECT seq, {_SHAPE} AS errors FROM {_sql(CANDIDATES)}")
def validate_rule_shape(spark, sf_dir):
    out = validate.shape_errors(validate.parsed(Tables(spark, sf_dir).sql(CANDIDATES)))
    return out.select("seq", F.array_join("errors", "; ").alias("errors"))


@register("validate_rule_refs", f"SELECT seq, {_REFS} AS ref_errors FROM {_sql(CANDIDATES)}")
def validate_rule_refs(spark, sf_dir):
    out = validate.reference_errors(validate.parsed(Tables(spark, sf_dir).sql(CANDIDATES)), *_model_columns(spark, sf_dir))
    return out.select("seq", F.array_join("ref_errors", "; ").alias("ref_errors"))


@register("pk_rule_filter", f"SELECT seq FROM {_sql(CANDIDATES)} WHERE seq % 19 = 10")
def pk_rule_filter(spark, sf_dir):
    return validate.parsed(Tables(spark, sf_dir).sql(CANDIDATES)).where(validate.primary_key_rule(PKS)).select("seq")


@register("candidate_triage", f"""SELECT CASE WHEN {_SHAPE} <> '' OR {_REFS} <> '' THEN 'invalid' WHEN seq % 19 = 7 THEN 'off_target' WHEN seq % 19 = 10 THEN 'key_check' ELSE 'valid' END AS outcome,
 count(*) AS candidates FROM {_sql(CANDIDATES)} GROUP BY 1""")
def candidate_triage(spark, sf_dir):
    out = validate.triage(Tables(spark, sf_dir).sql(CANDIDATES), *_model_columns(spark, sf_dir), PKS, "asked")
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("candidates"))




@register("steward_intake", f"""WITH c AS (SELECT seq, user_id, CASE seq % 19 WHEN 10 THEN 'key' WHEN 17 THEN 'filtered' ELSE 'plain' END AS kind FROM {_sql(CANDIDATES)}
  JOIN (SELECT event_id, user_id FROM events) ON event_id = seq WHERE {_SHAPE} = '' AND {_REFS} = ''),
 u AS (SELECT min(seq) AS seq, count(*) AS copies, kind = 'key' AS is_key FROM c GROUP BY kind, CASE WHEN kind <> 'key' THEN user_id END)
SELECT CASE WHEN rn = 1 THEN 'stored' ELSE 'similar' END AS outcome, count(*) AS rules, CAST(sum(copies) AS BIGINT) AS documents
FROM (SELECT *, row_number() OVER (PARTITION BY is_key ORDER BY seq) AS rn FROM u) GROUP BY 1""")
def steward_intake(spark, sf_dir):
    """Rule documents a steward brings: validated, stored as approved, duplicates and look-alikes told apart."""
    documents = Tables(spark, sf_dir).sql(CANDIDATES)
    rules = cut_lineage(ledger.canonical(validate.intake(documents, *_model_columns(spark, sf_dir))))
    nothing = rules.where(F.lit(False)).withColumn("original_fingerprint", F.col("fingerprint")).withColumn("created_at", F.lit(None).cast("timestamp"))
    placed = ledger.classify(rules, nothing).select("seq", "outcome")
    return (ledger.first_of_each(rules).select("seq", "copies").join(placed, "seq").groupBy("outcome")
            .agg(F.count(F.lit(1)).alias("rules"), F.sum("copies").alias("documents")))
