"""Semantic inference: hints, types, codes, links, trees, and the assembled model."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Constraints, vocab
from plumbline.model import bare_names
from plumbline.operators import inference as inf, links as lk, profiling as p
from plumbline.plans import semantic as plan
from plumbline.sources import inventory as inv
from queries.dirty import AS_OF, CONSTRAINTS, Tables, pick, with_views
from queries.profiling import DRIVER_TABLES, _COLS, _views

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


MODEL_TABLES = ("orders_dirty", "customer_dirty", "lineitem_dirty", "geo_tree", "nation", "region")
MODEL_CONSTRAINTS = Constraints(
    {t: CONSTRAINTS.primary_keys[t] for t in MODEL_TABLES if t in CONSTRAINTS.primary_keys},
    (("orders_dirty", ("o_custkey",), "customer_dirty", ("c_custkey",)),
     ("customer_dirty", ("c_nationkey",), "nation", ("n_nationkey",)),
     ("customer_dirty", ("home_node",), "geo_tree", ("node_id",)),
     ("geo_tree", ("parent_id",), "geo_tree", ("node_id",)),
     ("lineitem_dirty", ("l_orderkey",), "orders_dirty", ("o_orderkey",))))
_BUILT: dict[tuple[str, str], plan.SemanticModel] = {}


def model(spark, sf_dir) -> plan.SemanticModel:
    """The model of the dirty tables. Built once per session and folder, as a stored snapshot would be."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _BUILT:
        _BUILT[at] = plan.build_model(pick(Tables(spark, sf_dir), *MODEL_TABLES), AS_OF, MODEL_CONSTRAINTS)
    return _BUILT[at]


# ---- names ----------------------------------------------------------------------------------------
_PREFIXED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_HINTS = ", ".join(f"({i}, '{g}', '{rx}', '{t}', CAST({w} AS DOUBLE))" for i, (g, rx, t, w) in enumerate(vocab.NAME_HINTS))


@register("name_hints", f"""
SELECT "table", "column", "group", semantic_type, weight, row_count FROM (SELECT *, row_number() OVER (PARTITION BY "table", "column", "group" ORDER BY place) AS rn
 FROM (SELECT table_name AS "table", column_name AS "column", CASE WHEN table_name IN ({", ".join(f"'{t}'" for t in _PREFIXED)})
   THEN regexp_replace(column_name, '^[a-z]+_', '') ELSE column_name END AS bare FROM {_COLS})
 JOIN (VALUES {_HINTS}) h(place, "group", rx, semantic_type, weight) ON regexp_matches(bare, rx))
 JOIN ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES)}) ON t = "table" WHERE rn = 1""")
def name_hints(spark, sf_dir):
    tables = pick(Tables(spark, sf_dir), *DRIVER_TABLES)
    pairs = [x for t, df in tables.items() for c, b in bare_names(df.columns).items() for x in (f"{t}.{c}", b)]
    listed = inv.schema_inventory(tables, CONSTRAINTS, with_counts=False).withColumn(
        "bare_name", F.create_map(*[F.lit(x) for x in pairs])[F.concat_ws(".", "table", "column")])
    return inf.name_hints(listed).join(inv.row_counts(tables), "table")


@register("semantic_types")
def semantic_types(spark, sf_dir):
    return model(spark, sf_dir).attributes.select("table", "column", "semantic_type", "role", "confidence", "reasons")


_M_COLUMNS = {"orders_dirty": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "order_number"),
              "customer_dirty": ("c_custkey", "c_name", "email", "phone", "c_nationkey", "c_mktsegment", "c_acctbal", "home_node"),
              "lineitem_dirty": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                                 "l_returnflag", "l_linestatus", "l_shipdate"),
              "geo_tree": ("node_id", "parent_id", "node_level", "node_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
              "region": ("r_regionkey", "r_name")}


@register("pii_columns", with_views("orders_dirty", "customer_dirty", "lineitem_dirty", "geo_nodes", "geo_tree") + "\n" + "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", coalesce(max(CAST(regexp_matches('{c}', '{vocab.SENSITIVE_NAME}|{vocab.PII_NAME}') AS INT)) = 1
 OR avg(CAST(regexp_matches(CAST({c} AS VARCHAR), '{vocab.EMAIL_REGEX}') AS INT)) >= 0.8, false) AS pii FROM {t}"""
    for t, cols in _M_COLUMNS.items() for c in cols))
def pii_columns(spark, sf_dir):
    return model(spark, sf_dir).attributes.select("table", "column", "pii")


@register("expected_patterns", with_views("orders_dirty", "customer_dirty") + """
SELECT 'customer_dirty' AS "table", 'email' AS "column", '""" + vocab.EMAIL_REGEX + """' AS expected_pattern
UNION ALL SELECT * FROM (SELECT 'customer_dirty', 'phone', '^\\+\\d{12}$' FROM customer_dirty HAVING count(*) FILTER (length(phone) = 13) / count(phone) >= 0.95)
UNION ALL SELECT * FROM (SELECT 'orders_dirty', 'order_number', '^[A-Z]{3}\\-\\d{8}$' FROM orders_dirty
  HAVING count(*) FILTER (regexp_full_match(order_number, 'ORD-[0-9]{8}')) / count(order_number) >= 0.95)""")
def expected_patterns(spark, sf_dir):
    return model(spark, sf_dir).attributes.where(F.col("expected_pattern").isNotNull()).select("table", "column", "expected_pattern")


_RANGED = {"orders_dirty": ("o_totalprice",), "customer_dirty": ("c_acctbal",),
           "lineitem_dirty": ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")}


@register("observed_ranges", _views(_RANGED) + "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", round(quantile_cont(CAST({c} AS DOUBLE), 0.01), 4) AS range_min,
 round(quantile_cont(CAST({c} AS DOUBLE), 0.99), 4) AS range_max FROM {t}""" for t, cols in _RANGED.items() for c in cols))
def observed_ranges(spark, sf_dir):
    return model(spark, sf_dir).attributes.where(F.col("range_min").isNotNull()).select("table", "column", "range_min", "range_max")


@register("business_keys", """SELECT * FROM (VALUES ('nation', 'nation', 'n_name'), ('orders_dirty', 'orders_dirty', 'order_number'), ('region', 'region', 'r_name'))
 k(entity_id, "table", business_key)""")
def business_keys(spark, sf_dir):
    return model(spark, sf_dir).entities.where(F.col("business_key").isNotNull()).select("entity_id", "table", "business_key")


@register("entity_types", " UNION ALL ".join(
    f"""SELECT '{t}' AS entity_id, '{t}' AS "table", (SELECT count(*) FROM {src}) AS row_count, '{kind}' AS entity_type"""
    for t, src, kind in (("customer_dirty", "customer", "master"), ("orders_dirty", "orders", "transaction"), ("lineitem_dirty", "lineitem", "transaction_line"),
                         ("geo_tree", "(SELECT 1 FROM region UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM supplier)", "hierarchy"),
                         ("nation", "nation", "master"), ("region", "region", "reference"))))
def entity_types(spark, sf_dir):
    return model(spark, sf_dir).entities.select("entity_id", "table", "row_count", "entity_type")


@register("needs_review")
def needs_review(spark, sf_dir):
    return plan.needs_review(model(spark, sf_dir).attributes)


# ---- valid codes ----------------------------------------------------------------------------------
_CODES = {"orders_dirty": ("o_orderstatus", "o_orderpriority"), "customer_dirty": ("c_mktsegment",), "lineitem_dirty": ("l_returnflag", "l_linestatus"),
          "events": ("event_type",)}
_RANKED = "\nUNION ALL ".join(f"""SELECT '{t}' AS t, '{c}' AS c, {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn,
 sum(count(*)) OVER () AS total FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}""" for t, cols in _CODES.items() for c in cols)
_STYLE = ("concat(CASE WHEN NOT regexp_matches({0}, '[A-Za-z]') THEN 'none' WHEN NOT regexp_matches({0}, '[a-z]') THEN 'upper' "
          "WHEN NOT regexp_matches({0}, '[A-Z]') THEN 'lower' ELSE 'mixed' END, '/', regexp_matches({0}, '[0-9]'), '/', regexp_matches({0}, '[^0-9A-Za-z_]'))")
_WHY = ("CASE WHEN length(r.v) >= 4 AND levenshtein(lower(r.v), lower(x)) <= (CASE WHEN length(x) < 8 THEN 1 ELSE 2 END) THEN 'misspelling of ''' || x || '''' "
        "WHEN length(r.v) >= 2 AND length(r.v) < length(x) AND regexp_matches(lower(x), '^' || array_to_string(list_transform(string_split(lower(r.v), ''), "
        "lambda ch: regexp_escape(ch)), '.*')) THEN 'abbreviation of ''' || x || '''' "
        "WHEN length(x) <= 3 AND starts_with(lower(r.v), lower(x)) AND length(r.v) > length(x) THEN 'spelled-out form of ''' || x || '''' "
        "WHEN length(r.v) >= 3 AND list_contains(string_split_regex(lower(x), '[_\\-\\s]+'), lower(r.v)) THEN 'short form of ''' || x || '''' END")
_FOLD = f""", ranked AS ({_RANKED}), fold AS (
 SELECT t, c, rn, v, n, [v] AS ok, [{_STYLE.format('v')}] AS styles, CAST(NULL AS VARCHAR) AS looks, CAST(NULL AS VARCHAR) AS why, true AS valid FROM ranked WHERE rn = 1
 UNION ALL
 SELECT t, c, rn, v, n, CASE WHEN valid THEN list_append(ok, v) ELSE ok END, CASE WHEN valid THEN list_append(styles, style) ELSE styles END,
  CASE WHEN valid THEN NULL ELSE looks END, CASE WHEN valid THEN NULL ELSE why END, valid FROM (
   SELECT *, looks IS NULL AND (share >= 0.01 OR (share >= 0.003 AND list_contains(styles, style))) AS valid FROM (
    SELECT *, coalesce(same, CASE WHEN share < 0.01 THEN near.x END) AS looks,
     coalesce('case variant of ''' || same || '''', CASE WHEN share < 0.01 THEN near.why END, 'rare and unlike any valid value') AS why FROM (
      SELECT r.t, r.c, r.rn, r.v, r.n, r.n / r.total AS share, f.ok, f.styles, {_STYLE.format('r.v')} AS style,
       list_filter(f.ok, lambda x: lower(x) = lower(r.v))[1] AS same,
       list_filter(list_transform(f.ok, lambda x: {{'x': x, 'why': {_WHY}}}), lambda y: y.why IS NOT NULL)[1] AS near
      FROM fold f JOIN ranked r ON r.t = f.t AND r.c = f.c AND r.rn = f.rn + 1))))"""
_FOLDED = with_views("orders_dirty", "customer_dirty", "lineitem_dirty", recursive=True) + _FOLD


def _classified(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    top = p.union(p.top_values(tables[t], t, list(cols)) for t, cols in _CODES.items())
    return inf.value_arrays(top).withColumn("split", F.expr(inf.classify_values("values")))


@register("classify_values", _FOLDED + """ SELECT t AS "table", c AS "column", v AS value, valid,
 looks AS looks_like, why AS reason FROM fold""")
def classify_values(spark, sf_dir):
    found = _classified(spark, sf_dir)
    good = found.select("table", "column", F.explode("split.allowed").alias("value"), F.lit(True).alias("valid"),
                        F.lit(None).cast("string").alias("looks_like"), F.lit(None).cast("string").alias("reason"))
    bad = found.select("table", "column", F.inline("split.anomalies")).select(
        "table", "column", "value", F.lit(False).alias("valid"), "looks_like",
        F.regexp_replace("reason", r"^rare \(.*%\) and", "rare and").alias("reason"))
    return good.unionByName(bad)


@register("misspelled_codes", _FOLDED + """ SELECT t AS "table", c AS "column", v AS value, n AS count, looks AS looks_like
 FROM fold WHERE NOT valid AND why LIKE 'misspelling%'""")
def misspelled_codes(spark, sf_dir):
    return (_classified(spark, sf_dir).select("table", "column", F.inline("split.anomalies"))
            .where(F.startswith("reason", F.lit("misspelling"))).select("table", "column", "value", "count", "looks_like"))


# ---- links ----------------------------------------------------------------------------------------
_FOUND_LINKS = (("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"),
                ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
                ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
                ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"))


@register("infer_foreign_keys", "SELECT *, round(matched / total, 6) AS containment, round(0.9 * matched / total, 2) AS confidence FROM (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", '{rt}' AS parent, '{rc}' AS parent_column, count(DISTINCT {c}) AS total,
 count(DISTINCT CASE WHEN {c} IN (SELECT {rc} FROM {rt}) THEN {c} END) AS matched FROM {t}""".replace(
        f"SELECT {rc} FROM", f"SELECT p.{rc} FROM").replace(f"FROM {rt})", f"FROM {rt} p)") for t, c, rt, rc in _FOUND_LINKS)
    + ") WHERE total >= 2 AND matched / total >= 0.9")
def infer_foreign_keys(spark, sf_dir):
    return lk.infer_links(pick(Tables(spark, sf_dir), *DRIVER_TABLES), Constraints(CONSTRAINTS.primary_keys))


_RELS = (("orders_dirty_customer_dirty", "orders_dirty", "o_custkey"), ("customer_dirty_nation", "customer_dirty", "c_nationkey"),
         ("customer_dirty_geo_tree", "customer_dirty", "home_node"), ("geo_tree_parent", "geo_tree", "parent_id"),
         ("lineitem_dirty_orders_dirty", "lineitem_dirty", "l_orderkey"), ("nation_region", "nation", "n_regionkey"))


@register("relationships", with_views("orders_dirty", "customer_dirty", "lineitem_dirty", "geo_nodes", "geo_tree") + "\n" + " UNION ALL ".join(
    f"""SELECT '{r}' AS relationship_id, '{c}' AS from_attribute, {str(r != 'geo_tree_parent').lower()} AND (count(*) - count({c})) / count(*) <= 0.02 AS mandatory,
 '{'inferred' if r == 'nation_region' else 'declared'}' AS kind, count(*) - count({c}) AS null_count FROM {t}""" for r, t, c in _RELS))
def relationships(spark, sf_dir):
    return model(spark, sf_dir).relationships.select("relationship_id", "from_attribute", "mandatory", "kind", "null_count")


# ---- trees ----------------------------------------------------------------------------------------
_LEVELS = """SELECT c.node_level AS level, CASE WHEN c.parent_id IS NULL THEN '__root__' ELSE coalesce(p.node_level, '__missing__') END AS parent_level,
 count(*) AS n FROM {0} c LEFT JOIN {0} p ON p.node_id = c.parent_id GROUP BY 1, 2"""


@register("hierarchy_level_counts", with_views("geo_nodes") + _LEVELS.format("geo_nodes"))
def hierarchy_level_counts(spark, sf_dir):
    return lk.level_counts(Tables(spark, sf_dir)["geo_nodes"], "node_id", "parent_id", "node_level")


def _tree_counts(spark, sf_dir):
    return lk.level_counts(Tables(spark, sf_dir)["geo_tree"], "node_id", "parent_id", "node_level")


_LINKED = f""", counts AS ({_LEVELS.format('geo_tree')}), shares AS (SELECT level, parent_level, n / sum(n) OVER (PARTITION BY level) AS share FROM counts),
 linked AS (SELECT level, parent_level FROM shares WHERE share >= 0.5), lone AS (SELECT parent_level, min(level) AS level FROM linked GROUP BY 1 HAVING count(*) = 1),
 chain AS (SELECT 0 AS depth, level FROM lone WHERE parent_level = '__root__' UNION ALL SELECT depth + 1, o.level FROM chain c JOIN lone o ON o.parent_level = c.level
  WHERE depth < 20)"""
_CHAIN = with_views("geo_nodes", "geo_tree", recursive=True) + _LINKED


@register("hierarchy_levels", _CHAIN + " SELECT depth, level, (SELECT CAST(sum(n) AS BIGINT) FROM counts k WHERE k.level = c.level) AS n FROM chain c")
def hierarchy_levels(spark, sf_dir):
    counts = _tree_counts(spark, sf_dir)
    levels = lk.level_chain(counts) or []
    at = F.array_position(F.array(*[F.lit(x) for x in levels]).cast("array<string>"), F.col("level"))
    return (counts.groupBy("level").agg(F.sum("n").alias("n")).withColumn("depth", (at - 1).cast("int"))
            .where(F.col("depth") >= 0).select("depth", "level", "n"))


@register("hierarchy_evidence", _CHAIN + """ SELECT k.level, k.parent_level, k.n, CASE WHEN c.depth IS NULL THEN 'level outside the hierarchy'
 WHEN k.parent_level = '__root__' THEN 'have no parent' WHEN k.parent_level = '__missing__' THEN 'point to a missing parent'
 ELSE concat('have a ', k.parent_level, ' parent (expected ', coalesce(u.level, 'none'), ')') END AS problem
 FROM counts k LEFT JOIN chain c ON c.level = k.level LEFT JOIN chain u ON u.depth = c.depth - 1
 WHERE c.depth IS NULL OR k.parent_level <> coalesce(u.level, '__root__')""")
def hierarchy_evidence(spark, sf_dir):
    counts = _tree_counts(spark, sf_dir)
    return lk.level_evidence(counts, lk.level_chain(counts))


@register("attach_level", with_views("customer_dirty", "geo_nodes") + """
SELECT node_level AS level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () >= 0.9 AS attached
FROM customer_dirty JOIN geo_nodes ON node_id = home_node GROUP BY 1""")
def attach_level(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return lk.attach_levels(tables["customer_dirty"], "home_node", tables["geo_nodes"], "node_id", "node_level")


@register("model_hierarchies")
def model_hierarchies(spark, sf_dir):
    return model(spark, sf_dir).hierarchies.select(
        "hierarchy_id", "entity", "parent_attribute", "level_attribute", F.array_join("levels", " > ").alias("levels"),
        F.array_join("evidence", "; ").alias("evidence"),
        F.array_join(F.transform("attached", lambda a: F.concat_ws(".", a["entity"], a["attribute"], a["must_attach_at"])), "; ").alias("attached"))
