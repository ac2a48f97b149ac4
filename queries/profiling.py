"""Sources, exact and shape profiling."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import Constraints, vocab
from plumbline.functions import text
from plumbline.operators import profiling as p
from plumbline.plans import profile as plan
from plumbline.sources import inventory as inv, store
from queries.dirty import AS_OF, CONSTRAINTS, Tables, pick, with_views

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")
DIRTY = ("orders_dirty", "customer_dirty", "lineitem_dirty")
COLUMNS = {
    "orders_dirty": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "order_number"),
    "customer_dirty": ("c_custkey", "c_name", "email", "phone", "c_nationkey", "c_mktsegment", "c_acctbal", "home_node"),
    "lineitem_dirty": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                       "l_returnflag", "l_linestatus", "l_shipdate"),
}
NUMBERS = {"orders_dirty": ("o_totalprice", "o_custkey"), "customer_dirty": ("c_acctbal", "c_nationkey"),
           "lineitem_dirty": ("l_quantity", "l_extendedprice", "l_discount")}
DATES = {"orders_dirty": ("o_orderdate",), "lineitem_dirty": ("l_shipdate",)}
TEXTS = {"orders_dirty": ("order_number", "o_orderstatus", "o_orderpriority"),
         "customer_dirty": ("c_name", "email", "phone", "c_mktsegment"), "pages": ("url",), "events": ("event_type", "props")}


def _each(spec: dict[str, tuple[str, ...]], column_sql: str) -> str:
    """UNION ALL of one SELECT per column; {t} and {c} are filled in."""
    return "\nUNION ALL ".join(column_sql.format(t=t, c=c) for t, cols in spec.items() for c in cols)


def _views(spec) -> str:
    views = [t for t in spec if t not in DRIVER_TABLES]
    return with_views(*views) + "\n" if views else ""


QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# ---- sources --------------------------------------------------------------------------------------
@register("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in DRIVER_TABLES))
def table_row_counts(spark, sf_dir):
    return inv.row_counts(pick(Tables(spark, sf_dir), *DRIVER_TABLES))


_PK_SQL = " OR ".join(f"(table_name = '{t}' AND column_name = '{c[0]}')" for t, c in CONSTRAINTS.primary_keys.items()
                      if t in DRIVER_TABLES)
_NATIVE = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
           "WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE 'timestamp_ntz' END")
_GENERIC = ("CASE data_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' "
            "WHEN 'FLOAT[]' THEN 'json' WHEN 'DOUBLE[]' THEN 'json' ELSE 'datetime' END")
_COLS = ("(SELECT table_name, column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_name IN ("
         + ", ".join(f"'{t}'" for t in DRIVER_TABLES) + "))")


@register("schema_inventory", f"""
SELECT table_name AS "table", column_name AS "column", CAST(ordinal_position AS BIGINT) AS ordinal, {_NATIVE} AS native_type,
 {_GENERIC} AS generic_type, ({_PK_SQL}) AS is_primary_key,
 CASE WHEN column_name = 'n_regionkey' THEN 'region' WHEN column_name = 's_nationkey' THEN 'nation' END AS "references", row_count
FROM {_COLS} JOIN ({ORACLE["table_row_counts"]}) n ON n."table" = table_name""")
def schema_inventory(spark, sf_dir):
    out = inv.schema_inventory(pick(Tables(spark, sf_dir), *DRIVER_TABLES), CONSTRAINTS)
    return out.select("table", "column", F.col("ordinal").cast("bigint").alias("ordinal"), "native_type", "generic_type",
                      "is_primary_key", "references", "row_count")


@register("structure_hash", f"""
SELECT "table", sha256(string_agg(line, chr(10) ORDER BY line)) AS structure_hash, any_value(row_count) AS row_count FROM (
 SELECT table_name AS "table", concat_ws('|', 'column', table_name, lpad(CAST(ordinal_position AS VARCHAR), 6, '0'), column_name, {_NATIVE},
  CAST(NOT ({_PK_SQL}) AS VARCHAR), CAST(({_PK_SQL}) AS VARCHAR)) AS line FROM {_COLS}
 UNION ALL SELECT * FROM (VALUES ('nation', 'fk|nation|n_regionkey|region'), ('supplier', 'fk|supplier|s_nationkey|nation')))
JOIN ({ORACLE["table_row_counts"]}) n USING ("table") GROUP BY "table" """)
def structure_hash(spark, sf_dir):
    tables = pick(Tables(spark, sf_dir), *DRIVER_TABLES)
    known = Constraints(CONSTRAINTS.primary_keys, tuple(k for k in CONSTRAINTS.foreign_keys if k[0] in DRIVER_TABLES))
    return inv.structure_hash(inv.schema_inventory(tables, known, with_counts=False), inv.foreign_keys(spark, known),
                              per_table=True).join(inv.row_counts(tables), "table")


@register("hash_sample")
def hash_sample(spark, sf_dir):
    lines = Tables(spark, sf_dir)["events"]
    return inv.hash_sample(lines, ["event_id"], 2000).select("event_id", "user_id", "event_type", "sample_method")


_SNAPSHOTS = """SELECT event_id AS snapshot_id, concat('src', CAST(user_id % 20 AS STRING)) AS source_id, ts AS created_at,
 CASE WHEN event_type <> 'click' THEN ts END AS profiled_at FROM {events}"""


@register("latest_snapshot", f"""SELECT source_id, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id
 ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM ({_SNAPSHOTS.format(events='events')}) WHERE profiled_at IS NOT NULL) WHERE rn = 1""")
def latest_snapshot(spark, sf_dir):
    return store.latest_snapshot(Tables(spark, sf_dir).sql(_SNAPSHOTS)).select("source_id", "snapshot_id")


_SAVES = """SELECT concat('src', CAST(user_id AS STRING)) AS source_id, event_id AS saved_at, event_type AS content FROM {events}"""


@register("model_version_history", f"""SELECT source_id, saved_at, content, saved, CAST(sum(CAST(saved AS INT)) OVER
 (PARTITION BY source_id ORDER BY saved_at) AS BIGINT) AS version FROM (SELECT *, coalesce(lag(content) OVER
 (PARTITION BY source_id ORDER BY saved_at) <> content, true) AS saved FROM ({_SAVES.format(events='events')}))""")
def model_version_history(spark, sf_dir):
    return store.version_history(Tables(spark, sf_dir).sql(_SAVES))


# ---- exact profiling ------------------------------------------------------------------------------
@register("profile_counts", _views(COLUMNS) + _each(COLUMNS, """SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS row_count,
 count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count FROM {t}"""))
def profile_counts(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.distinct_counts(tables[t], t) for t in DIRTY)


@register("profile_nulls", _views(COLUMNS) + _each(COLUMNS, """SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS row_count,
 count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_rate FROM {t}"""))
def profile_nulls(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.null_counts(tables[t], t) for t in DIRTY)


@register("profile_uniqueness", _views(COLUMNS) + _each(COLUMNS, """SELECT '{t}' AS "table", '{c}' AS "column",
 round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness, count(DISTINCT {c}) = 1 AS is_constant FROM {t}"""))
def profile_uniqueness(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.uniqueness(tables[t], t) for t in DIRTY)


@register("profile_numeric_exact", _views(NUMBERS) + _each(NUMBERS, """SELECT '{t}' AS "table", '{c}' AS "column",
 CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER ({c} = 0) AS zero_count,
 count(*) FILTER ({c} < 0) AS negative_count FROM {t}"""))
def profile_numeric_exact(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.per_column(tables[t], t, {c: p.numeric_measures(c) for c in cols}) for t, cols in NUMBERS.items())


_PLACEHOLDERS = ", ".join(f"'{d}'" for d in vocab.PLACEHOLDER_DATES)


@register("profile_dates", _views(DATES) + _each(DATES, f"""SELECT '{{t}}' AS "table", '{{c}}' AS "column",
 CAST(min({{c}}) AS VARCHAR) AS min, CAST(max({{c}}) AS VARCHAR) AS max, count(*) FILTER ({{c}} > DATE '2026-01-01') AS future_count,
 count(*) FILTER (CAST({{c}} AS VARCHAR) IN ({_PLACEHOLDERS})) AS placeholder_count, 0 AS unparseable_count FROM {{t}}"""))
def profile_dates(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.per_column(tables[t], t, {c: p.date_measures(tables[t], c, AS_OF) for c in cols}) for t, cols in DATES.items())


_TEXT_DATES = """SELECT o_orderkey, CASE WHEN o_orderkey % 613 = 5 THEN 'not a date' WHEN o_orderkey % 617 = 6 THEN '1996-13-40'
 WHEN o_orderkey % 619 = 7 THEN '2025' WHEN o_orderkey % 631 = 8 THEN '2031-01-15' WHEN o_orderkey % 641 = 9 THEN '9999-12-31'
 WHEN o_orderkey % 643 = 10 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS booked_on FROM {orders}"""


@register("profile_unparseable", f"""SELECT 'bookings' AS "table", 'booked_on' AS "column", min(booked_on) AS min, max(booked_on) AS max,
 count(*) FILTER (booked_on > '2026-01-01' AND substr(booked_on, 1, 4) BETWEEN '0000' AND '9999') AS future_count,
 count(*) FILTER (substr(booked_on, 1, 10) IN ({_PLACEHOLDERS})) AS placeholder_count,
 count(*) FILTER (booked_on IS NOT NULL AND NOT (regexp_full_match(booked_on, '\\d{{4}}-\\d{{2}}-\\d{{2}}')
   AND TRY_CAST(booked_on AS DATE) IS NOT NULL)) AS unparseable_count FROM ({_TEXT_DATES.format(orders='orders')})""")
def profile_unparseable(spark, sf_dir):
    bookings = Tables(spark, sf_dir).sql(_TEXT_DATES)
    return p.per_column(bookings, "bookings", {"booked_on": p.date_measures(bookings, "booked_on", AS_OF)})


_PLAIN = {t: tuple(c for c in COLUMNS[t] if c not in ("email", "phone")) for t in DIRTY}


@register("top_values", _views(_PLAIN) + f"""SELECT "table", "column", value, n AS count, round(n / total, 6) AS share, rank FROM (
 SELECT *, sum(n) OVER (PARTITION BY "table", "column") AS total, count(value) OVER (PARTITION BY "table", "column") AS k,
  row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM (
  {_each(_PLAIN, '''SELECT '{t}' AS "table", '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} GROUP BY 3''')}))
 WHERE k <= 50 AND rank <= 50""")
def top_values(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.top_values(tables[t], t, list(cols)) for t, cols in _PLAIN.items())


_FLAGS = """SELECT o_orderkey, o_orderstatus = 'F' AS is_final, CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'T'
 WHEN 3 THEN '1' WHEN 4 THEN 'maybe' WHEN 5 THEN NULL ELSE 'FALSE' END AS opt_in FROM {orders}"""


@register("profile_boolean", f"""SELECT "table", "column", count(*) FILTER (w IN ('1', 'true', 't', 'y', 'yes')) AS true_count,
 count(*) FILTER (w IN ('0', 'false', 'f', 'n', 'no')) AS false_count,
 coalesce(string_agg(DISTINCT v, ',') FILTER (w NOT IN ('1', 'true', 't', 'y', 'yes', '0', 'false', 'f', 'n', 'no')), '') AS invalid_values
 FROM (SELECT 'flags' AS "table", c AS "column", v, lower(trim(v)) AS w FROM (
  SELECT 'is_final' AS c, CAST(is_final AS VARCHAR) AS v FROM ({_FLAGS.format(orders='orders')}) UNION ALL
  SELECT 'opt_in', opt_in FROM ({_FLAGS.format(orders='orders')}))) GROUP BY 1, 2""")
def profile_boolean(spark, sf_dir):
    flags = Tables(spark, sf_dir).sql(_FLAGS)
    out = p.boolean_stats(p.top_values(flags, "flags", ["is_final", "opt_in"]))
    return out.withColumn("invalid_values", F.array_join("invalid_values", ","))


_FK = [k for k in CONSTRAINTS.foreign_keys if k[0] not in ("nation", "supplier")]


@register("fk_orphans", with_views("orders_dirty", "customer_dirty", "lineitem_dirty", "geo_nodes") + "\n" + "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c[0]}' AS columns, '{rt}' AS ref_table, count({c[0]}) AS checked, count(*) FILTER ({c[0]} IS NOT NULL AND
 {c[0]} NOT IN (SELECT {rc[0]} FROM {rt})) AS orphans, round(count(*) FILTER ({c[0]} IS NOT NULL AND {c[0]} NOT IN (SELECT {rc[0]} FROM {rt}))
 / count({c[0]}), 6) AS orphan_rate FROM {t}""" for t, c, rt, rc in _FK))
def fk_orphans(spark, sf_dir):
    return p.fk_orphans(Tables(spark, sf_dir), Constraints(foreign_keys=tuple(_FK)))


# ---- shape profiling ------------------------------------------------------------------------------
_SIG = "regexp_replace(regexp_replace(regexp_replace({c}, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g')"
_COLLAPSED = ("regexp_replace(regexp_replace(regexp_replace(pattern, 'A+', 'A', 'g'), 'a+', 'a', 'g'), '9+', '9', 'g')")
_SHAPES = _each(TEXTS, f"""SELECT '{{t}}' AS "table", '{{c}}' AS "column", {_SIG} AS pattern, count(*) AS n, min({{c}}) AS example
 FROM {{t}} WHERE {{c}} IS NOT NULL GROUP BY 3""")


def _shapes(spark, sf_dir, **kw):
    tables = Tables(spark, sf_dir)
    return p.union(p.shapes(tables[t], t, list(cols), **kw) for t, cols in TEXTS.items())


@register("value_signature", _views(TEXTS) + f"""SELECT "table", "column", pattern, {_COLLAPSED} AS collapsed, n FROM ({_SHAPES})""")
def value_signature(spark, sf_dir):
    return _shapes(spark, sf_dir)


_PATTERNS = f"""SELECT "table", "column", mode, rank, pattern, n AS count, round(n / total, 6) AS share, example FROM (
 SELECT *, CASE WHEN sum(n) FILTER (mode = 'exact' AND rank <= 10) OVER w / max(total) OVER w < 0.5 THEN 'collapsed' ELSE 'exact' END AS chosen
 FROM (SELECT *, row_number() OVER (PARTITION BY "table", "column", mode ORDER BY n DESC, pattern) AS rank,
  sum(n) OVER (PARTITION BY "table", "column", mode) AS total FROM (
   SELECT "table", "column", 'exact' AS mode, pattern, n, example FROM found UNION ALL
   SELECT "table", "column", 'collapsed', {_COLLAPSED}, sum(n), min(example) FROM found GROUP BY 1, 2, 4)) WINDOW w AS (PARTITION BY "table", "column"))
 WHERE mode = chosen AND rank <= 10"""
_FOUND = _views(TEXTS).rstrip() + f", found AS ({_SHAPES})\n"


@register("pattern_frequencies", _FOUND + f"SELECT * EXCLUDE (example) FROM ({_PATTERNS})")
def pattern_frequencies(spark, sf_dir):
    return p.patterns(_shapes(spark, sf_dir))


_SENSITIVE_COLUMNS = ("c_name", "email", "phone")
_MASK = ("CASE WHEN {c} IS NULL THEN NULL WHEN contains({c}, '@') THEN concat(substr({c}, 1, 1), '***@', substr(split_part({c}, '@', 2), 1, 1), "
         "'***.', split_part({c}, '.', -1)) WHEN length({c}) <= 4 THEN repeat('*', length({c})) ELSE concat(substr({c}, 1, 2), "
         "regexp_replace(substr({c}, 3, length({c}) - 4), '[A-Za-z0-9]', '*', 'g'), right({c}, 2)) END")


@register("pattern_examples", _FOUND + f"""SELECT "table", "column", rank, pattern, CASE WHEN "column" IN ('email', 'phone') THEN
 {_MASK.format(c='example')} ELSE example END AS example FROM ({_PATTERNS}) WHERE rank <= 3""")
def pattern_examples(spark, sf_dir):
    top = p.patterns(_shapes(spark, sf_dir, with_example=True)).where("rank <= 3")
    hidden = F.when(F.col("column").isin("email", "phone"), F.expr(text.mask("example"))).otherwise(F.col("example"))
    return top.select("table", "column", "rank", "pattern", hidden.alias("example"))


def _format_sql(spec) -> str:
    rates = _each(spec, "SELECT '{t}' AS \"table\", '{c}' AS \"column\", f.format, f.place, avg(CAST(regexp_matches({c}, f.rx) AS INT)) AS rate "
                        "FROM {t}, formats f GROUP BY 3, 4")
    listed = ", ".join(f"({i}, '{n}', '{rx}')" for i, (n, rx) in enumerate(vocab.FORMATS))
    keys = _each(spec, "SELECT '{t}' AS \"table\", '{c}' AS \"column\"")
    views = _views(spec).rstrip()
    return (f"{views}, formats(place, format, rx) AS (VALUES {listed}), rates AS ({rates}), best AS (SELECT *, row_number() OVER "
            f"(PARTITION BY \"table\", \"column\" ORDER BY rate DESC, place) AS rn FROM rates WHERE rate >= 0.8), keys AS ({keys})\n")


@register("detect_format", _format_sql(TEXTS) + """SELECT k."table", k."column", format, round(rate, 6) AS match_rate
 FROM keys k LEFT JOIN best b ON b."table" = k."table" AND b."column" = k."column" AND rn = 1""")
def detect_format(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.per_column(tables[t], t, {c: p.format_measures(c) for c in cols}) for t, cols in TEXTS.items())


_LONG = TEXTS | {"documents": ("text", "lang")}


@register("text_stats", _views(_LONG) + _each(_LONG, r"""SELECT '{t}' AS "table", '{c}' AS "column", min(length({c})) AS min_length,
 round(avg(length({c})), 2) AS avg_length, max(length({c})) AS max_length,
 count(*) FILTER (regexp_replace({c}, '^\s+|\s+$', '', 'g') = '') AS blank_count,
 count(*) FILTER (regexp_replace({c}, '^\s+|\s+$', '', 'g') <> {c}) AS untrimmed_count,
 count(*) FILTER (regexp_matches({c}, '[A-Za-z]') AND NOT regexp_matches({c}, '\p{{Ll}}')) AS upper_count,
 count(*) FILTER (regexp_matches({c}, '[A-Za-z]') AND NOT regexp_matches({c}, '\p{{Lu}}')) AS lower_count,
 count(*) FILTER (regexp_matches({c}, '[A-Za-z]') AND regexp_matches({c}, '\p{{Ll}}') AND regexp_matches({c}, '\p{{Lu}}')) AS mixed_case_count
 FROM {t}"""))
def text_stats(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.per_column(tables[t], t, {c: p.text_measures(c) for c in cols}) for t, cols in _LONG.items())


@register("mask_values", _views(("customer_dirty",)) + f"""SELECT c_custkey, {_MASK.format(c='email')} AS email, {_MASK.format(c='phone')} AS phone,
 {_MASK.format(c='c_name')} AS c_name, {_MASK.format(c='c_mktsegment')} AS c_mktsegment FROM customer_dirty""")
def mask_values(spark, sf_dir):
    return Tables(spark, sf_dir)["customer_dirty"].select(
        "c_custkey", *[F.expr(text.mask(c)).alias(c) for c in (*_SENSITIVE_COLUMNS[1:], "c_name", "c_mktsegment")])


@register("sensitive_columns", _format_sql(TEXTS) + f"""SELECT k."table", k."column", regexp_matches(k."column", '{vocab.SENSITIVE_NAME}', 'i') AS by_name,
 coalesce(format IN ('email', 'phone'), false) AS by_format FROM keys k LEFT JOIN best b ON b."table" = k."table" AND b."column" = k."column" AND rn = 1""")
def sensitive_columns(spark, sf_dir):
    found = detect_format(spark, sf_dir)
    return found.select("table", "column", F.expr(text.sensitive_name("column")).alias("by_name"),
                        F.coalesce(F.col("format").isin(*vocab.SENSITIVE_FORMATS), F.lit(False)).alias("by_format"))


@register("numeric_percentiles", _views(NUMBERS) + _each(NUMBERS, """SELECT '{t}' AS "table", '{c}' AS "column", round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.01), 4) AS p01, round(quantile_cont({c}, 0.05), 4) AS p05,
 round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.95), 4) AS p95, round(quantile_cont({c}, 0.99), 4) AS p99 FROM {t}"""))
def numeric_percentiles(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.numeric_shape(tables[t], t, list(cols)) for t, cols in NUMBERS.items()).select(
        "table", "column", "mean", "std", "p01", "p05", "median", "p95", "p99")


@register("numeric_outliers", _views(NUMBERS) + _each(NUMBERS, """SELECT '{t}' AS "table", '{c}' AS "column",
 CASE WHEN q3 > q1 THEN round(q1 - 3 * (q3 - q1), 4) END AS outlier_lo, CASE WHEN q3 > q1 THEN round(q3 + 3 * (q3 - q1), 4) END AS outlier_hi,
 (SELECT count(*) FROM {t} WHERE q3 > q1 AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))) AS outlier_count
 FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"""))
def numeric_outliers(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return p.union(p.numeric_shape(tables[t], t, list(cols)) for t, cols in NUMBERS.items()).select(
        "table", "column", "outlier_lo", "outlier_hi", "outlier_count")


# ---- whole profiles -------------------------------------------------------------------------------
_BUILT: dict[tuple, DataFrame] = {}


def profiles(spark, sf_dir, names=DIRTY):
    """Profile rows of some tables. Built once per session and folder, as a stored snapshot would be."""
    at = (spark.sparkContext.applicationId, sf_dir, tuple(names))
    if at not in _BUILT:
        _BUILT[at] = plan.profile_tables(pick(Tables(spark, sf_dir), *names), AS_OF, CONSTRAINTS)
    return _BUILT[at]


@register("profile_tables", _views(COLUMNS) + _each(COLUMNS, """SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS row_count,
 count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
 round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness FROM {t}"""))
def profile_tables(spark, sf_dir):
    return profiles(spark, sf_dir).select("table", "column", "row_count", "null_count", "distinct_count", "uniqueness")


@register("profile_documents")
def profile_documents(spark, sf_dir):
    """Long texts, JSON text, arrays: the columns the relational tables do not have."""
    names = ("documents", "pages", "events", "embeddings", "conversations", "labels")
    return profiles(spark, sf_dir, names).select("table", "column", "generic_type", "row_count", "null_count", "distinct_count",
                                                 "sensitive_hint", F.col("detected_format.format").alias("format"), "pattern_mode")


_NUMBERS_ALL = {"orders_dirty": ("o_orderkey", "o_custkey", "o_totalprice"), "customer_dirty": ("c_custkey", "c_nationkey", "c_acctbal", "home_node"),
                "lineitem_dirty": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")}
_TEXTS_ALL = {t: TEXTS[t] for t in ("orders_dirty", "customer_dirty")} | {"lineitem_dirty": ("l_returnflag", "l_linestatus")}
_FK_DIRTY = tuple(k for k in CONSTRAINTS.foreign_keys if k[0] in DIRTY)
_ORPHANS = "\n UNION ALL ".join(f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS k, '{rt}' AS ref FROM {t}
  WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {rt})""" for t, (c,), rt, (rc,) in _FK_DIRTY)
_SHAPES_ALL = _each(_TEXTS_ALL, f"""SELECT '{{t}}' AS "table", '{{c}}' AS "column", {_SIG} AS pattern, count(*) AS n, min({{c}}) AS example
 FROM {{t}} WHERE {{c}} IS NOT NULL GROUP BY 3""")


@register("profile_signals", with_views(*DIRTY, "geo_nodes") + ",\nstats AS (" + _each(COLUMNS, """SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS n,
 count({c}) AS nn, count(DISTINCT {c}) AS d FROM {t}""") + "),\nnums AS (" + _each(_NUMBERS_ALL, """SELECT '{t}' AS "table", '{c}' AS "column",
 count(*) FILTER ({c} < 0) AS neg, count(*) FILTER ({c} = 0) AS zero,
 count(*) FILTER (q3 > q1 AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))) AS outside
 FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})""") + f"""),
dates AS ({_each(DATES, f'''SELECT '{{t}}' AS "table", '{{c}}' AS "column", count(*) FILTER ({{c}} > DATE '2026-01-01') AS future,
 count(*) FILTER (CAST({{c}} AS VARCHAR) IN ({_PLACEHOLDERS})) AS ph FROM {{t}}''')}),
lost AS ({_ORPHANS}),
formats(place, format, rx) AS (VALUES {", ".join(f"({i}, '{n}', '{rx}')" for i, (n, rx) in enumerate(vocab.FORMATS))}),
rates AS ({_each(_TEXTS_ALL, '''SELECT '{t}' AS "table", '{c}' AS "column", f.format, f.place, avg(CAST(regexp_matches({c}, f.rx) AS INT)) AS rate
 FROM {t}, formats f GROUP BY 3, 4''')}),
best AS (SELECT * FROM rates WHERE rate >= 0.8 QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY rate DESC, place) = 1),
listed AS (SELECT *, round(m / sum(m) OVER w, 6) AS share, count(value) OVER w AS k, count(*) OVER w AS listed,
  row_number() OVER (PARTITION BY "table", "column" ORDER BY m DESC, value ASC NULLS LAST) AS rank FROM (
  {_each(COLUMNS, '''SELECT '{t}' AS "table", '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS m FROM {t} GROUP BY 3''')})
  WINDOW w AS (PARTITION BY "table", "column")),
rare AS (SELECT "table", "column", string_agg(value, ',' ORDER BY rank) FILTER (place <= 6) AS detail, coalesce(sum(share) FILTER (share >= 0.02), 0) AS dominant,
  count(*) FILTER (value IS NOT NULL AND share < 0.02) AS rares, any_value(listed) AS listed FROM (
  SELECT *, CASE WHEN value IS NOT NULL AND share < 0.02 THEN count(*) FILTER (value IS NOT NULL AND share < 0.02) OVER (
    PARTITION BY "table", "column" ORDER BY rank ROWS UNBOUNDED PRECEDING) END AS place FROM listed
  LEFT JOIN (SELECT "table", "column", format FROM best) b USING ("table", "column")
  WHERE k <= 50 AND rank <= 50 AND NOT regexp_matches("column", '{vocab.SENSITIVE_NAME}', 'i') AND coalesce(format NOT IN ('email', 'phone'), true))
  GROUP BY 1, 2),
found AS ({_SHAPES_ALL}),
minority AS (SELECT "table", "column", string_agg(pattern, ',' ORDER BY rank) AS detail FROM (
  SELECT * FROM ({_PATTERNS}) WHERE rank > 1 AND share < 0.02 QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY rank) <= 4) GROUP BY 1, 2)
SELECT "table", "column", 'nulls' AS signal, CAST(n - nn AS VARCHAR) AS detail FROM stats WHERE n > nn
UNION ALL SELECT "table", "column", 'near_unique', CAST(round(d / nn, 6) AS VARCHAR) FROM stats WHERE d / nn >= 0.95 AND d < nn
UNION ALL SELECT "table", "column", 'rare_values', detail FROM rare WHERE listed > 1 AND rares > 0 AND dominant >= 0.9
UNION ALL SELECT "table", "column", 'minority_patterns', detail FROM minority
UNION ALL SELECT "table", "column", 'format_mismatch', CAST(round(rate, 6) AS VARCHAR) FROM best WHERE round(rate, 6) < 1
UNION ALL SELECT "table", "column", 'negatives', CAST(neg AS VARCHAR) FROM nums WHERE neg > 0
UNION ALL SELECT "table", "column", 'zeros', CAST(zero AS VARCHAR) FROM nums WHERE zero > 0
UNION ALL SELECT "table", "column", 'outliers', CAST(outside AS VARCHAR) FROM nums WHERE outside > 0
UNION ALL SELECT "table", "column", 'placeholders', CAST(ph AS VARCHAR) FROM dates WHERE ph > 0
UNION ALL SELECT "table", "column", 'future_dates', CAST(future AS VARCHAR) FROM dates WHERE future > 0
UNION ALL SELECT "table", "column", 'orphans', concat(k, ' -> ', ref) FROM lost WHERE k > 0""")
def profile_signals(spark, sf_dir):
    """All signals of all columns, and the orphans of every link that these tables declare."""
    return plan.signals(profiles(spark, sf_dir), p.fk_orphans(Tables(spark, sf_dir), Constraints(foreign_keys=_FK_DIRTY)))


@register("profile_rare_signals")
def profile_rare_signals(spark, sf_dir):
    return plan.signals(profiles(spark, sf_dir)).where(
        F.col("signal").isin("rare_values", "minority_patterns", "format_mismatch", "outliers"))


@register("profile_summary", with_views("orders_dirty", "customer_dirty", "lineitem_dirty", "geo_nodes") + "\n" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS row_count, {len(COLUMNS[t])} AS columns,
 {' + '.join(f'CAST(count({c}) < count(*) AS INT)' for c in COLUMNS[t])} AS columns_with_nulls, {s} AS sensitive_columns,
 {links} AS fk_orphans, concat(count(*), ' full') AS sample FROM {t}"""
    for t, s, links in (
        ("orders_dirty", 0, "concat('o_custkey=', count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer_dirty)))"),
        ("customer_dirty", 2, "concat('c_nationkey=', count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM nation)), "
                              "', home_node=', count(*) FILTER (home_node NOT IN (SELECT node_id FROM geo_nodes)))"),
        ("lineitem_dirty", 0, "concat('l_orderkey=', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders_dirty)))"))))
def profile_summary(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    links = Constraints(foreign_keys=tuple(k for k in CONSTRAINTS.foreign_keys if k[0] in DIRTY))
    return plan.summary(profiles(spark, sf_dir), p.fk_orphans(tables, links))
