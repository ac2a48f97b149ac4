"""Driver tables and the dirty views over them.

Each modulo branch of a view is one planted defect. The SQL is the same text for Spark and DuckDB.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from plumbline import Attachment, Constraints, Entity, Hierarchy, Model

AS_OF = dt.date(2026, 1, 1)

VIEWS = {
    "orders_dirty": """
SELECT o_orderkey,
 CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000 WHEN o_orderkey % 89 = 1 THEN NULL ELSE o_custkey END AS o_custkey,
 CASE WHEN o_orderkey % 401 = 3 THEN 'o' WHEN o_orderkey % 409 = 4 THEN 'Fin' WHEN o_orderkey % 419 = 5 THEN '?' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 301 = 6 THEN -o_totalprice WHEN o_orderkey % 307 = 7 THEN NULL ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 701 = 8 THEN DATE '2030-05-05' WHEN o_orderkey % 709 = 9 THEN DATE '1900-01-01' ELSE CAST(o_orderdate AS DATE) END AS o_orderdate,
 o_orderpriority,
 concat('ORD-', lpad(CAST(CASE WHEN o_orderkey % 503 = 10 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING), 8, '0')) AS order_number
FROM {orders}""",
    "customer_dirty": """
SELECT c_custkey, c_name,
 CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 101 = 1 THEN concat('user', CAST(c_custkey AS STRING), 'example.com')
      WHEN c_custkey % 51 = 2 THEN 'user3@example.com' ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
 CASE WHEN c_custkey % 61 = 0 THEN '12345678' WHEN c_custkey % 67 = 1 THEN NULL ELSE concat('+91', CAST(9000000000 + c_custkey AS STRING)) END AS phone,
 CASE WHEN c_custkey % 71 = 0 THEN c_nationkey + 9000 ELSE c_nationkey END AS c_nationkey,
 CASE WHEN c_custkey % 131 = 0 THEN 'building' WHEN c_custkey % 137 = 1 THEN 'MACHINRY' ELSE c_mktsegment END AS c_mktsegment,
 c_acctbal, c_nationkey + 100 AS home_node
FROM {customer}""",
    "lineitem_dirty": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
 CASE WHEN l_partkey % 83 = 0 THEN 0.0 WHEN l_partkey % 103 = 1 THEN 5000.0 ELSE l_quantity END AS l_quantity,
 CASE WHEN l_partkey % 107 = 2 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
 CASE WHEN l_partkey % 109 = 3 THEN 1.2 ELSE l_discount END AS l_discount,
 l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate
FROM {lineitem}""",
    "geo_nodes": """
SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'REGION' AS node_level, r_name AS node_name FROM {region}
UNION ALL SELECT 100 + n_nationkey, CASE WHEN n_nationkey = 7 THEN 107 WHEN n_nationkey = 8 THEN 109 WHEN n_nationkey = 9 THEN 108
      WHEN n_nationkey = 11 THEN 999 ELSE n_regionkey END, CASE WHEN n_nationkey = 13 THEN 'NATN' ELSE 'NATION' END, n_name FROM {nation}
UNION ALL SELECT 10000 + s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN s_nationkey % 5 WHEN s_suppkey % 10 = 4 THEN NULL ELSE 100 + s_nationkey END,
      'SITE', s_name FROM {supplier}""",
    "geo_tree": """
SELECT node_id, CASE WHEN node_level = 'NATN' THEN 999 ELSE parent_id END AS parent_id, node_level, node_name FROM {geo_nodes}""",
    "reviews": """
SELECT user_id AS rule_id, event_id AS seq, ts AS decided_at,
 CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'modified' END AS decision,
 CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'wrong' WHEN event_id % 3 = 1 THEN 'too_strict' ELSE 'duplicate' END AS reason_code
FROM {events} WHERE event_type IN ('purchase','error','signup')""",
    "rule_candidates": """
SELECT event_id AS seq, user_id % 40 AS entity_no, event_type AS check_type, CAST(floor(value) AS INT) AS max_value, ts AS created_at,
 md5(concat_ws('|', event_type, CAST(user_id % 40 AS STRING), CAST(CAST(floor(value) AS INT) AS STRING))) AS fingerprint,
 concat_ws('|', event_type, CAST(user_id % 40 AS STRING)) AS similarity_key
FROM {events}""",
}


class Tables(dict):
    """Driver tables by name, opened on first use; dirty views are built over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in VIEWS:
            df = self.sql(VIEWS[name])
        else:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = df
        return df

    def sql(self, text: str) -> DataFrame:
        """SQL whose {names} are tables or views."""
        import string
        names = {f for _, f, _, _ in string.Formatter().parse(text) if f}
        return self.spark.sql(text, **{n: self[n] for n in names})


def pick(tables: Tables, *names: str) -> dict[str, DataFrame]:
    return {n: tables[n] for n in names}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH clause that defines dirty views for DuckDB."""
    if "geo_tree" in names and "geo_nodes" not in names:
        names = ("geo_nodes", *names)
    parts = [f"{n} AS ({VIEWS[n].format_map(_Bare())})" for n in names]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)


class _Bare(dict):
    def __missing__(self, key):
        return key


CONSTRAINTS = Constraints(
    primary_keys={"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",),
                  "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
                  "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",),
                  "pages": ("page_id",), "benchmark": ("item_id",),
                  "orders_dirty": ("o_orderkey",), "customer_dirty": ("c_custkey",), "geo_nodes": ("node_id",), "geo_tree": ("node_id",)},
    foreign_keys=(
        ("orders_dirty", ("o_custkey",), "customer_dirty", ("c_custkey",)),
        ("customer_dirty", ("c_nationkey",), "nation", ("n_nationkey",)),
        ("customer_dirty", ("home_node",), "geo_nodes", ("node_id",)),
        ("geo_nodes", ("parent_id",), "geo_nodes", ("node_id",)),
        ("lineitem_dirty", ("l_orderkey",), "orders_dirty", ("o_orderkey",)),
        ("nation", ("n_regionkey",), "region", ("r_regionkey",)),
        ("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ),
    unique=(("orders_dirty", ("order_number",)), ("customer_dirty", ("email",))),
)

GEO = Hierarchy("geo", "geo_node", "parent_id", "node_level", ("REGION", "NATION", "SITE"),
                (Attachment("customer", "home_node", "NATION"),))
MODEL = Model(
    entities={
        "order": Entity("order", "orders_dirty", ("o_orderkey",)),
        "customer": Entity("customer", "customer_dirty", ("c_custkey",), pii=("email", "phone", "c_name")),
        "lineitem": Entity("lineitem", "lineitem_dirty"),
        "nation": Entity("nation", "nation", ("n_nationkey",)),
        "part": Entity("part", "part", ("p_partkey",)),
        "geo_node": Entity("geo_node", "geo_nodes", ("node_id",)),
    },
    hierarchies={"geo": GEO},
)
