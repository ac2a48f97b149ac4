"""Every signal of a profile is reported, for whole tables of own rows."""
import __spark_entry__ as entry_point
from tests.compare import difference


def own_tables(con, folder):
    day = "TIMESTAMP '1995-01-01' + to_days(CAST(i % 900 AS INTEGER))"
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'EAST' AS r_name",
        "nation": "SELECT i AS n_nationkey, 0 AS n_regionkey, 'N' || i AS n_name FROM range(2) r(i)",
        "supplier": "SELECT i AS s_suppkey, 'S' || i AS s_name, i % 2 AS s_nationkey FROM range(3) r(i)",
        "customer": """SELECT i AS c_custkey, 'Customer#' || i AS c_name, i % 3 AS c_nationkey, CASE WHEN i = 7 THEN 'ODD' ELSE 'BUILDING' END AS c_mktsegment,
                       CASE WHEN i = 9 THEN 1e9 ELSE i - 5.5 END AS c_acctbal FROM range(200) r(i)""",
        "orders": f"""SELECT i AS o_orderkey, i % 200 AS o_custkey, CASE WHEN i = 5 THEN 'x' ELSE 'F' END AS o_orderstatus, 10.0 + i AS o_totalprice,
                      CASE WHEN i = 3 THEN TIMESTAMP '2031-01-01' WHEN i = 4 THEN TIMESTAMP '1900-01-01' ELSE {day} END AS o_orderdate, '1-URGENT' AS o_orderpriority
                      FROM range(1500) r(i)""",
        "lineitem": f"""SELECT CASE WHEN i < 3 THEN 90000 + i ELSE i END AS l_orderkey, i % 100 AS l_partkey, 1 AS l_suppkey, 1 AS l_linenumber, 5.0 AS l_quantity,
                        100.0 + i AS l_extendedprice, 0.1 AS l_discount, CASE WHEN i = 8 THEN 'r' ELSE 'R' END AS l_returnflag, 'O' AS l_linestatus,
                        {day} AS l_shipdate FROM range(1500) r(i)""",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def test_profile_signals_are_whole(spark, tmp_path):
    import duckdb
    own_tables(duckdb.connect(), tmp_path)
    con = duckdb.connect()
    for name in ("region", "nation", "supplier", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    query = entry_point.queries()["profile_signals"]
    found = {tuple(r) for r in query(spark, str(tmp_path)).select("table", "column", "signal", "detail").collect()}
    assert {s for _, _, s, _ in found} == {"nulls", "near_unique", "rare_values", "minority_patterns", "format_mismatch", "negatives", "zeros", "outliers",
                                           "placeholders", "future_dates", "orphans"}
    assert {("lineitem_dirty", "l_orderkey", "orphans", "3 -> orders_dirty"), ("lineitem_dirty", "l_returnflag", "rare_values", "r"),
            ("lineitem_dirty", "l_returnflag", "minority_patterns", "a"), ("customer_dirty", "home_node", "orphans", "66 -> geo_nodes")} <= found
    assert difference(spark, con, query, entry_point.oracle_sql()["profile_signals"], str(tmp_path)) is None
