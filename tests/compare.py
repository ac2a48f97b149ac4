"""Run registered queries and their SQL side by side: python -m tests.compare [sf] [key ...]"""
from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), _rows(names, cur.fetchall())


ROWS = {}


def difference(spark, con, query, sql, sf_dir) -> str | None:
    names, got = spark_rows(query(spark, sf_dir))
    want_names, want = duck_rows(con, sql)
    ROWS["last"] = len(got)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        only_got = [r for r in got if r not in want][:3]
        only_want = [r for r in want if r not in got][:3]
        return f"rows {len(got)} / {len(want)}\n  spark {only_got}\n  sql   {only_want}"
    return None


def main() -> None:
    import __spark_entry__ as e
    from tests.session import make_session
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    bad = 0
    for key in args[1:] or queries:
        start = time.time()
        try:
            if key in oracle:
                diff = difference(spark, con, queries[key], oracle[key], sf_dir)
                note = f"{ROWS['last']} rows"
            else:
                diff, note = None, f"rows {len(queries[key](spark, sf_dir).collect())} (no SQL)"
        except Exception as ex:  # noqa: BLE001
            diff = f"{type(ex).__name__}: {str(ex)[:900]}"
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {key} {time.time() - start:.1f}s {diff or note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
