"""Violation bitmaps against the plain run, their scans, and heavy keys cut by weight."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import Entity, Model, Rule
from plumbline.functions.skew import rows_of_keys
from plumbline.plans import bitmap, suite
from queries import checks, scoring
from queries.dirty import MODEL, Tables, pick

AS_OF = dt.date(2026, 1, 1)
SHOP = Model({"sale": Entity("sale", "sale", ("id",), pii=("mail",)), "till": Entity("till", "till", ("no",)), "line": Entity("line", "line")})


def shop(spark):
    sale = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.col("id") % 40).alias("till"),
        (F.col("id") % 11).alias("amount"), F.concat(F.lit("m"), (F.col("id") % 700).cast("string"), F.lit("@shop.example")).alias("mail"))
    line = spark.range(3000).select((F.col("id") % 30).alias("till"), (F.col("id") % 7).cast("double").alias("price"))
    return {"sale": sale.union(sale.where("id < 5")), "till": spark.range(35).select(F.col("id").alias("no")), "line": line}


def rules() -> list[Rule]:
    compare = {"type": "aggregate_compare", "child_entity": "line", "child_join_columns": ["till"], "parent_join_columns": ["till"],
               "child_expression": "MAX(price)", "operator": ">=", "parent_expression": "amount"}
    out = [Rule("mail", "sale", {"type": "unique"}, ("mail",)), Rule("mail late", "sale", {"type": "unique"}, ("mail",), filter="id > 600"),
           Rule("till", "sale", {"type": "foreign_key", "ref_entity": "till", "ref_columns": ["no"]}, ("till",)), Rule("lines", "sale", compare),
           Rule("lines", "sale", {"type": "has_children", "child_entity": "line", "child_join_columns": ["till"], "parent_join_columns": ["till"]}, filter="amount > 2"),
           Rule("gone", "sale", {"type": "range", "min": 0}, ("nothing",)), Rule("id", "sale", {"type": "unique"}, ("id",), tolerance=0.5)]
    out += [Rule(f"a{i}", "sale", {"type": "range", "max": i % 13}, ("amount",), filter="till = 1" if i % 2 else None) for i in range(64)]
    return out + [Rule("own", "till", {"type": "custom_sql", "sql": "SELECT no FROM till WHERE no > 30"}), Rule("none", "till", {"type": "not_null"}, ("no",))]


def listed(df):
    return sorted(((r.rule_id, r.entity, r.key, tuple(sorted(r.shown.items()))) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sent", [bitmap.KEYS_SENT, 0])
def test_bitmaps_equal_the_plain_run(spark, monkeypatch, sent):
    monkeypatch.setattr(bitmap, "KEYS_SENT", sent)
    tables = shop(spark)
    run = bitmap.run_rules(tables, rules(), SHOP, AS_OF)

    def order(df):
        return sorted(map(tuple, df.collect()), key=repr)
    assert order(run.results()) == order(suite.execute_rules(tables, rules(), SHOP, AS_OF))
    plain = suite.violations(tables, rules(), SHOP, AS_OF)
    assert listed(run.violations()) == listed(plain)
    assert order(run.examples(3)) == order(suite.violation_examples(tables, rules(), SHOP, AS_OF, 3))
    failing = run.results().where("NOT passed").select("rule_id").distinct()
    assert order(run.alarms()) == order(plain.join(failing, "rule_id", "left_semi").select("entity", "key").distinct())
    assert set(run.tables) == {"sale", "till"} and len(run.order["sale"]) > bitmap.BITS


def test_nothing_to_run(spark):
    run = bitmap.run_rules(shop(spark), [], SHOP, AS_OF)
    assert run.results().count() == run.violations().count() == run.alarms().count() == 0
    empty = {k: v.limit(0) for k, v in shop(spark).items()}
    assert {(r.total, r.failed) for r in bitmap.run_rules(empty, rules()[:5], SHOP, AS_OF).results().collect()} == {(0, 0)}


def test_one_scan_decides_all_keys_and_one_all_rows(spark, sf_dir):
    tables = pick(Tables(spark, sf_dir), *checks.ALL_VIEWS)
    every = [checks.CHECKS[k][0] for k in checks.LISTED]
    p = suite.Prepared(tables, suite.numbered(every), checks.LISTING, AS_OF)
    for entity, source in (("order", "orders"), ("customer", "customer"), ("lineitem", "lineitem")):
        (group, counted), = bitmap.key_scans(p, entity)
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and f"{source}.parquet" in plan
        found = [(b, scopes, b.decide(spark.createDataFrame([], counted.select(*[F.col(f"b{i}_{k}").alias(k) for k in b.keys], "n_rows", *[c for c in counted.columns if c.startswith("n_rule")]).schema)), 1)
                 for i, (b, scopes) in enumerate(group)]
        found = [(b, s, failing.select(*b.keys, "n_rows", *[f"bad_{r.rule_id}" for r in b.rules]), n) for b, s, failing, n in found]
        order = [(r, list(r.columns)) for r in [r for r, *_ in p.row[entity]] + [r for b, *_ in found for r in b.rules]]
        failing, _, _ = bitmap.row_scan(p, entity, found, order)
        plan = failing._jdf.queryExecution().optimizedPlan().toString()
        assert sum(f"o_orderkey#" in line and "Relation" in line for line in plan.splitlines()) <= 1
        assert plan.count("CollectMetrics") == 1
    assert len(bitmap.key_scans(p, "order")[0][0]) == sum(b.entity == "order" for b, *_ in p.batches) >= 3


def test_coverage_sends_no_growing_table(spark, sf_dir):
    plan = scoring.issue_keys(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull((" not in plan and "LeftAnti" in plan      # a null-aware anti join would always be broadcast


def test_heavy_keys_are_cut_by_weight(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = spark.range(0, 9000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 200).alias("k"))
        keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        got = rows_of_keys(rows, keyed, ["k"], "n", hot_rows=100)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 9000 and max(sizes) < 2 * 9000 / 8
        left = rows_of_keys(rows, keyed.where("k < 0"), ["k"], "n", hot_rows=100, how="left")
        assert left.count() == 9000 and left.where("top IS NULL").count() == 6000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_examples_unfold_few_rows(spark, monkeypatch):
    """Rows that cannot be among the first of their rule are not unfolded; equal, NULL and non-ASCII keys keep the plain run's examples."""
    names = spark.range(4000).selectExpr("CASE WHEN id % 500 = 3 THEN NULL WHEN id % 7 = 1 THEN concat('é', id % 90) WHEN id % 11 = 2 THEN repeat('long', 9) "
                                         "ELSE concat('k', 100000 + id) END AS id", "id % 10 AS a", "id % 1000 AS b")
    model = Model({"row": Entity("row", "row", ("id",))})
    some = [Rule("a", "row", {"type": "range", "max": 4}, ("a",)), Rule("b", "row", {"type": "range", "max": 997}, ("b",)),
            Rule("b", "row", {"type": "range", "min": 2}, ("b",)), Rule("u", "row", {"type": "unique"}, ("id",))]
    unfolded = []
    monkeypatch.setattr(suite, "examples_of", lambda rows, *more, real=suite.examples_of: (unfolded.append(rows.count()), real(rows, *more))[1])
    run = bitmap.run_rules({"row": names}, some, model, AS_OF)
    found = run.examples(4)
    assert unfolded[0] < 300 < 2000 < run.violations().count()
    monkeypatch.undo()
    assert sorted(map(str, found.collect())) == sorted(map(str, suite.violation_examples({"row": names}, some, model, AS_OF, 4).collect()))
