import pytest
from pyspark.sql import functions as F

from plumbline import Constraints
from plumbline.model import bare_names, entity_id
from plumbline.operators import inference as inf, links as lk, merge


def classify(spark, counts):
    df = spark.createDataFrame([([(v, n, 0.0) for v, n in counts],)], "v array<struct<value:string,count:bigint,share:double>>")
    row = df.select(F.expr(inf.classify_values("v")).alias("s")).first().s
    return row.allowed, {a["value"]: a["looks_like"] for a in row.anomalies}


@pytest.mark.parametrize("counts,valid,odd", [
    ([("READY", 8000), ("BROKEN", 900), ("STORED", 700), ("MOVING", 90), ("Brkn", 7), ("ready", 5), ("nothing", 4), ("STORD", 3)],
     ["READY", "BROKEN", "STORED", "MOVING"], {"Brkn": "BROKEN", "ready": "READY", "STORD": "STORED", "nothing": None}),
    ([("Y", 1640), ("N", 1580), ("Yes", 6), ("no", 3), ("Q", 2)], ["Y", "N"], {"Yes": "Y", "no": "N", "Q": None}),
    ([("TRAIN", 800), ("NIGHT_BUS", 500), ("FERRY", 300), ("bus", 4)], ["TRAIN", "NIGHT_BUS", "FERRY"], {"bus": "NIGHT_BUS"}),
    ([("RED", 50), ("BLUE", 30), ("GREEN", 20)], ["RED", "BLUE", "GREEN"], {})])
def test_classify_values(spark, counts, valid, odd):
    assert classify(spark, counts) == (valid, odd)


def test_names():
    assert [entity_id(t) for t in ("companies", "stock_moves", "dishes", "glass", "2030 plans")] == [
        "company", "stock_move", "dish", "glass", "t_2030_plan"]
    assert bare_names(["o_id", "o_date"]) == {"o_id": "id", "o_date": "date"}
    assert bare_names(["id", "o_date"]) == {"id": "id", "o_date": "o_date"}


def test_links_without_declared_keys(spark):
    tables = {"customers": spark.range(1, 51).toDF("id"),
              "orders": spark.range(200).select(F.col("id"), (F.col("id") % 50 + 1).alias("cust_id")),
              "notes": spark.range(20).select(F.col("id"), (F.col("id") + 1000).alias("customer_id"))}
    found = lk.infer_links(tables, Constraints({t: ("id",) for t in tables})).collect()
    assert [(r.table, r.column, r.parent, r.confidence) for r in found] == [("orders", "cust_id", "customers", 0.9)]


def test_levels(spark):
    rows = [(1, None, "TOP"), (2, 1, "MID"), (3, 1, "MID"), (4, 2, "LOW"), (5, 3, "LOW"), (6, 1, "LOW"), (7, 99, "ODD")]
    nodes = spark.createDataFrame(rows, "id int, parent int, lv string")
    counts = lk.level_counts(nodes, "id", "parent", "lv")
    assert lk.level_chain(counts) == ["TOP", "MID", "LOW"]
    problems = {(r.level, r.parent_level): r.problem for r in lk.level_evidence(counts, ["TOP", "MID", "LOW"]).collect()}
    assert problems == {("LOW", "TOP"): "have a TOP parent (expected MID)", ("ODD", "__missing__"): "level outside the hierarchy"}


def test_dangling_references(spark):
    entities = spark.createDataFrame([("a",)], "entity_id string")
    attributes = spark.createDataFrame([("a", "x")], "entity_id string, column string")
    wanted = spark.createDataFrame([("p", "a", "x"), ("q", "a", "y"), ("r", "b", "x"), ("s", "a", None)], "place string, entity_id string, column string")
    got = {r.place: r.problem for r in merge.dangling_references(entities, attributes, wanted).collect()}
    assert got == {"q": "unknown attribute", "r": "unknown entity"}
