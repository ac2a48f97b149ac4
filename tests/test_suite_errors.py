"""A rule that cannot run is reported beside the others; ids are free text."""
import datetime as dt

from pyspark.sql import functions as F

from plumbline import Entity, Hierarchy, Model, Rule
from plumbline.operators import links as lk
from plumbline.plans.suite import execute_rules, violations

AS_OF = dt.date(2026, 1, 1)
MODEL = Model({"part": Entity("part", "part", ("no",)), "loose": Entity("loose", "part")},
              {"good": Hierarchy("good", "part", "over", "kind", ("SET", "ITEM")), "no_parent": Hierarchy("no_parent", "part", "gone", "kind", ("SET", "ITEM")),
               "no_key": Hierarchy("no_key", "loose", "over", "kind", ("SET", "ITEM"))})


def _tables(spark):
    return {"part": spark.createDataFrame([(10, None, "SET", 3.5), (20, 10, "ITEM", -2.0), (30, 40, "ITEM", 7.0), (40, 30, "ITEM", None)],
                                          "no int, over int, kind string, price double")}


def test_broken_tree_rules_do_not_end_the_run(spark):
    rules = [Rule(h, "part", {"type": "hierarchy_acyclic", "hierarchy": h}) for h in MODEL.hierarchies] + [Rule("low", "part", {"type": "range", "min": 0}, ("price",))]
    got = {r.rule_id: (r.total, r.failed, r.error is not None) for r in execute_rules(_tables(spark), rules, MODEL, AS_OF).collect()}
    assert got == {"good": (4, 2, False), "no_parent": (0, 0, True), "no_key": (0, 0, True), "low": (4, 1, False)}
    assert sorted((r.rule_id, r.key) for r in violations(_tables(spark), rules, MODEL, AS_OF).collect()) == [("good", "30"), ("good", "40"), ("low", "20")]


def test_ids_are_free_text(spark):
    low, unique = {"type": "range", "min": 0}, {"type": "unique"}
    rules = [Rule("a.1", "part", low, ("price",)), Rule("a.1", "part", {"type": "not_null"}, ("price",)), Rule("it's `b`", "part", unique, ("kind",)),
             Rule("a.1", "part", unique, ("kind",), filter="no > 20")]
    got = sorted((r.rule_id, r.check_type, r.failed) for r in execute_rules(_tables(spark), rules, MODEL, AS_OF).collect())
    assert got == [("a.1", "not_null", 1), ("a.1", "range", 1), ("a.1", "unique", 2), ("it's `b`", "unique", 3)]
    listed = violations(_tables(spark), rules, MODEL, AS_OF).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.rule_id: r.n for r in listed} == {"a.1": 4, "it's `b`": 3}


def test_no_rules(spark):
    assert execute_rules(_tables(spark), [], MODEL, AS_OF).collect() == []
    assert violations(_tables(spark), [], MODEL, AS_OF).collect() == []


def test_many_levels(spark):
    deep = spark.range(60).select(F.col("id").alias("no"), F.when(F.col("id") > 0, F.col("id") - 1).alias("over"), F.concat(F.lit("L"), F.col("id")).alias("kind"))
    counts = lk.level_counts(deep, "no", "over", "kind")
    assert lk.level_chain(counts) == [f"L{i}" for i in range(60)]
    assert lk.level_evidence(counts, lk.level_chain(counts)).count() == 0


def test_no_chain_leaves_every_level_outside(spark):
    flat = spark.createDataFrame([(1, 2, "A"), (2, 1, "B")], "no int, over int, kind string")
    counts = lk.level_counts(flat, "no", "over", "kind")
    assert lk.level_chain(counts) is None
    assert {r.problem for r in lk.level_evidence(counts, None).collect()} == {"level outside the hierarchy"}
