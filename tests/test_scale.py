"""The parts that keep large and skewed data balanced, forced to run on small data and compared with the plain way."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from plumbline import Entity, Hierarchy, Model, Rule, vocab
from plumbline.functions import quantiles
from plumbline.functions.quantiles import exact_quantiles
from plumbline.functions.text import q
from plumbline.functions.skew import previous_in_key, rows_of_keys, running_sum
from plumbline.model import Constraints
from plumbline.operators import profiling
from plumbline.operators.cycles import cycle_nodes
from plumbline.operators.profiling import (counted_values, distinct_counts, fk_orphans, format_measures, low_cardinality, null_measures,
                                            numeric_measures, shapes, text_measures, value_counts)
from plumbline.plans import profile
from plumbline.plans.profile import profile_table, profile_tables
from plumbline.plans.suite import execute_rules, violation_examples
from queries import checks
from queries.dirty import MODEL, Tables, pick

AS_OF = dt.date(2026, 1, 1)


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_quantiles(spark, limit):
    rng = np.random.default_rng(1)
    smooth, ties = rng.normal(size=4000), rng.integers(0, 3, 4000).astype(float)
    ties[:1500] = 1.0
    df = spark.createDataFrame([(float(a), float(b), None if i % 3 else float(i), float("nan")) for i, (a, b) in enumerate(zip(smooth, ties))],
                               "a double, b double, c double, d double")
    shares = (0.01, 0.25, 0.5, 0.75, 0.99)
    got = exact_quantiles(df, ["a", "b", "c", "d"], shares, direct_values=limit)
    for name, values in (("a", smooth), ("b", ties), ("c", np.arange(0, 4000, 3))):
        assert np.allclose(got[name], np.quantile(values, shares), atol=1e-12)
    assert got["d"] is None


@pytest.mark.parametrize("name,values", [
    ("one heavy value", np.r_[np.full(9000, 0.5), np.linspace(0, 1, 1000)]),
    ("two heavy values with a few between", np.r_[np.full(6000, 1.0), np.linspace(1.1, 1.9, 7), np.full(6000, 2.0)]),
    ("equal values", np.full(3000, 7.0)),
    ("far apart", np.r_[-np.inf, -1e300, np.arange(2000) * 1e-300, 1e300, np.inf]),
    ("next to each other", 1 + np.arange(12000) * 2.0 ** -52),
    ("one row", np.array([3.25])),
    ("powers", 2.0 ** np.linspace(-900, 900, 11000))])
def test_quantiles_of_hard_values(spark, name, values):
    """Ranks are searched for without a window or a list of values, so no distribution needs one large task."""
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(2).permutation(values)], "`a b` double").repartition(5)
    shares = (0.0, 0.001, 0.25, 0.5, 0.5003, 0.999, 1.0)
    got = exact_quantiles(df, ["a b"], shares, direct_values=0)["a b"]
    ordered = np.sort(values)
    for p, found in zip(shares, got):
        at = p * (len(values) - 1)
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert found == (low if low == high else low + (at - np.floor(at)) * (high - low)), (name, p)


def walk(parents):
    on = set()
    for start in parents:
        seen, node = [], start
        while node in parents and node not in seen:
            seen.append(node)
            node = parents[node]
        if node in seen:
            on |= set(seen[seen.index(node):])
    return on


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**9), (2, 1), (3, 1)])
def test_cycles(spark, seed, hot_rows):
    rnd = random.Random(seed)
    n = 120
    parents = {i: rnd.choice([None, 7, rnd.randrange(n), n + 5]) for i in range(n)} | {7: 8, 8: 9, 9: 8, 30: 30}
    parents |= {i: i + 1 for i in range(60, 90)}
    df = spark.createDataFrame(list(parents.items()), "id int, up int")
    nodes, count = cycle_nodes(df, "id", "up", hot_rows=hot_rows)
    assert {r.node for r in nodes.collect()} == walk(parents) and count == len(walk(parents))


def test_rows_of_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k < 100")
    got = rows_of_keys(rows, keyed, ["k"], "n", hot_rows=100)
    assert got.count() == rows.join(keyed.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).count() > 2000
    assert got.select("id").distinct().count() == got.count()


def test_runs_equal_one_window(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("k"), (F.col("id") * 7 % 5).alias("v")).where("id % 11 <> 3")
    whole = Window.partitionBy("k").orderBy("id")
    want = df.withColumn("before", F.lag("v").over(whole)).withColumn("total", F.sum("v").over(whole))
    got = running_sum(previous_in_key(df, "k", "id", ["v"], run=20), "k", "id", F.col("v"), "total", run=20)
    got = got.select("id", "k", "v", F.col("previous.v").alias("before"), "total")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_low_cardinality_never_loses_a_column(spark):
    df = spark.range(5000).selectExpr("id % 50 AS a", "id % 49 AS b", "id % 3 AS c", "id AS d", "hash(id % 50) AS e")
    assert low_cardinality(df, df.columns) == ["a", "b", "c", "e"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_row_rules_share_one_scan(spark, sf_dir):
    rules = [checks.CHECKS[k][0] for k in ("chk_not_null", "chk_allowed_values", "chk_range", "chk_date_not_future", "chk_conditional")]
    logical, physical = plan(execute_rules(pick(Tables(spark, sf_dir), "orders_dirty"), rules, MODEL, AS_OF))
    assert physical.count("FileScan parquet") == 1 and "Python" not in physical
    assert "o_orderpriority" not in physical.split("ReadSchema")[1]


def test_child_rules_share_one_child_scan(spark, sf_dir):
    rules = [checks.CHECKS[k][0] for k in ("chk_has_children", "chk_aggregate_equal", "chk_aggregate_order")]
    _, physical = plan(execute_rules(pick(Tables(spark, sf_dir), "orders_dirty", "lineitem_dirty"), rules, MODEL, AS_OF))
    assert physical.count("FileScan parquet") == 2


def test_examples_are_cut_before_the_shuffle(spark, sf_dir):
    rules = [checks.CHECKS["chk_range_both"][0]]
    _, physical = plan(violation_examples(pick(Tables(spark, sf_dir), "lineitem_dirty"), rules, MODEL, AS_OF))
    assert physical.count("WindowGroupLimit") == 2


def test_no_cartesian_product(spark, sf_dir):
    import __spark_entry__ as e
    for key in ("rule_suite_results", "rule_violations", "infer_foreign_keys", "numeric_outliers", "rule_coverage", "name_hints"):
        _, physical = plan(e.queries()[key](spark, sf_dir))
        assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical, key

def test_profile_counts_copy_no_rows(spark):
    """All columns in one distinct aggregate copied every row once per column; a column's values are counted alone."""
    df = spark.range(300).selectExpr("id", "id % 7 AS n", "CAST(NULLIF(id % 3, 0) AS DOUBLE) AS f", "concat('v', id % 5) AS s", "map(1, id) AS m")
    found = distinct_counts(df, "t")
    assert "Expand" not in plan(found)[1]
    assert {tuple(r) for r in found.collect()} == {("t", "id", 300, 300, 300), ("t", "n", 300, 300, 7), ("t", "f", 300, 200, 2), ("t", "s", 300, 300, 5)}


def test_measures_of_counted_values(spark):
    """Measures over (value, n) equal the measures over rows, NULL and NaN included."""
    df = spark.createDataFrame([(t, f) for t, f in zip(["a ", "B", None, "Xy", "", "a@b.com"] * 5 + ["B"] * 7, [1.0, 0.0, None, -2.0, float("nan"), 3.0] * 6)],
                               "t string, f double")
    for c, row_wise in (("t", {**null_measures("t"), **text_measures("t"), **format_measures("t")}), ("f", {**null_measures("f"), **numeric_measures("f")})):
        by_value = ({**null_measures(c, "n"), **text_measures(c, "n"), **format_measures(c, "n")} if c == "t"
                    else {**null_measures(c, "n"), **numeric_measures(c, "n")})
        want = df.selectExpr(*[f"{e} AS {k}" for k, e in row_wise.items()]).first()
        assert counted_values(df, c).selectExpr(*[f"{e} AS {k}" for k, e in by_value.items()]).first() == want
        assert counted_values(df.limit(0), c).selectExpr(*[f"{e} AS {k}" for k, e in by_value.items()]).first() == df.limit(0).selectExpr(
            *[f"{e} AS {k}" for k, e in row_wise.items()]).first()


def test_ranks_are_searched_in_stored_values(spark, monkeypatch):
    """Rounds read a plain stored column, later ones the rows of open ranges alone: the computed column is scanned for its size and to store it."""
    sizes = []
    monkeypatch.setattr(quantiles, "_round", lambda rows, wide, real=quantiles._round: (sizes.append(rows.count()), real(rows, wide)))
    df = spark.range(60_000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id * 37 % 60001 / 8 END AS v")
    quantiles.exact_quantiles(df, ["v"], (0.25, 0.5), direct_values=10)
    assert sizes[0] == 51_428 and all(n < 1000 for n in sizes[1:])


@pytest.mark.parametrize("weights", ["n = v", "one heavy", "random"])
def test_ranks_are_searched_in_counted_values(spark, weights):
    """Ranks come from (value, n) alone, also where counts depend on values, so that the sketch of distinct values names the wrong ones."""
    v = np.arange(3000) * 1.5 - 700
    n = {"n = v": np.arange(1, 3001), "one heavy": np.where(np.arange(3000) == 11, 90_000, 1), "random": np.random.default_rng(3).integers(1, 9, 3000)}[weights]
    stored = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n)] + [(None, 5), (float("nan"), 7)], "v double, n bigint").repartition(4)
    shares, rows = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0), np.repeat(v, n)
    for limit in (0, 10_000):
        got = exact_quantiles(stored, ["v"], shares, direct_values=limit, counted={"v": stored})["v"]
        assert np.allclose(got, np.quantile(rows, shares), atol=1e-9)


def test_profile_reads_counted_values_after_the_first_scan(spark, monkeypatch):
    """A column's rows are grouped once; quantiles, top values, patterns and orphans read the counted values. Results as from the rows."""
    seen = []
    monkeypatch.setattr(profiling, "counted_values", lambda df, c, real=counted_values: (seen.append(c), real(df, c))[1])
    df = spark.range(900).selectExpr("id % 4 AS k", "id * 3 % 700 / 4 AS v", "CASE WHEN id % 9 > 0 THEN concat('A-', id % 60) END AS s", "CAST(NULL AS VOID) AS w")
    kept = {}
    rows = profile_table(df, "t", dt.date(2026, 1, 1), kept=kept)
    assert sorted(seen) == ["k", "s", "v", "w"] and set(kept) == {("t", c) for c in "ksvw"}
    by = {r[1]: r for r in rows}
    assert [tuple(x) for x in by["k"][14]] == [(str(i), 225, 0.25) for i in range(4)]
    assert np.isclose(by["v"][19][8], np.quantile([i * 3 % 700 / 4 for i in range(900)], 0.5), atol=1e-4)
    shown = shapes(df, "t", ["s"], with_example=True)
    assert {tuple(r) for r in shapes(df, "t", ["s"], True, {"s": kept["t", "s"]}).select(shown.columns).collect()} == {tuple(r) for r in shown.collect()}
    assert {tuple(r) for r in value_counts(df, "t", ["k", "s"], {c: kept["t", c] for c in "ks"}).collect()} == {tuple(r) for r in value_counts(df, "t", ["k", "s"]).collect()}
    parent = spark.range(3).selectExpr("id AS p")
    links = Constraints(foreign_keys=(("t", ("k",), "u", ("p",)),))
    for stored in (None, kept):
        assert fk_orphans({"t": df, "u": parent}, links, stored).select("checked", "orphans").first() == (900, 225)


def test_key_rules_read_counted_values(spark):
    """Rules whose key is a column that a profile has counted read those counts: same results, and the table's rows are not grouped again."""
    shop = Model({"order": Entity("order", "o", ("id",)), "node": Entity("node", "g", ("node",))},
                 {"geo": Hierarchy("geo", "node", "up", "level", ("TOP", "LOW"), ())})
    tables = {"o": spark.range(400).selectExpr("id % 390 AS id", "CASE WHEN id % 9 > 0 THEN id % 37 END AS at", "concat('no ', id % 300) AS n"),
              "g": spark.range(30).selectExpr("NULLIF(id % 25, 24) AS node", "CASE WHEN id > 4 THEN id % 5 END AS up", "IF(id % 25 < 5, 'TOP', 'LOW') AS level")}
    kept = {}
    profile_tables(tables, AS_OF, kept=kept)
    keys = [Rule("u", "order", {"type": "unique"}, ("n",)), Rule("f", "order", {"type": "foreign_key", "ref_entity": "node", "ref_columns": ["node"]}, ("at",)),
            Rule("a", "order", {"type": "hierarchy_attach_level", "hierarchy": "geo", "level": "LOW"}, ("at",))]
    counted = execute_rules(tables, keys, shop, AS_OF, {k: v for k, v in kept.items() if k[0] == "o"})
    physical = plan(counted)[1]
    assert "Range (0, 400" not in physical and physical.count("FileScan parquet") == 3
    others = [Rule("p", "order", {"type": "unique"}, ("n",), filter="at > 3"), Rule("c", "order", {"type": "unique"}, ("id", "n")),
              Rule("x", "order", {"type": "unique"}, ("gone",)), Rule("l", "node", {"type": "hierarchy_parent_level", "hierarchy": "geo"})]
    want = {r["rule_id"]: tuple(r) for r in execute_rules(tables, keys + others, shop, AS_OF).collect()}
    assert {r["rule_id"]: tuple(r) for r in execute_rules(tables, keys + others, shop, AS_OF, kept).collect()} == want
    assert want["u"][5:7] == (400, 200) and want["f"][5:7][0] == 400 and want["f"][6] > 0 and want["a"][6] > 0 and want["x"][-1]


def test_formats_are_tried_where_they_can_match(spark):
    """The cheap test before a regex lets every match through."""
    day, uuid = "2024-02-03", "123e4567-e89b-12d3-a456-426614174000"
    values = [None, "", " ", "a@b.co", "a@b", "@", "é@ü.com", uuid, uuid.upper() + "\n", uuid + "\r\n", uuid + "x", "http://a", "https://é", "http", "Http://a", day, day + "\n",
              day + "T10:00", day + " 10:00:59Z", "+91 (0)40-1234567", "91234567", "0123456789", "-1.5", "1.", ".5", "+", "-", "-12", "12\n", "٣٤", "A-1", "AB_9-Z", "a-1", "\U0001d7d8"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for name, regex in vocab.FORMATS:
        rows = df.selectExpr("v", f"v RLIKE {q(regex)} AS plain", f"{profiling._has_format('v', name, regex)} AS quick").collect()
        assert [r["quick"] for r in rows] == [r["plain"] for r in rows] and any(r["plain"] for r in rows), name


def test_shapes_are_computed_once(spark, monkeypatch):
    """A profile reads the shapes of a table's texts four times; they are stored, not found again each time."""
    labels = []
    monkeypatch.setattr(profile, "written", lambda df, label, real=profile.written: (labels.append(label), real(df, label))[1])
    rows = profile_table(spark.range(90).selectExpr("concat('A-', id % 60) AS s", "concat('x', id, 'é') AS t"), "t", AS_OF)
    assert labels == ["shapes"]
    assert [tuple(x) for x in rows[0][15]] == [("A-99", 70, 0.777778), ("A-9", 20, 0.222222)] and rows[0][17] == ["A-10", "A-0"]
