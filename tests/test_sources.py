import json
import tempfile
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline import Constraints
from plumbline.sources import inventory as inv, store


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_rule_documents(spark):
    r = {"name": "a", "check": {"type": "not_null"}}
    for doc in ([r, r], {"rules": [r, r]}, {"rules": [{"covers": ["x"], "rule": r}, {"rule": r}]}):
        path = f"{folder()}/rules.json"
        with open(path, "w") as f:
            json.dump(doc, f, indent=1)
        got = store.read_rules(spark, path).orderBy("seq").collect()
        assert [json.loads(x.rule) for x in got] == [r, r]


def test_rules_that_were_written_read_back(spark):
    path = f"{folder()}/rules"
    rules = [{"name": f"r{k}", "check": {"type": "range", "min": k}} for k in range(7)]
    store.write_rules(spark.createDataFrame([(json.dumps(r, indent=2 if k == 3 else None),) for k, r in enumerate(rules)], "rule string").repartition(3), path)
    store.write_rules(spark.createDataFrame([(json.dumps(rules[0]),)], "rule string"), path)
    got = store.read_rules(spark, path).orderBy("seq").collect()
    assert [x.seq for x in got] == list(range(8))
    assert sorted(json.loads(x.rule)["name"] for x in got) == sorted([r["name"] for r in rules] + ["r0"])


def test_one_rule_and_empty_documents(spark):
    path = folder()
    for name, text in (("a.json", json.dumps({"name": "a", "check": {"type": "unique"}}, indent=1)), ("b.json", ""), ("c.json", "[]"), ("d.json", "no rules")):
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    assert [(x.seq, json.loads(x.rule)["name"]) for x in store.read_rules(spark, path).collect()] == [(0, "a")]


def test_versions_are_kept_only_when_something_changed(spark):
    path = f"{folder()}/model"
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "y"), (1, "z")], "k int, v string")
    assert store.save_if_changed(a, path, "s") == (1, True)
    assert store.save_if_changed(a.orderBy(F.desc("k")), path, "s") == (1, False)
    assert store.save_if_changed(b, path, "s") == (2, True)
    assert store.save_if_changed(a, path, "other") == (1, True)


def test_two_writers_never_share_a_version(spark, monkeypatch):
    path = f"{folder()}/model"
    tables = [spark.createDataFrame([(k, "x")], "k int, v string") for k in range(3)]
    create, meets = store._create, [(1, True)]

    def other_first(*args):
        if meets:
            expected = meets.pop()
            assert store.save_if_changed(tables[1], path, "a/b") == expected
        return create(*args)

    monkeypatch.setattr(store, "_create", other_first)
    assert store.save_if_changed(tables[0], path, "a/b") == (2, True)
    assert store.save_if_changed(tables[2], path, "c") == (1, True)
    assert store.read_model(spark, path, "a/b", 1).first().k == 1 and store.read_model(spark, path, "a/b").first().k == 0
    assert store.read_model(spark, path, "nobody") is None
    meets.append((3, True))
    other = spark.createDataFrame([(1, "x")], "k int, v string")
    assert store.save_if_changed(other, path, "a/b") == (3, False), "the other writer stored the same rows"


def test_writers_at_once(spark):
    path = f"{folder()}/model"
    tables = [spark.createDataFrame([(k, "x")], "k int, v string") for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda t: store.save_if_changed(t, path, "s"), tables))
    assert sorted(got) == [(k, True) for k in range(1, 7)]
    for table, (version, _) in zip(tables, got):
        assert store.read_model(spark, path, "s", version).collect() == table.collect()


def test_files_without_a_manifest_are_no_version(spark):
    path = f"{folder()}/model"
    store.save_if_changed(spark.range(3), path, "s")
    spark.range(9).write.parquet(f"{path}/files/left-by-a-writer-that-died")
    assert store.read_model(spark, path, "s").count() == 3 and store.versions(spark, path).count() == 1


def test_rename_that_may_not_replace(spark):
    at = folder()
    for name in ("a", "b"):
        with open(f"{at}/{name}", "w") as f:
            f.write(name)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store._rename_new(spark, hadoop(f"{at}/a"), hadoop(f"{at}/c"))
    with pytest.raises(FileExistsError):
        store._rename_new(spark, hadoop(f"{at}/b"), hadoop(f"{at}/c"))
    with open(f"{at}/c") as f:
        assert f.read() == "a"


def test_snapshot(spark):
    path = f"{folder()}/snap"
    for day in ("2026-01-01", "2026-01-03", "2026-01-02"):
        store.save_snapshot(spark.range(1).withColumn("profiled_at", F.lit(day)).withColumn("snapshot_id", F.lit(day)), path, "s", F.lit(day), "h")
    assert store.latest_snapshot(spark.read.parquet(path)).first().created_at == "2026-01-03"


def test_inventory_and_structure(spark):
    known = Constraints({"dept": ("id",)}, (("dept", ("parent",), "dept", ("id",)),), (("dept", ("code",)),))
    one = {"dept": spark.createDataFrame([(1, "a", None, Decimal("1.5"))], "id int, code string, parent int, pay decimal(10,2)")}
    two = {"dept": spark.createDataFrame([(2, "b", 1, Decimal("2.5")), (3, "c", 1, Decimal("2.5"))], "id int, code string, parent int, pay decimal(10,2)")}
    rows = {r.column: r for r in inv.schema_inventory(one, known).collect()}
    assert not rows["id"].nullable and rows["parent"].self_reference and rows["code"].is_unique
    assert (rows["pay"].generic_type, rows["pay"].precision, rows["pay"].scale, rows["id"].row_count) == ("decimal", 10, 2, 1)
    digest = lambda t: inv.structure_hash(inv.schema_inventory(t, known, False), inv.foreign_keys(spark, known)).first()[0]
    assert digest(one) == digest(two) != digest({"dept": one["dept"].drop("pay")})


def test_source_id():
    assert inv.source_id("parquet", "/Data/X") == inv.source_id("parquet", "/data/x") != inv.source_id("orc", "/data/x") and len(inv.source_id("a", "b")) == 16


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = {r.id for r in inv.hash_sample(df, ["id"], 100).collect()}
    assert len(a) == 100 and a == {r.id for r in inv.hash_sample(df.repartition(5), ["id"], 100).collect()}
    assert inv.hash_sample(df, ["id"], 1000).first().sample_method == "full"


def test_unreadable_source(spark):
    with pytest.raises(ConnectionError, match="ghost"):
        inv.open_tables(spark, {"ghost": "/nowhere/ghost"})
