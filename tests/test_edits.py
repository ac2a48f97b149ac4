"""Edits of rules: what they change, what is refused, what was there before."""
import json

import pytest

from plumbline.operators import ledger

CHECK = json.dumps({"type": "range", "min": 0, "max": 9})


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([("a", "first", "item", ["size"], CHECK, None, "low", 0.1), ("b", "second", "item", ["size"], CHECK, None, "low", 0.1)],
                                 "rule_id string, name string, entity string, columns array<string>, check string, filter string, severity string, tolerance double")


def edits(spark, *rows):
    return spark.createDataFrame(rows, "rule_id string, seq int, path string, value string")


def test_history_carries_the_state(spark, rules):
    made = edits(spark, ("a", 1, "name", "one"), ("a", 2, "name", "two"), ("a", 2, "origin", "llm"), ("a", 3, "name", None), ("a", 4, "name", "four"),
                 ("a", 5, "check.max", "12"), ("a", 200_001, "check.max", "15"), ("a", 200_001, "tolerance", "much"), ("a", 200_002, "check.max", "20"),
                 ("b", 1, "target.columns", '["weight"]'), ("ghost", 1, "name", "x"))
    got = {(r.rule_id, r.seq, r.path): (r.before, r.after, r.accepted, r.problem) for r in ledger.edit_history(rules, made).collect()}
    assert got[("a", 1, "name")] == ("first", "one", True, None)
    assert got[("a", 2, "name")] == ("one", "two", False, None) and got[("a", 2, "origin")][3] == "'origin' cannot be edited"
    assert got[("a", 3, "name")] == ("one", None, True, None) and got[("a", 4, "name")] == (None, "four", True, None)
    assert got[("a", 200_001, "check.max")] == ("12", "15", False, None) and got[("a", 200_001, "tolerance")] == ("0.1", "much", False, "tolerance: not a number")
    assert got[("a", 200_002, "check.max")] == ("12", "20", True, None)
    assert got[("b", 1, "target.columns")] == ('["size"]', '["weight"]', True, None)
    assert got[("ghost", 1, "name")] == (None, "x", False, "unknown rule") and len(got) == made.count()


@pytest.mark.parametrize("path,value,problem", [("tolerance", "much", "tolerance: not a number"), ("tolerance", "3", "tolerance: not between 0 and 1"),
                                                ("check.max", "-1", "range min > max"), ("check.color", "red", "check: unknown color"),
                                                ("target.columns", "size", "target.columns: not a list of names"), ("target.columns", '["height"]', "target: unknown column(s) height in 'item'"),
                                                ("filter", "height > 1", "filter: unknown column(s): height"), ("name", "fine", None)])
def test_edited_rules_are_validated(spark, rules, path, value, problem):
    columns = spark.createDataFrame([("item", "size"), ("item", "weight")], "entity string, column string")
    trees = spark.createDataFrame([], "hierarchy_id string, entity string, levels array<string>")
    out = ledger.revalidated(ledger.apply_edits(rules, edits(spark, ("a", 1, path, value))), columns, trees).collect()
    assert [r.errors for r in out] == [[problem] if problem else []]
    assert (out[0].tolerance, out[0].columns) == (3.0 if value == "3" else 0.1, ["height"] if "height" in value and path == "target.columns" else ["size"])
