import datetime as dt
import json

import pytest

from plumbline import Entity, Hierarchy, Model, Rule
from plumbline.functions.expressions import ExpressionError, check_expression, portable
from plumbline.operators import validate
from plumbline.plans.suite import execute_rules, violation_examples, violations

AS_OF = dt.date(2026, 1, 1)
MODEL = Model({"node": Entity("node", "node", ("id",), pii=("code",))},
              {"h": Hierarchy("h", "node", "parent", "lv", ("HEAD", "UNIT"))})


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(1, None, "HEAD", "QX", 10.0), (2, 1, "UNIT", "pq", None), (3, 4, "UNIT", "VW", -1.0), (4, 3, "UNIT", None, 5.0)]
    return {"node": spark.createDataFrame(rows, "id int, parent int, lv string, code string, amount double")}


def rule(rid, check, *columns, **more):
    return Rule(rid, "node", check, columns, **more)


RULES = [
    rule("range", {"type": "range", "min": 0}, "amount"), rule("not_null", {"type": "not_null"}, "amount"),
    rule("null_rate", {"type": "null_rate_max", "max_rate": 0.5}, "code"), rule("pattern", {"type": "pattern", "regex": "^[A-Z]{2}$"}, "code"),
    rule("acyclic", {"type": "hierarchy_acyclic", "hierarchy": "h"}), rule("level", {"type": "hierarchy_parent_level", "hierarchy": "h"}),
    rule("division", {"type": "row_condition", "expression": "10 / (amount - 5) > 0"}, "amount"),
    rule("cast", {"type": "row_condition", "expression": "cast(code AS int) > 0"}, "code"),
    rule("no_column", {"type": "not_null"}, "ghost"), Rule("no_entity", "ghost", {"type": "not_null"}, ("id",)),
    rule("bad_regex", {"type": "pattern", "regex": "["}, "code"), rule("bad_sql", {"type": "custom_sql", "sql": "DROP TABLE node"}),
    rule("two_statements", {"type": "custom_sql", "sql": "SELECT 1; SELECT 2"}), rule("subquery", {"type": "row_condition", "expression": "id IN (SELECT 1)"}, "id"),
    rule("bad_ref", {"type": "foreign_key", "ref_entity": "ghost", "ref_columns": ["id"]}, "parent"),
    rule("sql", {"type": "custom_sql", "sql": "SELECT id, code FROM node WHERE amount < 0"}),
]


def test_results(tables):
    got = {r.rule_id: r for r in execute_rules(tables, RULES, MODEL, AS_OF).collect()}
    assert len(got) == len(RULES)
    counts = {k: (r.total, r.failed, r.passed) for k, r in got.items() if r.error is None}
    assert counts == {"range": (4, 1, False), "not_null": (4, 1, False), "null_rate": (4, 1, True), "pattern": (4, 1, False),
                      "acyclic": (4, 2, False), "level": (4, 2, False), "division": (4, 1, False), "cast": (4, 0, True), "sql": (4, 1, False)}
    broken = {k for k, r in got.items() if r.error is not None}
    assert broken == {"no_column", "no_entity", "bad_regex", "bad_sql", "two_statements", "subquery", "bad_ref"}
    assert not any(got[k].passed for k in broken)


def test_violations_match_results(tables):
    results = {r.rule_id: r.failed for r in execute_rules(tables, RULES, MODEL, AS_OF).collect() if r.check_type != "custom_sql" and not r.error}
    listed = {}
    for r in violations(tables, RULES, MODEL, AS_OF).collect():
        listed.setdefault(r.rule_id, []).append(r.key)
    assert {k: len(v) for k, v in listed.items()} == {k: n for k, n in results.items() if n}
    assert sorted(listed["acyclic"]) == ["3", "4"] and listed["pattern"] == ["2"]


def test_results_do_not_depend_on_partitions(tables):
    spread = {"node": tables["node"].repartition(7)}
    order = lambda df: sorted(df.collect(), key=lambda r: r.rule_id)
    assert order(execute_rules(tables, RULES, MODEL, AS_OF)) == order(execute_rules(spread, RULES, MODEL, AS_OF))


def test_examples_are_masked(tables):
    shown = {r.rule_id: r.shown for r in violation_examples(tables, RULES, MODEL, AS_OF).collect()}
    assert shown["pattern"] == {"id": "2", "code": "**"} and shown["sql"] == {"id": "3", "code": "**"}


@pytest.mark.parametrize("text", ["DROP TABLE t", "a IN (SELECT 1)", "a = 1; DROP TABLE t", "o.status = 'x'", "SUM(a) > 1", "ghost = 1", "java_method('x', 'y') = 1"])
def test_unsafe_expressions(spark, text):
    with pytest.raises(ExpressionError):
        check_expression(spark, text, {"a", "status"})


def test_expressions(spark):
    check_expression(spark, "A >= DATE_ADD(b, 18, 'YEAR') AND coalesce(a, 1) IN (1, 2)", {"a", "b"})
    check_expression(spark, "SUM(a)", {"a"}, aggregate=True)
    assert portable("DATE_ADD(b, 18, 'YEAR')") == "add_months(b, 12 * (18))"
    leap = spark.sql(f"SELECT CAST({portable('''DATE_ADD(DATE '2000-02-29', 18, 'YEAR')''')} AS STRING)").first()[0]
    assert leap == "2018-02-28"


def test_shape_of_candidates(spark):
    base = {"name": "n", "category": "data_quality", "dimension": "validity", "scope": "column", "target": {"entity": "node", "columns": ["id"]}}
    cases = [({"type": "not_null"}, {}, ""), ({"type": "range", "min": 2, "max": 1}, {}, "range min > max"), ({"type": "range"}, {}, "range needs min and/or max"),
             ({"type": "hierarchy_acyclic", "hierarchy": "h"}, {"scope": "table"}, "hierarchy checks must have category 'hierarchy'"),
             ({"type": "foreign_key", "ref_entity": "node", "ref_columns": ["a", "b"]}, {"scope": "cross_table"}, "foreign_key: ref_columns must pair 1:1 with target columns"),
             ({"type": "not_null"}, {"target": {"entity": "node", "columns": ["id", "lv"]}}, "check 'not_null' needs exactly 1 target column(s), got 2")]
    df = spark.createDataFrame([(i, json.dumps(base | {"check": c} | more)) for i, (c, more, _) in enumerate(cases)], "seq int, rule string")
    got = {r.seq: "; ".join(r.errors) for r in validate.shape_errors(validate.parsed(df)).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_rule_round_trip():
    r = rule("x", {"type": "range", "min": 0}, "amount", filter="id > 1", tolerance=0.1)
    assert Rule.from_json("x", r.to_json()) == r
