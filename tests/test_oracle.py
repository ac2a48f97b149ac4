"""Every registered query against its SQL, whole tables of the smallest scale."""
import pytest

import __spark_entry__ as entry_point
from tests.compare import difference

QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_same_as_sql(spark, con, sf_dir, key):
    assert difference(spark, con, QUERIES[key], ORACLE[key], sf_dir) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql_has_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    out = entry_point.entry(spark)
    assert out.count() > 20 and "passed" in out.columns
