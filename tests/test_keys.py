"""Every key with SQL gives the same columns, types and rows as the SQL; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
HEAVY = {"select_and_evaluate", "compare_models", "param_search", "null_importance", "forward_select", "l1_select"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - HEAVY))
def test_key(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert [d for d in compare(df, con, sql) if d != "both sides are empty"] == []


def test_entry(spark):
    df = entry.entry(spark)
    # Two columns and COUNT(orders), then five functions of 17 inputs: the price, the line count, 5 x 3 line features.
    assert df.count() == 150 and len(df.columns) == 3 + 5 * 17


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
