import duckdb
import pytest

import __spark_entry__ as contract
from checks import compare, oracle, queries

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    named = {q.__name__ for q in queries.QUERIES}
    assert named == set(oracle.SQL) and named <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["conv_id", "turn", "n_tokens", "ids"] and df.count() > 0


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(q.__name__ for q in queries.QUERIES))
def test_query_agrees_with_its_sql(spark, con: duckdb.DuckDBPyConnection, name):
    assert compare.difference(spark, con, name, SMALL) is None
