import pytest

import __spark_entry__ as contract
from chatprep.llm import oracle, queries
from checks import compare

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = {q.__name__ for q in queries.QUERIES}
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert names | {"pipeline"} <= set(contract.queries()) and set(oracle.SQL) <= names


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_agrees_with_its_sql(spark, name):
    df = contract.queries()[name](spark, SMALL)
    cursor = compare.connect(SMALL).execute(oracle.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(q.__name__ for q in queries.QUERIES if q.__name__ not in oracle.SQL))
def test_other_queries_give_a_row_per_document(spark, name):
    rows = contract.queries()[name](spark, SMALL).collect()
    want = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == want
    assert len(rows) >= len(want)
