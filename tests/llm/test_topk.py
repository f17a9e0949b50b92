import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatprep.llm import topk as T

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, asks, k, scale=64):
    whole = {i: [math.floor(scale * x) if abs(x) < 1e300 else int(scale) * int(x) for x in v] for i, v in rows}
    out = set()
    for q in whole:
        if asks(q):
            others = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(others[:k], 1)}
    return out


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_against_brute_force(spark, tile_rows):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 64]) for i in range(300)]  # many ties
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA).repartition(5)
    got = T.top_k(df, F.col("vec_id") % 20 == 0, 20, tile_rows=tile_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda q: q % 20 == 0, 20)


def test_many_merges(spark, monkeypatch):
    monkeypatch.setattr(T, "FAN_IN", 2)
    rows = [(i, [float((i * 7919) % 101), 1.0]) for i in range(64)]
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    got = T.top_k(df, F.col("vec_id") < 5, 3, tile_rows=4)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda q: q < 5, 3)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0]),
        (5, [1.0]), (6, []), (7, [-0.001, 0.0]), (8, [3.0, 1.0]), (8, [3.0, 1.0]), (8, [4.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = {tuple(r) for r in T.top_k(df, F.col("vec_id").isin(0, 1, 6), 20).collect()}
    kept = [(0, [1.0, 2.0]), (5, [1.0, 0.0]), (6, [0.0, 0.0]), (7, [-0.001, 0.0]), (8, [3.0, 1.0])]
    assert got == brute(kept, lambda q: q in (0, 6), 20)


def test_large_components_are_exact(spark):
    """Products beyond what doubles hold exactly, and beyond a long."""
    big = 2.0**24
    rows = [(0, [big + 1 / 64, 1.0]), (1, [big, 3.0]), (2, [big + 1 / 64, -1.0]), (3, [1.0, 1.0]), (4, [-big, 0.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert {tuple(r) for r in T.top_k(df, F.col("vec_id") == 0, 20).collect()} == brute(rows, lambda q: q == 0, 20)
    huge = spark.createDataFrame([(0, [1e300], ""), (2, [1e300], ""), (1, [1e299], ""), (3, [-1e300], "")], SCHEMA)
    got = [(r["vec_id"], r["score"]) for r in T.top_k(huge, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (3, 1 - 2**63)]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.top_k(none, F.col("vec_id") % 20 == 0, 20).collect() == []
    one = spark.createDataFrame([(0, [1.0], "")], SCHEMA)
    assert T.top_k(one, F.col("vec_id") % 20 == 0, 20).collect() == []
