import hashlib
import math

import pytest
from pyspark.sql import functions as F

from chatprep.operators import batching as B
from chatprep.operators import ranks as R
from tests import model


def h(seed, *keys):
    return hashlib.md5(":".join(map(str, [seed, *keys])).encode()).hexdigest()


@pytest.mark.parametrize(("n", "ratio", "val"), [(1, 0.5, 0), (2, 0.01, 1), (100, 0.29, 28), (100, 0.0, 0), (0, 0.5, 0), (10, 1.0, 10)])
def test_split_sizes(spark, n, ratio, val):
    got = B.train_val_split(spark.range(n), ["id"], ratio).collect()
    want = set(sorted(range(n), key=lambda i: h(42, i))[:val])
    assert {r["id"] for r in got if r["split"] == "val"} == want and len(got) == n


@pytest.mark.parametrize("few", [1, 100_000])
def test_split_finds_the_cut_below_the_first_digits(spark, monkeypatch, few):
    """Enough rows that buckets of the leading digits hold several."""
    monkeypatch.setattr(R, "_FEW", few)
    n = 300_000
    got = B.train_val_split(spark.range(n), ["id"], 0.37).filter("split = 'val'")
    assert got.count() == int(n * 0.37)
    cut = got.agg(F.max(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))))).first()[0]
    assert cut == sorted(h(42, i) for i in range(n))[int(n * 0.37) - 1]


@pytest.mark.parametrize("n", [5, 16, 32, 33])
@pytest.mark.parametrize("drop", [True, False])
def test_batches(spark, n, drop):
    got = B.assign_batches(spark.range(n).repartition(3), ["id"], epoch=2, drop_last=drop).collect()
    order = sorted(range(n), key=lambda i: h("42:2", i))
    keep = order[: n // 16 * 16] if drop else order
    assert {r["id"]: (r["batch_id"], r["row_in_batch"]) for r in got} == {k: divmod(i, 16) for i, k in enumerate(keep)}
    assert all(r["epoch"] == 2 for r in got)


def test_batch_caps():
    assert [B.batch_rows_for(m, 16) for m in ("small", "xlarge", "max")] == [16, 8, 4]


def test_padding_and_matrices(spark):
    rows = [(1, 0, 0, [1], [2]), (1, 0, 1, [1, 2, 3], [2, 3, 4]), (1, 1, 0, [5, 6], [6, 7])]
    batches = spark.createDataFrame(rows, "epoch int, batch_id long, row_in_batch int, x array<int>, y array<int>")
    padded = {(r["batch_id"], r["row_in_batch"]): (r["x"], r["y"]) for r in B.pad_batches(batches).collect()}
    assert padded == {(0, 0): ([1, 0, 0], [2, 0, 0]), (0, 1): ([1, 2, 3], [2, 3, 4]), (1, 0): ([5, 6], [6, 7])}
    matrices = {r["batch_id"]: r["x"] for r in B.batch_matrices(B.pad_batches(batches)).collect()}
    assert matrices == {0: [[1, 0, 0], [1, 2, 3]], 1: [[5, 6]]}


@pytest.mark.parametrize("accum", [1, 3, 4, 50])
def test_plan_against_a_loop(spark, accum):
    n, epochs = 16 * 10 + 5, 3
    got = B.batch_plan(spark.range(n), epochs, accum=accum).orderBy("epoch", "batch").collect()
    step, want = 0, []
    for epoch in range(1, epochs + 1):
        for batch in range(10):
            stepped = (batch + 1) % accum == 0 or batch + 1 == 10
            step += stepped
            want.append((epoch, batch, stepped, step))
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize(("total", "warmup"), [(30, 0), (30, 5), (1, 0), (30, 30)])
def test_learning_rate(spark, total, warmup):
    steps = spark.range(total + 5).withColumnRenamed("id", "global_step")
    for r in B.lr_schedule(steps, total, warmup).collect():
        assert math.isclose(r["lr"], model.learning_rate(r["global_step"], 3e-4, warmup, total), abs_tol=1e-15)


def test_plan_sizes():
    assert B.plan_sizes(100, 16, 3, 0.05) == (6, 18, 0)
    assert B.plan_sizes(3, 16, 3, 0.05) == (0, 1, 0)
    assert B.plan_sizes(1600, 16, 10, 0.05) == (100, 1000, 50)


def test_ranks_and_offsets(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") % 7).alias("size")).repartition(5)
    order = sorted(f"k{i}" for i in range(1000))
    assert {r["k"]: r["rank"] for r in R.ordered_rank(df, ["k"]).collect()} == {k: i for i, k in enumerate(order)}
    offsets, at = {}, 0
    for k in order:
        offsets[k], at = at, at + int(k[1:]) % 7
    assert {r["k"]: r["offset"] for r in R.ordered_offset(df, ["k"], "size").collect()} == offsets
    shuffled = {r["k"]: (r["rank"], r["total"]) for r in R.shuffled_rank(df, ["k"], 1).collect()}
    assert shuffled == {k: (i + 1, 1000) for i, k in enumerate(sorted(order, key=lambda k: h(1, k)))}


def test_grouped_offsets_with_a_hot_group(spark):
    """One group holds nearly all rows and spans every part of the range cut."""
    df = spark.range(2000).select(F.when(F.col("id") < 1900, 1).otherwise(F.col("id")).alias("g"), "id", F.lit(1).alias("v")).repartition(6)
    got = R.grouped_offset(df, ["g"], ["id"], "v", "before").collect()
    for r in got:
        assert r["before"] == (r["id"] if r["id"] < 1900 else 0)
    assert len(got) == 2000


@pytest.mark.parametrize("drop", [True, False])
def test_padded_batches_move_ids_once(spark, drop):
    from chatprep.operators import samples as S

    rows = [(i, "k", list(range(1, 2 + i * 7 % 13 + 1))) for i in range(53)]
    df = spark.createDataFrame(rows, "id long, more string, ids array<int>").repartition(3)
    want = B.pad_batches(B.assign_batches(S.shift_targets(df), ["id"], 2, 8, drop_last=drop))
    got = B.padded_batches(df, ["id"], 2, 8, drop_last=drop)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("size(ids") >= 1 and "x#" in text


def test_padding_plan_carries_no_ids_to_ranks(spark, tmp_path):
    """Only the join that brings ids to their place moves them."""
    path = str(tmp_path / "samples")
    spark.range(100).selectExpr("id", "sequence(1, 5) AS ids").write.parquet(path)
    plan = B.padded_batches(spark.read.parquet(path), ["id"])._jdf.queryExecution().executedPlan().toString()
    moved = [part.split("\n", 2)[1] for part in plan.split("Exchange hashpartitioning")[1:]]
    assert sum("ids#" in line and "size(ids" not in line for line in moved) <= 1
