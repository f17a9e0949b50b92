import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatprep.operators import embeddings as E
from chatprep.operators import runs as R
from chatprep.operators import vocab as V
from tests import model


@pytest.fixture
def codec(spark):
    return V.Codec.of(V.build_vocab(spark.createDataFrame([("ab~c",)], "text string")))


def test_generations(spark, codec):
    """a=4 b=5 c=6 ~=7."""
    tokens = {
        1: [4, 5, 6],
        2: [2, 4],
        3: [4, 2, 5, 2],
        4: [1, 4, 0, 3, 5, 2],
        5: [4, 99, 7, 5],
        6: [4] * 600,
        7: [0, 1],
    }
    df = spark.createDataFrame([(g, i, t) for g, ids in tokens.items() for i, t in enumerate(ids)], "gen_id long, step int, token_id int").repartition(4)
    unknown = chr(0x0F0B)
    whole = {1: "abc", 2: "", 3: "a", 4: "ab", 5: f"a{unknown}\\~b", 6: "a" * 600, 7: ""}
    assert {r["gen_id"]: r["text"] for r in R.assemble_generation(df, codec).collect()} == whole
    pieces = R.assemble_generation(df, codec, piece_steps=256).filter("gen_id = 6").orderBy("piece").collect()
    assert [r["text"] for r in pieces] == ["a" * 256, "a" * 256, "a" * 88]
    running = R.running_generation(df.filter("gen_id IN (2, 4, 5, 7)"), codec).orderBy("gen_id", "pos").collect()
    assert [r["text"] for r in running] == ["a", "ab", "a", f"a{unknown}", f"a{unknown}\\~", f"a{unknown}\\~b"]
    long = R.running_generation(df.filter("gen_id = 6"), codec).orderBy("pos").collect()
    assert [r["text"] for r in long] == ["a" * n for n in range(1, 601)]


def test_a_generation_across_stretches(spark, codec, monkeypatch):
    """Keys of two columns; the end id lies in another stretch than what it cuts off."""
    monkeypatch.setattr(R, "_STRETCH", 3)
    ids = [4, 5, 6, 4, 5, 2, 6, 6, 2, 4]
    rows = [(c, t, i, x) for c in (1, 2) for t in (0, 4) for i, x in enumerate(ids if t else ids[6:])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, step int, token_id int").repartition(5)
    got = {tuple(r) for r in R.assemble_generation(df, codec, ["conv_id", "turn"]).collect()}
    assert got == {(1, 0, "cc"), (1, 4, "abcab"), (2, 0, "cc"), (2, 4, "abcab")}


def test_throughput(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, start), (1, start + timedelta(seconds=2)), (1, start + timedelta(seconds=4)), (2, start)]
    got = {r["gen_id"]: tuple(r)[1:] for r in R.throughput(spark.createDataFrame(rows, "gen_id long, ts timestamp")).collect()}
    assert got == {1: (3, 4.0, 0.75), 2: (1, 0.0, 0.0)}


def test_epoch_rollup(spark):
    rows = [
        (1, 1, 1, "train", 2.0, 0.1, 1.0, 10), (1, 1, 2, "train", 4.0, 0.2, 1.0, 30), (1, 1, 3, "val", 9.0, None, 2.0, 5),
        (1, 2, 4, "val", 1.0, 0.3, 0.0, 5), (2, 1, 1, "train", 1.0, 0.1, 0.0, 10),
    ]
    df = spark.createDataFrame(rows, "run_id long, epoch long, step long, split string, loss double, lr double, seconds double, n_tokens long")
    got = {(r["run_id"], r["epoch"]): r for r in R.epoch_rollup(df).collect()}
    first = got[1, 1]
    assert (first["train_loss"], first["val_loss"], first["lr"], first["seconds"], first["n_steps"]) == (3.0, 9.0, 0.2, 4.0, 2)
    assert first["nominal_tokens_per_sec"] == 2 * 16 * 128 / 4 and first["real_tokens_per_sec"] == 10.0
    assert got[1, 2]["lr"] is None
    assert math.isnan(got[1, 2]["train_loss"]) and got[1, 2]["val_loss"] == 1.0
    assert got[2, 1]["val_loss"] == 0.0 and got[2, 1]["nominal_tokens_per_sec"] == 2048 / 1e-6


CASES = {
    1: [1 - 0.1 * i for i in range(9)],
    2: [1.0, 0.995, 0.99, 0.985],
    3: [1 - 0.001 * i for i in range(10)],
    4: [1 - 0.003 * i for i in range(10)],
    5: [1.0],
    6: [1, 2, 3, 0.1, 2, 3, 4, 0.01],
    7: [0.5, 0.5, 0.4, 0.5, 0.5, 0.3],
}


@pytest.mark.parametrize("patience", [1, 3])
@pytest.mark.parametrize("scale", [1, 5000])
def test_early_stop_against_a_loop(spark, patience, scale):
    rng = random.Random(1)
    cases = CASES | {100 + i: [rng.uniform(0, 1) for _ in range(rng.randint(1, 12))] for i in range(60)}
    rows = [(run, e * scale, float(x)) for run, losses in cases.items() for e, x in enumerate(losses)] + [(1, 50, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id long, epoch long, val_loss double")
    got = {r["run_id"]: tuple(r)[1:] for r in R.early_stop(df, patience, 0.005).collect()}
    want = {run: model.early_stop([float(x) for x in losses], patience, 0.005) for run, losses in cases.items()}
    assert got == {run: (stop and stop * scale, *rest) for run, (stop, *rest) in want.items()}


def test_best_epoch(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.3), (2, 1, None), (2, 2, 7.0)], "run_id long, epoch long, val_loss double")
    assert {tuple(r) for r in R.best_epoch(df).collect()} == {(1, 2, 0.3), (2, 2, 7.0)}


def test_pooling(spark):
    pieces = spark.createDataFrame([(4, 0, 10), (5, 0, 10), (5, 1, 11), (5, 2, 11), (0, 0, 10), (3, 0, 11)], "id int, piece_pos int, source_id long")
    source = spark.createDataFrame([(10, [1.0, 2.0]), (11, [4.0, 8.0])], "source_id long, vec array<float>")
    vocab = spark.createDataFrame([(i,) for i in range(7)], "id int")
    got = {r["id"]: r["vec"] for r in E.pool_embeddings(pieces, source, vocab, 2).collect()}
    assert got == {**{i: [0.0, 0.0] for i in (0, 1, 2, 3, 6)}, 4: [1.0, 2.0], 5: [3.0, 6.0]}


@pytest.mark.parametrize(("n", "d", "k"), [(50, 6, 3), (50, 6, 6), (4, 6, 6), (50, 6, 99)])
def test_svd_against_numpy(spark, n, d, k):
    a = np.random.default_rng(0).normal(3, 1, (n, d))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(a)], "id int, vec array<double>").repartition(3)
    got = {r["id"]: r["vec"] for r in E.svd_project(df, "id", "vec", k).collect()}
    found = np.array([got[i] for i in range(n)])
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    keep = min(k, n, d)
    assert found.shape == (n, keep)
    assert np.allclose(np.abs(found), np.abs(u[:, :keep] * s[:keep]), atol=1e-8)


def test_svd_of_a_rank_deficient_matrix_and_padding(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "id int, vec array<float>")
    projected = E.pad_dims(E.svd_project(df, "id", "vec", 2), 4)
    for r in projected.collect():
        assert len(r["vec"]) == 4 and math.isclose(abs(r["vec"][0]), r["id"] * 5**0.5, abs_tol=1e-6)
        assert abs(r["vec"][1]) < 1e-6 and r["vec"][2:] == [0.0, 0.0]
    E.assert_embedding_shape(projected, 5, 4)
    with pytest.raises(ValueError, match="expected 5 x 3"):
        E.assert_embedding_shape(projected, 5, 3)
    assert E.pad_dims(projected, 2).agg(F.max(F.size("vec"))).first()[0] == 4


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0]), (2, None)]])
def test_ragged_rows_are_refused(spark, rows):
    with pytest.raises(ValueError, match="rows of one size"):
        E.svd_project(spark.createDataFrame(rows, "id int, vec array<double>"), "id", "vec", 1)


def test_svd_of_no_rows(spark):
    assert E.svd_project(spark.createDataFrame([], "id int, vec array<float>"), "id", "vec", 1).collect() == []


def _looped(losses, patience, threshold):
    run = R.NEW_RUN
    for epoch, loss in enumerate(losses):
        run = R.followed(run, epoch, loss, patience, threshold)
    return run


@pytest.mark.parametrize("patience, stretch", [(1, 4), (3, 4), (3, 7), (5, 2), (3, 4096)])
def test_early_stop_in_stretches_equals_the_loop(spark, patience, stretch):
    """Falling, rising, random and level losses, nothing that improves, runs of any length in stretches of any."""
    rng = random.Random(patience * 10 + stretch)
    runs = {i: [rng.choice([rng.uniform(0, 1), 0.5, float("nan")]) for _ in range(rng.randint(1, 40))] for i in range(40)}
    runs |= {100: [1 - i / 1000 for i in range(90)], 101: [1 - i * 0.006 for i in range(60)], 102: [float(i) for i in range(30)], 103: [float("nan")] * 9, 104: [float("inf"), 3.0]}
    runs |= {105: [5.0 - i // 3 for i in range(60)], None: [0.9 - i * 0.01 for i in range(31)], 106: [1.0 - (i % 7) * 0.1 for i in range(50)]}
    rows = [(run, e, x) for run, losses in runs.items() for e, x in enumerate(losses)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id long, epoch long, val_loss double").repartition(6)
    for threshold in (0.005, 0.0, 0.05):
        got = {r["run_id"]: tuple(r)[1:] for r in R.early_stop(df, patience, threshold, stretch=stretch).collect()}
        assert repr(got) == repr({k: _looped(runs[k], patience, threshold) for k in got}) and got.keys() == runs.keys()


def test_a_hot_run_is_in_no_task_whole(spark, tmp_path):
    path = str(tmp_path / "epochs")
    spark.range(3000).selectExpr("id % 3 as run_id", "id as epoch", "1.0 / (id + 1) as val_loss").write.parquet(path)
    plan = R.early_stop(spark.read.parquet(path), stretch=64)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
    first = plan.split("collect_list")[-1]  # the innermost list is that of a stretch
    assert "part#" in first.split("Exchange hashpartitioning(")[1].split("\n")[0]


def _columns(spark, a, k, **more):
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(a)], "id int, vec array<double>").repartition(7)
    got = {r["id"]: r["vec"] for r in E.svd_project(df, "id", "vec", k, **more).collect()}
    return np.array([got[i] for i in range(len(a))])


def _conditioned(n, d, smallest):
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.normal(size=(n, d)))[0], np.linalg.qr(rng.normal(size=(d, d)))[0]
    return u * np.logspace(0, smallest, d), v


def test_svd_keeps_small_singular_values(spark):
    """Values of 1 to 1e-10: the square of the last is below the rounding of the first's."""
    scaled, v = _conditioned(400, 12, -10)
    found = _columns(spark, scaled @ v.T, 12)
    lengths = np.linalg.norm(found, axis=0)
    assert np.allclose(lengths, np.logspace(0, -10, 12), rtol=1e-4, atol=0)
    assert np.allclose(np.abs(found / lengths), np.abs(scaled / np.logspace(0, -10, 12)), atol=1e-4)


def test_svd_of_more_dimensions_than_a_factor_holds(spark):
    scaled, v = _conditioned(150, 60, -8)
    found = _columns(spark, scaled @ v.T, 5, max_dim=30)
    assert np.allclose(np.abs(found), np.abs(scaled[:, :5]), atol=1e-8)
