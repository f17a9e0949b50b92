import json
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from chatprep.operators import context as X
from chatprep.operators import layout as L
from chatprep.operators import pairs as P
from chatprep.operators import runs as R
from chatprep.operators import samples as S
from chatprep.operators import vocab as V
from chatprep.sources import records as Rec
from chatprep.streaming import streams as Z
from tests.test_runs import CASES


def _files(df, path, column, parts):
    """The frame as files that arrive one after another, by ranges of `column`."""
    for i, part in enumerate(parts):
        df.filter(F.col(column).isin(list(part))).coalesce(1).write.mode("append").parquet(path)


def _one_at_a_time(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_samples_equal_the_batch(spark, tmp_path):
    raws = [json.dumps({"system": "S", "conversation": [{"human": f"h{i}", "assistant": "a" * i}, {"human": "x", "assistant": "y"}]}) for i in range(30)]
    for part in range(3):
        (tmp_path / f"{part}.jsonl").write_text("\n\n".join(raws[part::3]))
    batch = Rec.read_jsonl(spark, str(tmp_path))
    codec = V.Codec.of(V.build_vocab(P.turns_corpus(batch)))
    want = S.make_samples(P.pairs_from_turns(batch), codec, 20).select("ids").collect()
    made = Z.stream_samples(Rec.stream_jsonl(spark, str(tmp_path)), L.TURNS, codec, 20)
    got = Z.drain(made, "samples").select("ids").collect()
    assert sorted(r["ids"] for r in got) == sorted(r["ids"] for r in want) and len(got) == 59


def test_stream_context_equals_the_batch(spark, tmp_path):
    rows = [(c, t, "system" if t % 7 == 3 else ("user" if t % 2 else "assistant"), f"{c}.{t}") for c in range(5) for t in range(4 * c + 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "turns")
    _files(turns, path, "turn", [range(12, 30), range(0, 5), range(5, 12)])
    for n in (1, 2):
        arriving = _one_at_a_time(spark, path, turns.schema)
        got = Z.current(Z.drain(Z.stream_context_window(arriving, n), "context"), "conv_id", "version")
        want = X.context_window(turns, n)
        columns = ["conv_id", "section", "turn", "role", "text"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_stream_early_stop_equals_the_batch(spark, tmp_path):
    rows = [(run, e, float(x)) for run, losses in CASES.items() for e, x in enumerate(losses)]
    epochs = spark.createDataFrame(rows, "run_id long, epoch long, val_loss double")
    path = str(tmp_path / "epochs")
    _files(epochs, path, "epoch", [range(5, 20), (1, 3), (0, 2, 4)])
    states = Z.drain(Z.stream_early_stop(_one_at_a_time(spark, path, epochs.schema), timeout_minutes=600), "stops", idle_batches=False)
    got = Z.current(states, "run_id", "version").drop("version", "n_known").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, R.early_stop(epochs).collect()), key=repr)


def test_streams_read_folder_tables_in_batches(spark, tmp_path):
    """A table of many files gives what the same table in one file gives."""
    rows = [(i, f"s{i % 3}", i * 37 % 5000) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, source string, m int")
    events = events.select("event_id", "source", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("ts"))
    counted = {}
    for files in (1, 9):
        path = str(tmp_path / f"events{files}")
        events.repartition(files, F.xxhash64("event_id")).write.parquet(path)
        arriving = _one_at_a_time(spark, path, events.schema)
        rates, late = Z.drain_updates(Z.stream_throughput(arriving, delay=None), ["source", "window_start"], "rates")
        counted[files] = {tuple(r) for r in rates.collect()}
        assert late == 0
    assert counted[1] == counted[9] and sum(r[3] for r in counted[9]) == 400


def test_stream_throughput_gives_open_windows_and_counts_late_tokens(spark, tmp_path):
    def at(*minutes):
        rows = [("s", m) for m in minutes]
        frame = spark.createDataFrame(rows, "source string, m int")
        return frame.select("source", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("ts"))

    path = str(tmp_path / "tokens")
    for minutes in ((1, 2, 59), (61, 130), (131,), (3, 140), (400,)):
        at(*minutes).coalesce(1).write.mode("append").parquet(path)
    arriving = _one_at_a_time(spark, path, at(1).schema)
    rates, late = Z.drain_updates(Z.stream_throughput(arriving), ["source", "window_start"], "rates")
    got = rates.orderBy("window_start").collect()
    # The token of minute 3 arrives after the watermark has passed minute 60, the end of its window.
    assert [r["n_tokens"] for r in got] == [3, 1, 3, 1] and late == 1
    assert got[0]["tokens_per_sec"] == 3 / 3600


def test_late_tokens_are_counted_over_all_batches(spark, tmp_path):
    path = str(tmp_path / "tokens")
    for minutes in ((400,), (500,), (3, 70, 600), (700,), (5, 800), (900,), (1000,), (1100,)):
        frame = spark.createDataFrame([("s", m) for m in minutes], "source string, m int")
        frame = frame.select("source", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        _, late = Z.drain_updates(Z.stream_throughput(_one_at_a_time(spark, path, frame.schema)), ["source", "window_start"], "rates")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert late == 3


def _arrive(spark, folder, name, rows, schema, made, checkpoint):
    """One more file, and what the stream says to it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{name}")
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = Z.write_available(made(arriving), f"{folder}/out", checkpoint, idle_batches=False)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_a_conversation_that_comes_back_starts_anew(spark, tmp_path):
    """After the timeout its messages are gone, and what it says then is later than what it said before."""
    schema = "conv_id long, turn long, role string, text string"
    made = lambda turns: Z.stream_context_window(turns, 2, timeout_minutes=1 / 60)
    where = (spark, str(tmp_path))
    checkpoint = str(tmp_path / "checkpoint")
    _arrive(*where, "a", [(1, t, "user", f"old {t}") for t in range(6)], schema, made, checkpoint)
    time.sleep(1.5)
    _arrive(*where, "b", [(2, 0, "user", "another")], schema, made, checkpoint)
    history = _arrive(*where, "c", [(1, 9, "user", "new")], schema, made, checkpoint)
    got = Z.current(history, "conv_id", "version").filter("conv_id = 1").collect()
    assert [(r["turn"], r["text"], r["n_seen"]) for r in got] == [(9, "new", 1)]


def test_a_run_that_comes_back_starts_anew(spark, tmp_path):
    schema = "run_id long, epoch long, val_loss double"
    made = lambda epochs: Z.stream_early_stop(epochs, timeout_minutes=1 / 60)
    where = (spark, str(tmp_path))
    checkpoint = str(tmp_path / "checkpoint")
    _arrive(*where, "a", [(1, e, 0.5) for e in range(3)], schema, made, checkpoint)
    history = _arrive(*where, "b", [(1, 3, 0.4)], schema, made, checkpoint)
    first = Z.current(history, "run_id", "version").first()
    assert (first["n_known"], first["best_val"], first["bad_epochs"]) == (4, 0.4, 0)
    time.sleep(1.5)
    _arrive(*where, "c", [(2, 0, 1.0)], schema, made, checkpoint)
    history = _arrive(*where, "d", [(1, 7, 0.9)], schema, made, checkpoint)
    back = Z.current(history, "run_id", "version").filter("run_id = 1").first()
    assert (back["n_known"], back["best_val"], back["n_epochs"]) == (1, 0.9, 1)


def test_early_stopping_asks_its_states_seldom():
    """A batch of a run's epochs is a few calls of its states, not one an epoch, and late ones are followed from all entries."""
    calls = []

    class State(dict):
        def __getattribute__(self, name):
            if name in ("get", "update", "getValue", "updateValue", "iterator", "exists"):
                calls.append(name)
            return super().__getattribute__(name)

        def get(self):
            return self["v"] if "v" in self else None

        def exists(self):
            return "v" in self

        def update(self, value):
            self["v"] = value

        def getValue(self, key):  # noqa: N802
            return self[key] if key in self else None

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

        def iterator(self):
            return iter(list(self.items()))

    class Handle:
        getValueState = getMapState = staticmethod(lambda *_: State())  # noqa: N815

    rng, losses = random.Random(5), {}
    stopping = Z._Stopping(3, 0.005, None)
    stopping.init(Handle())
    epochs = [*range(40), *rng.sample(range(40, 300), 260)]
    for first in range(0, 300, 20):
        some = {e: rng.random() for e in epochs[first : first + 20]} | ({7: 0.5} if first == 100 else {})
        losses |= some
        calls.clear()
        (got,) = stopping.handleInputRows((1,), iter([pd.DataFrame({"epoch": list(some), "val_loss": list(some.values())})]), None)
        run = R.NEW_RUN
        for epoch in sorted(losses):
            run = R.followed(tuple(run), epoch, losses[epoch], 3, 0.005)
        want = [1, first // 20 + 1, len(losses), *run]
        assert [None if pd.isna(x) else x for x in got.iloc[0].tolist()] == want
        assert len(calls) <= (6 if first < 40 else 15)
