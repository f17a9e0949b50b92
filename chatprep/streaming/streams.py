"""The batch operators on unbounded input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chatprep.operators.pairs import pairs_of_layout
from chatprep.operators.runs import NEW_RUN, STOP_COLUMNS, epoch_losses, followed
from chatprep.operators.samples import make_samples
from chatprep.operators.vocab import Codec
from chatprep.sources.shared import new_folder

FILES_PER_BATCH = 64
EPOCHS_AN_ENTRY = 64


_IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as a query takes to start, which keeps them as they are then."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_available(df: DataFrame, path: str, checkpoint: str | None = None, idle_batches: bool = True) -> StreamingQuery:
    """Process what has arrived into Parquet files, exactly once, then stop.

    State is kept in RocksDB: on local disk and in the checkpoint, not in an executor's heap.
    Turn `idle_batches` off for streams with a timeout: these always ask for another batch,
    with new rows or without, and what has arrived would never be done.
    """
    spark = df.sparkSession
    checkpoint = checkpoint or new_folder(spark, "stream")
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _settings(spark, {_STATE_STORE: _ROCKS_DB} | ({} if idle_batches else {_IDLE_BATCHES: "false"})):
        return writer.start()


def drain(df: DataFrame, label: str, idle_batches: bool = True) -> DataFrame:
    """Run a stream over what has arrived and read back what it wrote."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    write_available(df, path, idle_batches=idle_batches).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def stream_samples(records: DataFrame, layout: str, codec: Codec, block_size: int, keys: tuple[str, str] | None = None) -> DataFrame:
    """Pairs and samples of a stream of raw records; layout and vocabulary are settled beforehand.

    The batch functions as they are: they work within a record, so the stream needs no state.
    """
    return make_samples(pairs_of_layout(records, layout, keys, max_chars=block_size), codec, block_size)


_MESSAGES = "conv_id long, turn long, role string, text string"


def _trimmed(n: int):
    """Per Arrow batch: the newest `2n` other messages and all system messages of a conversation.

    `weight` says for how many messages a row stands, so nothing is lost to the count.
    """

    def trim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            system = (pdf["role"] == "system").to_numpy()
            others = pdf[~system].sort_values("turn", ascending=False)
            kept = pd.concat([pdf[system], others[others.groupby("conv_id").cumcount() < 2 * n]])
            sizes = pdf.groupby("conv_id").size()
            kept = kept.assign(weight=1)
            surplus = sizes - kept.groupby("conv_id").size().reindex(sizes.index, fill_value=0)
            first = ~kept.duplicated("conv_id")
            kept.loc[first, "weight"] += kept.loc[first, "conv_id"].map(surplus).astype("int64")
            yield kept[["conv_id", "turn", "role", "text", "weight"]]

    return trim


class _Forgetful(StatefulProcessor):
    """State of a key that is forgotten once nothing has come for `minutes`, but for how often it has spoken.

    That number stays, so that what a key says after it came back counts as later than what it
    said before.
    """

    def __init__(self, minutes: float | None):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spoken = handle.getValueState("spoken", "version long")
        self.states = []

    def held(self, state):
        """The state, to be forgotten with the others."""
        self.states.append(state)
        return state

    def next_version(self, timers) -> int:
        version = (self.spoken.get() or (0,))[0] + 1
        self.spoken.update((version,))
        if self.minutes:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.minutes * 60_000))
        return version

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.states:
            state.clear()
        yield from ()

    def close(self) -> None:
        pass

    @property
    def time_mode(self) -> str:
        return "ProcessingTime" if self.minutes else "None"


class _Context(_Forgetful):
    """The last `2n` messages and all system messages of a conversation, an entry each."""

    def __init__(self, n: int, minutes: float | None):
        super().__init__(minutes)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.system = self.held(handle.getMapState("system", "turn long", "text string"))
        self.others = self.held(handle.getMapState("others", "turn long", "role string, text string"))
        self.seen = self.held(handle.getValueState("seen", "n long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        newest = {k[0]: v for k, v in self.others.iterator()}
        came, gone = {}, set(newest)
        for pdf in rows:
            seen += int(pdf["weight"].sum())
            for turn, role, text in zip(pdf["turn"].tolist(), pdf["role"], pdf["text"]):
                if role == "system":
                    self.system.updateValue((turn,), (text,))
                else:
                    came[turn] = (role, text)
            kept = sorted(newest | came)[-2 * self.n :]
            newest, came = {t: v for t, v in newest.items() if t in kept}, {t: v for t, v in came.items() if t in kept}
        for turn, value in came.items():
            self.others.updateValue((turn,), value)
        for turn in gone - set(newest) - set(came):
            self.others.removeKey((turn,))
        self.seen.update((seen,))
        version = self.next_version(timerValues)
        front = 0 if seen > 2 * self.n else 1
        system = sorted((k[0], v[0]) for k, v in self.system.iterator())
        out = [(key[0], version, seen, front, turn, "system", text) for turn, text in system]
        out += [(key[0], version, seen, 1, turn, *value) for turn, value in sorted((newest | came).items())]
        yield pd.DataFrame(out, columns=["conv_id", "version", "n_seen", "section", "turn", "role", "text"])


def stream_context_window(turns: DataFrame, n: int, timeout_minutes: float | None = None) -> DataFrame:
    """`context_window` kept up to date while turns arrive, `n > 0`.

    Every conversation touched by a batch gives its whole context again, marked `version`;
    the largest is the current one. State per conversation is the last `2n` messages and
    its system messages, of which a batch writes those that came and removes those that
    went; batches are cut down to them in each task before the shuffle. A conversation is
    forgotten once nothing has come for `timeout_minutes`, if given; one that comes back
    starts anew.
    """
    light = turns.select("conv_id", "turn", "role", "text").mapInPandas(_trimmed(n), f"{_MESSAGES}, weight long")
    context = _Context(n, timeout_minutes)
    schema = "conv_id long, version long, n_seen long, section int, turn long, role string, text string"
    return light.groupBy("conv_id").transformWithStateInPandas(context, schema, "Append", context.time_mode)


class _Stopping(_Forgetful):
    """A run's losses, an entry per `EPOCHS_AN_ENTRY` epochs, and how far they have been followed.

    Every call of a state goes from Python to the JVM and back, so there are few of them.
    """

    def __init__(self, patience: int, threshold: float, minutes: float | None):
        super().__init__(minutes)
        self.patience, self.threshold = patience, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.losses = self.held(handle.getMapState("losses", "at long", "epochs array<long>, val_losses array<double>"))
        self.known = self.held(handle.getValueState("known", f"last long, n_known long, {STOP_COLUMNS}"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = {}
        for pdf in rows:
            came.update(zip(pdf["epoch"].tolist(), pdf["val_loss"].tolist()))
        last, n_known, *run = self.known.get() or (None, 0, *NEW_RUN)
        entries = {epoch // EPOCHS_AN_ENTRY: {} for epoch in came}
        for at, losses in entries.items():
            if last is not None and (entry := self.losses.getValue((at,))):
                losses.update(zip(*entry))
        others = sum(map(len, entries.values())) < n_known
        for epoch, loss in came.items():
            entries[epoch // EPOCHS_AN_ENTRY][epoch] = loss
        for at, losses in entries.items():
            self.losses.updateValue((at,), (list(losses), list(losses.values())))
        if last is not None and min(came) <= last:
            # A late epoch can change what every later one meant.
            known = [v for _, v in self.losses.iterator()] if others else [(e, e.values()) for e in entries.values()]
            came = {epoch: loss for entry in known for epoch, loss in zip(*entry)}
            n_known, run = 0, NEW_RUN
        run = tuple(run)
        for epoch in sorted(came):
            run = followed(run, epoch, came[epoch], self.patience, self.threshold)
        n_known += len(came)
        self.known.update((max(came), n_known, *run))
        frame = pd.DataFrame([(key[0], self.next_version(timerValues), n_known, *run)], columns=["run_id", "version", "n_known", "stop_epoch", "best_val", "bad_epochs", "n_epochs"])
        yield frame.astype({"stop_epoch": "Int64"})


def stream_early_stop(epochs: DataFrame, patience: int = 3, threshold: float = 0.005, timeout_minutes: float | None = None) -> DataFrame:
    """`early_stop` while epochs arrive, in any order; one row per run and batch, the largest `version` is current.

    An epoch that follows those known is one step; one that comes late can change what every
    later one meant, so the run's losses, some to an entry of state, are followed anew. An
    epoch that comes again replaces its loss. A run is forgotten once nothing has come for
    `timeout_minutes`, if given; one that comes back starts anew.
    """
    stopping = _Stopping(patience, threshold, timeout_minutes)
    schema = f"run_id long, version long, n_known long, {STOP_COLUMNS}"
    return epoch_losses(epochs).groupBy("run_id").transformWithStateInPandas(stopping, schema, "Append", stopping.time_mode)


def current(history: DataFrame, key: str | list[str], version: str) -> DataFrame:
    """The rows of each key's latest version."""
    keys = [key] if isinstance(key, str) else key
    latest = history.groupBy(*keys).agg(F.max(version).alias("_v"))
    return history.join(latest, keys).filter(F.col(version) == F.col("_v")).drop("_v")


def drain_updates(df: DataFrame, key: list[str], label: str) -> tuple[DataFrame, int]:
    """Run an aggregating stream over what has arrived: the latest row of every key, and how many rows came too late.

    Keys come out as soon as they change, not when the watermark has passed them, so those
    still open at the end are there too. Spark counts what came too late after the rows of a
    key in one task of a batch have become one. A batch that is run again writes the same folder.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    late: dict[int, int] = {}
    started: list[StreamingQuery] = []

    def note() -> None:
        # Spark keeps the progress of the last batches only, so it is read while they run.
        for p in [p for query in started for p in query.recentProgress]:
            dropped = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
            late[p["batchId"]] = max(dropped, late.get(p["batchId"], 0))

    def write(rows: DataFrame, number: int) -> None:
        note()
        rows.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    writer = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    started.append(query)
    query.awaitTermination()
    note()
    schema = df.schema.add("_batch", "long")
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    history = reader.parquet(f"{path}/rows") if query.lastProgress else spark.createDataFrame([], schema)
    return current(history, key, "_batch").drop("_batch"), sum(late.values())


def stream_throughput(
    tokens: DataFrame, width: str = "1 hour", delay: str | None = "10 minutes", source: str = "source", ts: str = "ts"
) -> DataFrame:
    """Tokens per source and window of event time.

    Tokens later than `delay` are dropped, and counted by the query's progress; windows are
    forgotten once that has passed their end. Without a delay every token counts, and every
    window is kept in mind.
    """
    timed = tokens.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, delay) if delay else timed
    counted = timed.groupBy(F.window(ts, width), source).agg(F.count("*").alias("n_tokens"))
    micros = F.unix_micros(F.col("window.end").cast("timestamp")) - F.unix_micros(F.col("window.start").cast("timestamp"))
    return counted.select(
        source,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "n_tokens",
        (F.col("n_tokens") * 1e6 / micros).alias("tokens_per_sec"),
    )
