"""Generated tokens and training runs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.constants import EOS_ID, N_SPECIAL
from chatprep.functions.rows import each
from chatprep.functions.text import escape_tilde
from chatprep.operators.ranks import grouped_offset
from chatprep.operators.vocab import Codec

_STRETCH = 4096  # steps of a generation that one task gathers


def _stretches(tokens: DataFrame, gen: list[str], steps: int) -> DataFrame:
    """`(gen..., piece, ids)`: kept ids ahead of the end id, by stretches of steps, empty ones included.

    One aggregate per stretch carries its first end step along, so the generation's end
    comes from one row per stretch and no generation is gathered for it.
    """
    said = F.when(F.col("token_id") >= N_SPECIAL, F.struct("step", "token_id"))
    pieces = tokens.groupBy(*gen, F.floor(F.col("step") / steps).alias("piece")).agg(
        F.array_sort(F.collect_list(said)).alias("spots"),
        F.min(F.when(F.col("token_id") == EOS_ID, F.col("step"))).alias("_end"),
    )
    ended = pieces.withColumn("_end", F.min("_end").over(W.partitionBy(*gen)))
    before_end = F.filter("spots", lambda t: F.col("_end").isNull() | (t["step"] < F.col("_end")))
    return ended.select(*gen, "piece", F.transform(before_end, lambda t: t["token_id"]).alias("ids"))


def _whole(tokens: DataFrame, gen: list[str], steps: int) -> DataFrame:
    """`(gen..., ids)`: all kept ids of a generation, in order."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    gathered = _stretches(tokens, gen, steps).groupBy(*gen).agg(parts.alias("parts"))
    return gathered.select(*gen, F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def assemble_generation(tokens: DataFrame, codec: Codec, gen: list[str] = ("gen_id",), piece_steps: int | None = None) -> DataFrame:
    """`(gen..., text)`: what each generation `(gen..., step, token_id)` said up to its end id.

    Other special ids are skipped, unmapped ids become the unknown character, tildes are
    escaped; a generation that says nothing has the empty text. With `piece_steps` it comes
    as rows `(gen..., piece, text)`, one for each stretch of so many steps, to be read in
    order: for tables with generations too long for a row.
    """
    gen = list(gen)
    if piece_steps:
        rows, keys = _stretches(tokens, gen, piece_steps), [*gen, "piece"]
    else:
        rows, keys = _whole(tokens, gen, _STRETCH), gen
    return rows.select(*keys, escape_tilde(codec.decode(F.col("ids"))).alias("text"))


def running_generation(tokens: DataFrame, codec: Codec, gen: list[str] = ("gen_id",)) -> DataFrame:
    """`(gen..., pos, text)`: a generation's text as it stood after each kept token, from its beginning."""
    gen = list(gen)
    # A kept id is one character, so what had been said is a prefix of what was said in the end.
    whole = _whole(tokens, gen, _STRETCH).select(*gen, codec.decode(F.col("ids")).alias("said"), "ids")
    rows = each(whole.withColumn("ids", F.sequence(F.lit(1), F.size("ids"))).filter("said <> ''"), [*gen, "said"], "ids", "pos", "n")
    return rows.select(*gen, "pos", escape_tilde(F.substring("said", F.lit(1), F.col("n"))).alias("text"))


def throughput(tokens: DataFrame, gen: str = "gen_id", ts: str = "ts") -> DataFrame:
    """`(gen_id, n_tokens, seconds, tokens_per_sec)`; every token counts, 0 where no time passed."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    elapsed = (F.max(at) - F.min(at)) / F.lit(1e6)
    timed = tokens.groupBy(gen).agg(F.count("*").alias("n_tokens"), elapsed.alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("n_tokens") / F.col("seconds")).otherwise(0.0)
    return timed.withColumn("tokens_per_sec", rate)


def epoch_rollup(steps: DataFrame, batch_rows: int = 16, block_size: int = 128) -> DataFrame:
    """Per `(run_id, epoch)` from `(run_id, epoch, step, split, loss, lr, seconds, n_tokens)` rows.

    Unweighted mean losses: NaN without training steps, 0 without validation steps. The
    learning rate is that of the last training step. The nominal rate counts padding, the real one the tokens that were there.
    """
    train = F.col("split") == "train"
    seconds = F.greatest(F.sum("seconds"), F.lit(1e-6))
    rolled = steps.groupBy("run_id", "epoch").agg(
        F.coalesce(F.avg(F.when(train, F.col("loss"))), F.lit(float("nan"))).alias("train_loss"),
        F.coalesce(F.avg(F.when(F.col("split") == "val", F.col("loss"))), F.lit(0.0)).alias("val_loss"),
        F.max_by("lr", F.when(train, F.col("step"))).alias("lr"),
        F.sum("seconds").alias("seconds"),
        F.count_if(train).alias("n_steps"),
        (F.count_if(train) * (batch_rows * block_size) / seconds).alias("nominal_tokens_per_sec"),
        (F.sum(F.when(train, F.col("n_tokens")).otherwise(0)) / seconds).alias("real_tokens_per_sec"),
    )
    return rolled


STOP_COLUMNS = "stop_epoch bigint, best_val double, bad_epochs int, n_epochs bigint"
NEW_RUN = (None, float("inf"), 0, 0)


def epoch_losses(epochs: DataFrame) -> DataFrame:
    """`(run_id, epoch, val_loss)` where there is a loss."""
    typed = epochs.select("run_id", F.col("epoch").cast("bigint").alias("epoch"), F.col("val_loss").cast("double").alias("val_loss"))
    return typed.filter(F.col("val_loss").isNotNull())


def early_stop(epochs: DataFrame, patience: int = 3, threshold: float = 0.005, stretch: int = _STRETCH) -> DataFrame:
    """`(run_id, stop_epoch, best_val, bad_epochs, n_epochs)` from `(run_id, epoch, val_loss)`.

    An epoch improves a run if it falls below the best loss by more than `threshold`; after
    `patience` epochs without improvement the run stops (`stop_epoch` null: it did not).

    Whether an epoch improves depends on which earlier ones did. But from an epoch that did,
    the next one that does lies among the `patience` epochs after it, or the run stops there.
    So a stretch of a run is a table of `patience` entries: from each of its first epochs
    the chain of improvements ends in it, or leaves it for one of the next stretch's first.
    These tables follow each other per run; no task holds more of a run than a stretch, and
    a row per stretch.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    stretch = max(stretch, patience)
    losses = epoch_losses(epochs)
    longest = losses.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= stretch:
        parts = losses.withColumn("part", F.lit(0).cast("bigint"))
    else:
        placed = grouped_offset(losses.withColumn("_one", F.lit(1)), ["run_id"], ["epoch", "val_loss"], "_one", "_pos")
        part = F.expr(f"_pos div {stretch}L")
        # The first epochs of a stretch are also what the one before looks ahead to.
        both = F.when((F.col("_pos") % stretch < patience) & (part > 0), F.array(part, part - 1)).otherwise(F.array(part))
        parts = placed.select("run_id", "epoch", "val_loss", F.explode(both).alias("part"))
    spots = F.array_sort(F.collect_list(F.struct("epoch", "val_loss")))
    gathered = parts.groupBy("run_id", "part").agg(spots.alias("spots"))
    # Every run begins at a loss that any improves on.
    start = F.array(F.struct(F.lit(None).cast("bigint").alias("epoch"), F.lit(float("inf")).alias("val_loss")))
    first = F.col("part") == 0
    led = gathered.select("run_id", "part", F.when(first, F.concat(start, "spots")).otherwise(F.col("spots")).alias("spots"))
    own = stretch + F.when(first, 1).otherwise(0)
    tables = led.select("run_id", "part", _entries("spots", own, F.col("part") * stretch - F.when(first, 1).otherwise(0), patience, threshold).alias("entries"))
    in_order = F.array_sort(F.collect_list(F.struct("part", "entries")))
    runs = tables.groupBy("run_id").agg(in_order.alias("parts"))
    begin = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in _STATE[:-1]], F.lit(0).cast("int").alias("leaves"))
    end = F.aggregate("parts", begin, lambda s, p: F.when(s["leaves"].isNull(), s).otherwise(F.element_at(p["entries"], s["leaves"] + 1)))
    return runs.select("run_id", end.alias("end")).select("run_id", *[f"end.{n}" for n, _ in _STATE[:-1]])


_STATE = [("stop_epoch", "bigint"), ("best_val", "double"), ("bad_epochs", "int"), ("n_epochs", "bigint"), ("leaves", "int")]


def _entries(spots: str, own: Column, offset: Column, patience: int, threshold: float) -> Column:
    """What becomes of a run whose best loss so far is that of one of a stretch's first `patience` spots.

    `spots` has the stretch's `own` and then up to `patience` of the next; the first is at
    `offset` of its run. The outcome is a state of `_STATE`; `leaves` says at which of the next
    stretch's spots the chain goes on, null if it ends here.
    """
    kind = "struct<" + ", ".join(f"{n}: {t}" for n, t in _STATE) + ">"

    def seen(spot: Column, i: Column) -> Column:
        ahead = F.slice(spots, i + 2, F.lit(patience))
        better = F.transform(ahead, lambda x: x["val_loss"] < spot["val_loss"] - F.lit(threshold))
        full = F.size(ahead) == patience
        return F.struct(
            F.array_position(better, True).cast("int").alias("next"),
            F.when(full, F.element_at(ahead, -1)["epoch"]).alias("stop_epoch"),
            spot["val_loss"].alias("best_val"),
            F.size(ahead).alias("bad_epochs"),
            (offset + i + 1 + F.size(ahead)).cast("bigint").alias("n_epochs"),
            (own - i - 1).cast("int").alias("left"),
        )

    def outcome(known: Column, spot: Column) -> Column:
        ends = F.struct(spot["stop_epoch"], spot["best_val"], spot["bad_epochs"], spot["n_epochs"], F.lit(None).cast("int"))
        leaves = F.struct(*[F.lit(None).cast(t) for _, t in _STATE[:-1]], (spot["next"] - spot["left"] - 1).cast("int"))
        here = F.when(spot["next"] == 0, ends.cast(kind)).when(spot["next"] > spot["left"], leaves.cast(kind))
        return here.otherwise(F.get(known, spot["next"] - 1))

    mine = F.slice(F.transform(spots, seen), F.lit(1), own)
    # From the last spot back: the outcomes of the `patience` spots that follow are known.
    return F.aggregate(F.reverse(mine), F.array().cast(f"array<{kind}>"), lambda known, spot: F.slice(F.concat(F.array(outcome(known, spot)), known), 1, patience))


def followed(state: tuple, epoch: int, loss: float, patience: int, threshold: float) -> tuple:
    """A run's `(stop_epoch, best_val, bad_epochs, n_epochs)` after one more epoch; nothing changes after the stop."""
    stop, best, bad, n = state
    if stop is not None:
        return state
    better = loss < best - threshold
    best, bad = (loss, 0) if better else (best, bad + 1)
    return (epoch if bad >= patience else None), best, bad, n + 1


def best_epoch(epochs: DataFrame) -> DataFrame:
    """`(run_id, epoch, val_loss)` of the lowest validation loss, the earliest among equals."""
    lowest = F.min(F.struct("val_loss", "epoch"))
    found = epochs.filter(F.col("val_loss").isNotNull()).groupBy("run_id").agg(lowest.alias("b"))
    return found.select("run_id", F.col("b")["epoch"].alias("epoch"), F.col("b")["val_loss"].alias("val_loss"))
