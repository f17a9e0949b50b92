"""Exact splits, shuffled batches, padding, and the schedule that follows from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.constants import BATCH_CAPS, MIN_LR_RATIO, PAD_ID, SPLIT_SEED
from chatprep.functions.hashing import seeded_hash
from chatprep.operators.ranks import shuffled_rank, smallest_hashes


def validation_size(n: int, ratio: float) -> int:
    """How many of `n` rows validate: none of a single row, else at least one."""
    return max(1, int(n * ratio)) if ratio > 0 and n > 1 else 0


def train_val_split(df: DataFrame, keys: list[str], eval_ratio: float, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds `split`: exactly `validation_size` rows are `val`, chosen by seeded hash of the unique `keys`.

    Only the cutting hash is looked for; marking the rows is a comparison, so no row moves.
    """
    h = seeded_hash(seed, *[F.col(k) for k in keys])
    cut = smallest_hashes(df, h, lambda n: validation_size(n, eval_ratio)) if eval_ratio > 0 else None
    return df.withColumn("split", F.lit("train") if cut is None else F.when(h <= cut, "val").otherwise("train"))


def batch_rows_for(model_size: str, batch_rows: int) -> int:
    return min(batch_rows, BATCH_CAPS.get(model_size, batch_rows))


def assign_batches(
    df: DataFrame, keys: list[str], epoch: int = 1, batch_rows: int = 16, seed: int = SPLIT_SEED, drop_last: bool = True
) -> DataFrame:
    """Adds `epoch`, `batch_id`, `row_in_batch` in an order shuffled anew each epoch.

    A last batch short of `batch_rows` is left out unless `drop_last` is off, as it should
    be for validation rows.
    """
    ranked = shuffled_rank(df, keys, f"{seed}:{epoch}", "_rank", "_total")
    at = F.col("_rank") - 1
    batch = F.floor(at / batch_rows)
    kept = ranked.filter(batch < F.floor(F.col("_total") / batch_rows)) if drop_last else ranked
    row = (at % batch_rows).cast("int")
    return kept.select(*df.columns, F.lit(epoch).alias("epoch"), batch.alias("batch_id"), row.alias("row_in_batch"))


def pad_batches(batches: DataFrame, columns: tuple = ("x", "y"), pad_ids: tuple | None = None) -> DataFrame:
    """Fills the id columns on the right up to the longest first column of their batch."""
    batch = W.partitionBy("epoch", "batch_id")
    width = F.max(F.size(columns[0])).over(batch)
    out = batches.withColumn("_width", width)
    for name, pad in zip(columns, pad_ids or (PAD_ID,) * len(columns)):
        fill = F.array_repeat(F.lit(pad), F.col("_width") - F.size(name))
        out = out.withColumn(name, F.concat(name, fill))
    return out.drop("_width")


def padded_batches(
    df: DataFrame, keys: list[str], epoch: int = 1, batch_rows: int = 16, seed: int = SPLIT_SEED, drop_last: bool = True, pad_id: int = PAD_ID
) -> DataFrame:
    """Samples `(keys..., ids)` to rows of one epoch's batches, `x` and `y` padded to the longest of their batch.

    What `pad_batches(assign_batches(shift_targets(df)))` gives. Batches and their widths
    are settled on lengths; ids move once, to meet their place, and are shifted and padded
    there. The samples are read several times, so give a stored table.
    """
    others = [c for c in df.columns if c != "ids"]
    placed = assign_batches(df.select(*keys, (F.size("ids") - 1).alias("_n")), keys, epoch, batch_rows, seed, drop_last)
    sized = placed.withColumn("_width", F.max("_n").over(W.partitionBy("epoch", "batch_id")))
    met = df.join(sized, keys)
    fill = F.array_repeat(F.lit(pad_id), F.col("_width") - F.col("_n"))
    x = F.concat(F.slice("ids", F.lit(1), F.col("_n")), fill)
    y = F.concat(F.slice("ids", F.lit(2), F.col("_n")), fill)
    return met.select(*others, x.alias("x"), y.alias("y"), "epoch", "batch_id", "row_in_batch")


def batch_matrices(padded: DataFrame, columns: tuple = ("x", "y")) -> DataFrame:
    """One row per batch, its id columns as rectangles in row order; a batch has few rows."""
    rows = F.array_sort(F.collect_list(F.struct("row_in_batch", *columns)))

    def column(name: str):
        return F.transform(rows, lambda r: r[name]).alias(name)

    return padded.groupBy("epoch", "batch_id").agg(*[column(name) for name in columns])


def plan_sizes(n_rows: int, batch_rows: int, epochs: int, warmup_ratio: float) -> tuple[int, int, int]:
    """(batches per epoch, total steps, warm-up steps); short last batches do not count."""
    per_epoch = n_rows // batch_rows
    total = max(1, per_epoch * epochs)
    return per_epoch, total, int(total * warmup_ratio)


def batch_plan(df: DataFrame, epochs: int, batch_rows: int = 16, accum: int = 1) -> DataFrame:
    """One row per batch: `(epoch, batch, is_step, global_step)`.

    The optimizer steps after every `accum` batches and after the last of an epoch, so the
    step number has a closed form and needs no running count.
    """
    per_epoch, _, _ = plan_sizes(df.count(), batch_rows, epochs, 0.0)
    rows = df.sparkSession.range(per_epoch * epochs)
    batch = F.col("id") % max(per_epoch, 1)
    epoch = F.floor(F.col("id") / max(per_epoch, 1))
    steps_per_epoch = math.ceil(per_epoch / accum)
    is_step = ((batch + 1) % accum == 0) | (batch + 1 == per_epoch)
    done = epoch * steps_per_epoch + F.when(batch + 1 == per_epoch, steps_per_epoch).otherwise(F.floor((batch + 1) / accum))
    return rows.select(
        (epoch + 1).alias("epoch"), batch.alias("batch"), is_step.alias("is_step"), done.cast("bigint").alias("global_step")
    )


def lr_factor(step, warmup: int, total: int, min_ratio: float = MIN_LR_RATIO):
    """Linear warm-up, then half a cosine down to `min_ratio`."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    decay = F.lit(min_ratio) + F.lit((1 - min_ratio) * 0.5) * (1 + F.cos(F.pi() * progress))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(decay)


def lr_schedule(
    plan: DataFrame, total_steps: int, warmup_steps: int, base_lr: float = 3e-4, min_ratio: float = MIN_LR_RATIO
) -> DataFrame:
    """Adds `lr`, the rate in force after the batch; it moves with optimizer steps only."""
    return plan.withColumn("lr", F.lit(base_lr) * lr_factor(F.col("global_step"), warmup_steps, total_steps, min_ratio))
