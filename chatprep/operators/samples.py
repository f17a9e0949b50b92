"""Bounded next-token samples from pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.constants import BLOCK_SIZES, BOS_ID, EOS_ID, MAX_BLOCK, MIN_BLOCK, PAD_ID
from chatprep.functions.codec import pieces
from chatprep.functions.text import or_empty
from chatprep.operators.vocab import Codec, looked_up


def sample_ids(codec: Codec, asked: Column, answer: Column, block_size: int, arrow: bool = False) -> Column:
    """First `block_size` ids of the encoded input followed by the encoded output.

    Text that cannot reach the sample is cut before it is encoded. With `arrow` what is left of
    both sides is looked up over Arrow batches, in pieces of a megabyte: a third of the time
    for long samples, but the rows pass through Python.
    """
    head = F.substring(or_empty(asked), 1, block_size)
    # What the head with its begin and end ids leaves; one character more than fits, so that no end id does.
    left = F.greatest(F.lit(block_size - 2) - F.length(head), F.lit(0))
    tail = F.substring(or_empty(answer), F.lit(1), left)
    if not arrow:
        return F.slice(F.concat(codec.encode(head), codec.encode(tail)), 1, block_size)
    lookup = codec.array()

    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, heads in batches:
            done = 0
            for piece in pieces(texts):
                ids, sizes = looked_up(piece, lookup)
                yield _framed(ids, sizes, heads.slice(done, len(piece)).to_pylist(), block_size)
                done += len(piece)

    return F.arrow_udf(encode, "array<int>")(F.concat(head, tail), F.length(head))


def _framed(ids: np.ndarray, sizes: np.ndarray, heads: list[int], block_size: int) -> pa.Array:
    """Of each row the first ids of its head and the rest, each between begin and end ids."""
    kept = np.minimum(sizes + 4, block_size)
    ends = np.cumsum(kept)
    out, begin, end = np.empty(kept.sum(), np.int32), [BOS_ID], [EOS_ID]
    for stop, n, first, size, head in zip(ends.tolist(), kept.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), heads):
        row = np.concatenate([begin, ids[first : first + head], end, begin, ids[first + head : first + size], end])
        out[stop - n : stop] = row[:n]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))


def make_samples(pairs: DataFrame, codec: Codec, block_size: int, arrow: bool = False) -> DataFrame:
    """Pairs with `ids` in place of their texts; fewer than 2 ids make no sample."""
    keys = [c for c in pairs.columns if c not in ("input", "output")]
    ids = sample_ids(codec, F.col("input"), F.col("output"), block_size, arrow)
    samples = pairs.select(*keys, ids.alias("ids"))
    # Begin and end ids of both sides make at least 4 ids before the cut.
    return samples if block_size >= 2 else samples.filter(F.size("ids") >= 2)


def shift_targets(samples: DataFrame) -> DataFrame:
    """`x` and `y` in place of `ids`: all ids but the last, all ids but the first."""
    n = F.size("ids") - 1
    keys = [c for c in samples.columns if c != "ids"]
    return samples.select(*keys, F.slice("ids", F.lit(1), n).alias("x"), F.slice("ids", F.lit(2), n).alias("y"))


def loss_mask(batch: DataFrame, target: str = "y", pad_id: int = PAD_ID) -> DataFrame:
    """Adds `mask` (which targets count for the loss) and `n_counted`."""
    masked = batch.withColumn("mask", F.transform(F.col(target), lambda t: t != pad_id))
    return masked.withColumn("n_counted", F.size(F.filter("mask", lambda m: m)))


def length_profile(pairs: DataFrame, preset: str = "small") -> DataFrame:
    """One row on uncut sample lengths and the block size they call for.

    The longest sample counts between 16 and 2048 and never lowers the preset. Lengths come
    from `input_chars` where the pairs carry it, so histories need not be built.
    """
    asked = F.col("input_chars") if "input_chars" in pairs.columns else F.length("input")
    longest = F.least(F.greatest(F.max("n_ids"), F.lit(MIN_BLOCK)), F.lit(MAX_BLOCK))
    return pairs.select((asked + F.length("output") + 4).cast("bigint").alias("n_ids")).agg(
        F.count("*").alias("n_samples"),
        F.max("n_ids").alias("longest"),
        F.avg("n_ids").alias("mean"),
        F.greatest(longest, F.lit(BLOCK_SIZES[preset])).cast("bigint").alias("block_size"),
    )
