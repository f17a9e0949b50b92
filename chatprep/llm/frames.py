"""What the operators of this package share: words, Arrow columns, valid vectors, small tables, bits of keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_SMALL_ROWS = 100_000
_MOST_BITS = 26
_BITS_A_KEY = 16


def words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; white space is U+0020 and U+0009 to U+000D, as for `bytes.split`."""
    return text.lower().split() if text else []


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def remainder_of_id(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, mod `divisor`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(divisor))


def set_apart(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its other columns under names that no operator uses, and what each of these was."""
    names = {c: f"_kept_{i}" for i, c in enumerate(c for c in df.columns if c not in used)}
    return df.select(*[_named(c).alias(names.get(c, c)) for c in df.columns]), {kept: c for c, kept in names.items()}


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def put_back(df: DataFrame, names: dict[str, str], order: list[str], added: list[str]) -> DataFrame:
    """The columns of `order` under their own names again, then those added."""
    kept = {c: k for k, c in names.items()}
    return df.select(*[_named(kept.get(c, c)).alias(c) for c in order], *added)


def usable_vector(vec: Column) -> Column:
    """Not null, and no component null or non-finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def hint_small(df: DataFrame, limit: int = _SMALL_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has been counted and is small, as it is otherwise.

    Give it stored frames: counting runs them.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def key_bits(found: DataFrame, count: int) -> np.ndarray:
    """A bit for each remainder of a key, its upper half folded into the lower one: 1 if a key has it. `_BITS_A_KEY` a key, of which there are `count`, `2**_MOST_BITS` at most."""
    size = min(_MOST_BITS, max(6, (count * _BITS_A_KEY).bit_length()))
    bit = F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 32)).bitwiseAND(F.lit((1 << size) - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    rows = found.select(F.shiftright(bit, 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    got = rows.toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out
