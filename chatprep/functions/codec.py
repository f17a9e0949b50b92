"""Character ids as column expressions, and a door for other tokenizers."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep.constants import BOS_ID, EOS_ID, N_SPECIAL, UNK_ID, UNK_TEXT

_TOKENIZERS: dict[str, Callable[[Column], Column]] = {}
_PIECE_BYTES = 1 << 20


def characters(text: Column) -> Column:
    """One element per code point; empty for the empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def ids_of(text: Column, lookup: Column) -> Column:
    """Ids of the characters through a dense code point -> id array."""
    return F.transform(characters(text), lambda ch: F.coalesce(F.get(lookup, F.ascii(ch)), F.lit(UNK_ID)))


def with_specials(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS_ID)), ids, F.array(F.lit(EOS_ID)))


def text_of(ids: Column, texts: Column, skip_special: bool = True) -> Column:
    """Characters of the ids through a dense id -> text array, joined."""
    kept = F.filter(ids, lambda i: i >= N_SPECIAL) if skip_special else ids
    return F.array_join(F.transform(kept, lambda i: F.coalesce(F.get(texts, i), F.lit(UNK_TEXT))), "")


def ids_csv(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def pieces(column: pa.Array, most: int = _PIECE_BYTES) -> Iterator[pa.Array]:
    """Runs of a column of texts or id lists that begin within the same `most` bytes.

    What is made of one run at a time is bounded, however many rows a batch has; a text is
    never cut.
    """
    lists = pa.types.is_list(column.type)
    sizes = pc.list_value_length(column) if lists else pc.binary_length(column)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) * (4 if lists else 1)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, append=-1)) + 1
    for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
        yield column.slice(a, b - a)


def register_tokenizer(name: str, fn: Callable[[pd.Series], pd.Series]) -> None:
    """Make an outside tokenizer (text series -> id-list series) usable as `tokenizer(name)`.

    It is given a batch in pieces, each a series of its own, and told nothing of the others.
    """

    def of_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for piece in pieces(pa.array(texts, pa.string())):
                yield fn(piece.to_pandas())

    _TOKENIZERS[name] = F.pandas_udf(of_series, "array<int>")


@dataclass(frozen=True)
class TokenizerSpec:
    """How a worker makes its tokenizer: a factory by its place, and what it is called with.

    The factory, `package.module:function`, gives a function from a list of texts to a list of
    id lists. Only the spec travels with the plan, not the tokenizer, which may be large and
    need not be picklable.
    """

    factory: str
    options: tuple[tuple[str, object], ...] = ()

    def made(self) -> Callable[[list[str]], list]:
        """The tokenizer, made once in a process."""
        if self not in _MADE:
            module, _, name = self.factory.partition(":")
            _MADE[self] = getattr(importlib.import_module(module), name)(**dict(self.options))
        return _MADE[self]


_MADE: dict[TokenizerSpec, Callable[[list[str]], list]] = {}


def _id_lists(made: Callable[[list[str]], list], texts: list[str | None]) -> pa.Array:
    """Ids of the texts; null for null."""
    there = [t for t in texts if t is not None]
    found = iter(made(there) if there else [])
    return pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.int32()))


def register_tokenizer_spec(name: str, factory: str, kind: str = "arrow", **options) -> None:
    """Make the tokenizer that `factory(**options)` gives usable as `tokenizer(name)`.

    It is made once per worker, before its first batch, and given batches in pieces. `kind` is
    how batches reach it: as Arrow arrays, which is cheaper, or as pandas `series`.
    """
    spec = TokenizerSpec(factory, tuple(sorted(options.items())))

    def of_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = spec.made()
        for texts in batches:
            for piece in pieces(texts):
                yield _id_lists(made, piece.to_pylist())

    def of_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = spec.made()
        for texts in batches:
            for piece in pieces(pa.array(texts, pa.string())):
                yield _id_lists(made, piece.to_pylist()).to_pandas()

    if kind not in ("arrow", "series"):
        raise ValueError(f"kind is arrow or series, not {kind}")
    _TOKENIZERS[name] = F.arrow_udf(of_arrays, "array<int>") if kind == "arrow" else F.pandas_udf(of_series, "array<int>")


def tokenizer_file(path: str, specials_are_text: bool = True) -> Callable[[list[str]], list[list[int]]]:
    """A factory: the tokenizer of a `tokenizers` file, without begin and end ids; needs that library on the workers.

    It runs on the one core a task has, unless TOKENIZERS_PARALLELISM says otherwise.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = specials_are_text
    model.no_truncation()
    model.no_padding()
    # The fast form leaves out places in the text, which nobody asks for here.
    return lambda texts: [found.ids for found in model.encode_batch_fast(texts, add_special_tokens=False)]


def detokenizer_file(path: str) -> Callable[[list[list[int]]], list[str]]:
    """A function from id lists to texts for the same file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda ids: model.decode_batch(ids, skip_special_tokens=False)


def detokenizer(factory: str, **options) -> Callable[[Column], Column]:
    """A function from id lists to texts through what `factory(**options)` gives, made once per worker; null for null."""
    spec = TokenizerSpec(factory, tuple(sorted(options.items())))

    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = spec.made()
        for ids in batches:
            for piece in pieces(ids):
                lists = piece.to_pylist()
                found = iter(made([x for x in lists if x is not None]))
                yield pa.array([None if x is None else next(found) for x in lists], pa.string())

    return F.arrow_udf(told, "string")


def tokenizer(name: str) -> Callable[[Column], Column]:
    return _TOKENIZERS[name]
