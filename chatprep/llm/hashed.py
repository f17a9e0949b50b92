"""Hashed words and character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from chatprep.llm.frames import words

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK_BYTES = 1 << 19
_SPACE = 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, step in enumerate((BASE, _INVERSE)):
            table = np.full(1 << (n - 1).bit_length(), step, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Chunk:
    """Words of a run of texts, one space around each; `doc` says of which text a word is."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # whether a word is the first of its text

    def __post_init__(self):
        up, self._down = power_tables(len(self.data) + 1)
        self._sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self.data * up[:-1], out=self._sums[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64 bits for each span [a, b): equal bytes have equal hashes, wherever they are."""
        return (self._sums[b] - self._sums[a]) * self._down[a]

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams within words, the spaces around a word included, and the text of each."""
        spaces = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(self.data == _SPACE, out=spaces[1:])
        at = np.arange(max(0, len(self.data) - n + 1))
        at = at[spaces[at + n - 1] == spaces[at + 1]]
        word = np.maximum(spaces[at + 1] - 1, 0)  # the words before it end in as many spaces, less the leading one
        return self.hashes(at, at + n), self.doc[word]


def chunks(texts: list[bytes | None], limit: int = _CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of the texts in chunks of about `limit` bytes; a long text spreads over several."""
    held: list[bytes] = []
    docs: list[int] = []
    counts: list[int] = []
    firsts: list[bool] = []
    size = 0
    for d, text in enumerate(texts):
        tokens = words(text)
        step = limit // 8
        for cut in range(0, len(tokens), step):
            part = tokens[cut : cut + step]
            held += part
            docs.append(d)
            counts.append(len(part))
            firsts.append(cut == 0)
            size += sum(map(len, part)) + len(part)
            if size >= limit:
                yield _chunk(held, docs, counts, firsts)
                held, docs, counts, firsts, size = [], [], [], [], 0
    if held:
        yield _chunk(held, docs, counts, firsts)


def _chunk(held: list[bytes], docs: list[int], counts: list[int], firsts: list[bool]) -> Chunk:
    data = np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    ends = np.cumsum(lengths + 1)
    first = np.zeros(len(held), bool)
    first[np.cumsum([0, *counts[:-1]])] = firsts
    return Chunk(data, ends - lengths, ends, np.repeat(np.array(docs), counts), first)


def buckets(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Numbers below 2**bits."""
    h = (hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) * _MIX
    h ^= h >> np.uint64(32)
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
