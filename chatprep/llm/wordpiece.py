"""Token counts by greedy longest match, in time linear in the text, without building pieces."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatprep.llm.frames import raw_texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_CHUNK_BYTES = 1 << 20
_WORD_START, _WORD_END = b"\xfe", b"\xff"  # bytes that UTF-8 does not use


@dataclass
class Automaton:
    """A trie of pieces with failure links.

    At a node where the next byte does not go on, the longest pieces that cover its string
    as far as possible are popped: `pops` says how many, `fails` which node the rest of the
    string is at (-1: none, the word is unknown). `at_end` is the number of pieces popped if
    the word ends there. Children are in one displaced table: that of node v by byte c is at
    `base[v] + c`, if `owner` there is v.
    """

    base: np.ndarray
    owner: np.ndarray
    child: np.ndarray
    fails: np.ndarray
    pops: np.ndarray
    at_end: np.ndarray
    lead: bytes
    tail: bytes

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, and whether it is unknown; an unknown word is one piece.

        All words take a step together, longer ones first, so those still going are a prefix.
        """
        n = len(words)
        data = np.frombuffer(self.lead + (self.tail + self.lead).join(words) + self.tail, np.uint8).astype(np.int32)
        around = len(self.lead) + len(self.tail)
        lengths = np.fromiter(map(len, words), np.int64, n) + around
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, pops, lost = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        going = np.searchsorted(-lengths, -np.arange(lengths[0] if n else 0))  # how many words are longer than each step
        for step, k in enumerate(going):
            byte, s = data[starts[:k] + step], state[:k]
            slot = self.base[s] + byte
            wrong = np.flatnonzero(self.owner[slot] != s)
            while wrong.size:
                at = s[wrong]
                pops[wrong] += self.pops[at]
                back = self.fails[at]
                lost[wrong[back < 0]] = True
                stuck = wrong[back < 0]
                wrong = wrong[back >= 0]
                s[wrong] = back[back >= 0]
                slot[wrong] = self.base[s[wrong]] + byte[wrong]
                s[stuck], slot[stuck] = 0, -1  # the last slot leads to the root
                wrong = wrong[self.owner[slot[wrong]] != s[wrong]]
            state[:k] = self.child[slot]
        end = self.at_end[state]
        lost |= end < 0
        found, unknown = np.empty(n, np.int64), np.empty(n, bool)
        found[order], unknown[order] = np.where(lost, 1, pops + end), lost
        return found, unknown


def build(pieces: Iterable[bytes], lead: bytes = b"", tail: bytes = b"") -> Automaton:
    """The automaton of pieces; every word is matched as lead + word + tail."""
    children: list[dict[int, int]] = [{}]
    parent, by, final = [0], [0], [False]
    for piece in sorted(set(pieces) - {b""}):
        v = 0
        for c in piece:
            to = children[v].get(c)
            if to is None:
                to = children[v][c] = len(children)
                children.append({})
                parent.append(v)
                by.append(c)
                final.append(False)
            v = to
        final[v] = True
    n = len(children)
    fails, pops, at_end, order = [-1] * n, [0] * n, [-1] * n, [0]
    at_end[0] = 0
    for v in order:  # by depth: what a failure leads to is never deeper
        order.extend(children[v].values())
        if v == 0:
            continue
        if final[v]:
            fails[v], pops[v] = 0, 1
        else:
            z, popped = fails[parent[v]], pops[parent[v]]
            while z >= 0 and by[v] not in children[z]:
                popped += pops[z]
                z = fails[z]
            if z >= 0:
                fails[v], pops[v] = children[z][by[v]], popped
        if fails[v] >= 0 and at_end[fails[v]] >= 0:
            at_end[v] = pops[v] + at_end[fails[v]]
    base, owner, child = displaced(children)
    return Automaton(base, owner, child, *(np.array(x, np.int32) for x in (fails, pops, at_end)), lead, tail)


def displaced(children: list[dict[int, int]], width: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of children laid over each other where they leave gaps, fullest first.

    Bytes, or whatever else the children go by, are below `width`. Rows of several children are tried from where room was last scarce; those of one fill
    what was passed over.
    """
    size = sum(map(len, children)) * 2 + 4 * width
    owner, child, base = [-1] * size, [0] * size, [0] * len(children)
    free = scarce = 0
    for v in sorted(range(len(children)), key=lambda v: -len(children[v])):
        row = children[v]
        if not row:
            continue
        while owner[free] >= 0 or free < min(row):
            free += 1
        at = start = max(free if len(row) == 1 else scarce, min(row)) - min(row)
        while any(owner[at + c] >= 0 for c in row):
            at += 1
            if at + 2 * width > len(owner):
                owner += [-1] * size
                child += [0] * size
        if len(row) > 1 and at > start + 64:
            scarce = at
        base[v] = at
        for c, to in row.items():
            owner[at + c], child[at + c] = v, to
    reach = max(base) + width
    owner, child = owner[:reach] + [-1] * (reach - len(owner)), child[:reach] + [0] * (reach - len(child))
    # One more slot, reached as -1, leads to the root and belongs to nobody.
    return np.array(base, np.int32), np.array([*owner, -2], np.int32), np.array([*child, 0], np.int32)


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str = VOCABULARY) -> Automaton:
    """The automaton of a vocabulary file, read on the driver.

    `.txt`: a piece per line, `##` before those that go on with a word; words that pieces do
    not cover are unknown. `.json`: the vocabulary of a byte-level tokenizer, whose pieces
    begin with a space at the start of a word, or end with `</w>` at its end.
    """
    if path.endswith(".txt"):
        with open(path, encoding="utf-8") as lines:
            return from_wordpieces(line.rstrip("\n") for line in lines)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, suffix = _byte_letters(), model.get("end_of_word_suffix") or ""
    pieces = []
    for text in model["vocab"]:
        whole = suffix and text.endswith(suffix)
        core = text[: -len(suffix)] if whole else text
        if all(c in letters for c in core):
            pieces.append(bytes(letters[c] for c in core) + (_WORD_END if whole else b""))
    return build(pieces, b"" if suffix else b" ", _WORD_END if suffix else b"")


def from_wordpieces(pieces: Iterable[str]) -> Automaton:
    """The automaton of pieces written with `##` where they go on with a word."""
    named = [p.removeprefix("##").encode() if p.startswith("##") and len(p) > 2 else _WORD_START + p.encode() for p in pieces if p]
    return build(named, _WORD_START)


def text_counts(automaton: Automaton, texts: list[bytes | None]) -> np.ndarray:
    """Words, tokens and unknown words of each text."""
    out = np.zeros((len(texts), 3), np.int64)
    held: list[bytes] = []
    docs: list[tuple[int, int]] = []
    size = 0

    def flush() -> None:
        if held:
            found, unknown = automaton.counts(held)
            doc = np.repeat([d for d, _ in docs], [n for _, n in docs])
            for k, weights in enumerate((np.ones(len(held)), found, unknown)):
                out[:, k] += np.bincount(doc, weights=weights, minlength=len(texts)).astype(np.int64)

    for d, text in enumerate(texts):
        tokens = text.split() if text else []
        for cut in range(0, len(tokens), _CHUNK_BYTES // 8):
            part = tokens[cut : cut + _CHUNK_BYTES // 8]
            held += part
            docs.append((d, len(part)))
            size += sum(map(len, part))
            if size > _CHUNK_BYTES:
                flush()
                held.clear()
                docs.clear()
                size = 0
    flush()
    return out


def token_counts(df: DataFrame, automaton: Automaton, text_col: str = "text") -> DataFrame:
    """Adds `n_words`, `n_tokens` and `n_unknown`, counts over the whole text.

    Words are what white space (U+0020, U+0009 to U+000D) separates. Null and empty texts
    have counts of 0. Columns with the names of the results are replaced. No row moves.
    """
    added = ["n_words", "n_tokens", "n_unknown"]
    rows = df.drop(*added)
    names = rows.columns
    # As large as the vocabulary file, whatever the data.
    held = df.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_counts(held.value, raw_texts(batch[text_col]))
            made = [pa.array(found[:, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *made], names=[*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, n_words long, n_tokens long, n_unknown long")
