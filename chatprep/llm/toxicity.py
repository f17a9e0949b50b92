"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.frames import raw_texts
from chatprep.llm.hashed import Chunk, buckets, chunks
from chatprep.llm.sampling import labelled_sample

BITS = 21
GRAMS = (5, 6, 7)
GRADES = 3  # above 0
MAX_ROWS = 6000
MAX_BYTES = 32 << 20
MIN_TEXTS = 3
MIN_Z = 3.5
MAX_FEATURES = 20_000
STEPS = 600
RATE = 0.1
SHRINK = 1e-5


@dataclass
class Model:
    """P(grade <= k) = logistic(thresholds[k] - weights . x): one set of weights, ordered thresholds."""

    ids: np.ndarray  # buckets that have a weight, sorted
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def known(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features of the model that occur in each text: `(text, feature)`, each once."""
        member = np.zeros(1 << self.bits, bool)
        member[self.ids] = True
        found = [np.zeros(0, np.int64)]
        for chunk in chunks(texts):
            for ids, doc in features(chunk, self.bits):
                hit = member[ids]
                found.append(doc[hit] * (1 << self.bits) + ids[hit])
        pairs = np.unique(np.concatenate(found))
        return pairs >> self.bits, np.searchsorted(self.ids, pairs & ((1 << self.bits) - 1))

    def above(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade > k) for each k, a row per text."""
        doc, at = self.known(texts)
        line = np.bincount(doc, weights=self.weights[at], minlength=len(texts)) if len(at) else np.zeros(len(texts))
        return _logistic(line[:, None] - self.thresholds[None, :])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(chunk: Chunk, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and the text of each: words and character n-grams, word edges included."""
    yield buckets(chunk.word_hashes(), 1, bits), chunk.doc
    for n in GRAMS:
        g, doc = chunk.grams(n)
        yield buckets(g, n, bits), doc


def present(texts: list[bytes], bits: int) -> Iterator[np.ndarray]:
    """Distinct buckets of each text."""
    for text in texts:
        found = [ids for chunk in chunks([text]) for ids, _ in features(chunk, bits)]
        yield np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def telling(texts: list[bytes], flags: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets more frequent among flagged texts than among others, and by how much, as log odds.

    Kept are those in at least `MIN_TEXTS` texts whose log odds are `MIN_Z` deviations above
    none, the `MAX_FEATURES` clearest at most. What speaks against a flag is not kept: it
    would let a harmless context excuse an insult.
    """
    counts = np.zeros((2, 1 << bits), np.int32)
    for ids, flag in zip(present(texts, bits), flags):
        counts[int(flag), ids] += 1
    some = np.flatnonzero(counts.sum(axis=0) >= MIN_TEXTS)
    n = np.array([max(1, (flags == 0).sum()), max(1, (flags == 1).sum())])
    a, b = counts[1, some] + 0.5, counts[0, some] + 0.5
    odds = np.log(a / (n[1] + 1 - a + 0.5)) - np.log(b / (n[0] + 1 - b + 0.5))
    z = odds / np.sqrt(1 / a + 1 / b)
    order = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    order = np.sort(order[z[order] >= MIN_Z])
    return some[order], odds[order]


def fit(texts: list[bytes], grades: list[int] | np.ndarray, bits: int = BITS) -> Model:
    """Weights and thresholds of largest likelihood, shrunk, by Adam over all texts at once.

    Grades are 0, 1, ...; if they do not differ, no feature has a weight and the thresholds
    say that grade.
    """
    y = np.array(grades, dtype=np.int64)
    top = int(y.max(initial=0))
    n_thresholds = max(1, top)
    share = np.array([(np.sum(y <= k) + 0.5) / (len(y) + 1) for k in range(n_thresholds)])
    thresholds = np.log(share / (1 - share))
    ids, _ = telling(texts, (y > 0).astype(int), bits)
    model = Model(ids, np.zeros(len(ids)), thresholds, bits)
    if not len(ids) or len(np.unique(y)) < 2:
        return model
    doc, at = model.known(texts)
    first, gaps = thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-2))
    flat = np.concatenate([model.weights, first, gaps])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, STEPS + 1):
        slope = _slope(flat, len(ids), doc, at, y)
        mean += 0.1 * (slope - mean)
        square += 0.001 * (slope * slope - square)
        flat -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights, thresholds = _unpacked(flat, len(ids))
    return Model(ids, weights, thresholds, bits)


def _unpacked(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; a threshold is the one before plus the exponential of its gap, so they stay in order."""
    return flat[:n], flat[n] + np.concatenate([[0.0], np.cumsum(np.exp(flat[n + 1 :]))])


def _slope(flat: np.ndarray, n: int, doc: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the mean negative log likelihood plus the penalty on weights."""
    weights, thresholds = _unpacked(flat, n)
    line = np.bincount(doc, weights=weights[at], minlength=len(y))
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    low, high = _logistic(edges[y] - line), _logistic(edges[y + 1] - line)
    inside = np.maximum(high - low, 1e-12)
    d_low, d_high = low * (1 - low) / inside, high * (1 - high) / inside
    d_line = (d_high - d_low) / len(y)
    by_edge = np.zeros(len(thresholds) + 2)
    np.add.at(by_edge, y, d_low / len(y))
    np.add.at(by_edge, y + 1, -d_high / len(y))
    d_threshold = by_edge[1:-1]
    after = np.cumsum(d_threshold[::-1])[::-1]
    d_gaps = after[1:] * np.exp(flat[n + 1 :])
    return np.concatenate([np.bincount(at, weights=d_line[doc], minlength=n) + SHRINK * weights, [after[0]], d_gaps])


def graded(texts: list[bytes], flags: list[int], grades: int = GRADES, bits: int = BITS) -> np.ndarray:
    """Severity grades for texts that are only flagged: 0, or 1 to `grades` by how many typical features a flagged text has.

    Equal parts of the flagged texts get each grade.
    """
    y = np.array(flags, dtype=np.int64)
    ids, _ = telling(texts, y, bits)
    hot = np.flatnonzero(y > 0)
    amount = np.zeros(len(hot))
    for i, found in enumerate(present([texts[k] for k in hot], bits)):
        amount[i] = np.isin(found, ids, assume_unique=True).sum()
    order = np.argsort(amount, kind="stable")
    out = np.zeros(len(y), np.int64)
    out[hot[order]] = 1 + np.arange(len(hot)) * grades // max(1, len(hot))
    return out


def train(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", wanted: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, grades: int = GRADES) -> Model:
    """A model of at most `max_rows` labelled rows and `max_bytes` of their texts.

    Labels above 1 are taken as grades; labels 0 and 1 are a flag, for which grades are made.
    """
    sample = labelled_sample(df, labels, label_col, id_col, text_col, max_rows, max_bytes, wanted)
    texts, y = [t for _, t, _ in sample], [max(0, int(v)) for _, _, v in sample]
    return fit(texts, graded(texts, y, grades) if max(y, default=0) <= 1 else y)


def with_severity(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds `severity` (the expected grade), `grade` (the grade most likely by halves) and `toxic_probability`, P(grade > 0).

    `grade` is the number of thresholds that are passed with a probability of a half or
    more. Whole texts are scored; null and empty ones as texts without features. Columns
    with the names of the results are replaced. No row moves.
    """
    added = ["severity", "grade", "toxic_probability"]
    rows = df.drop(*added)
    names = rows.columns
    # At most MAX_FEATURES weights.
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = held.value.above(raw_texts(batch[text_col]))
            made = [above.sum(axis=1), (above >= 0.5).sum(axis=1).astype(np.int32), above[:, 0]]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *map(pa.array, made)], names=[*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, severity double, grade int, toxic_probability double")
