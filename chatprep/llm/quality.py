"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.frames import raw_texts, remainder_of_id
from chatprep.llm.hashed import Chunk, buckets, chunks
from chatprep.llm.sampling import labelled_sample

BITS = 18
DIM = 8
GRAMS = (2, 3, 4)
EPOCHS = 8
RATE = 0.4
SEED = 3
MAX_ROWS = 3000
MAX_BYTES = 24 << 20
HOLD_OUT = 3
HELD = 1
_REPEATED, _END = 0, 1  # feature of a word that repeats the one before it; of the end of a text


@dataclass
class Model:
    """Scores of each bucket for each class: the class vectors times the bucket's vector.

    The average of vectors and the product with the class vectors are linear, so this table
    scores texts as the vectors would.
    """

    logits: np.ndarray
    classes: np.ndarray

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Softmax over the classes, a row per text; words, n-grams and the end of a text weigh alike."""
        sums = np.tile(self.logits[_END], (len(texts), 1)).astype(np.float64)
        counts = np.ones(len(texts))
        bits = int(self.logits.shape[0] - 1).bit_length()
        for chunk in chunks(texts):
            for ids, doc in features(chunk, bits):
                counts += np.bincount(doc, minlength=len(texts))
                for k in range(sums.shape[1]):
                    sums[:, k] += np.bincount(doc, weights=self.logits[ids, k], minlength=len(texts))
        z = sums / counts[:, None]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def features(chunk: Chunk, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and the text of each: words, character n-grams, and one shared bucket for words that repeat."""
    h = chunk.word_hashes()
    yield np.maximum(buckets(h, 1, bits), 2), chunk.doc
    again = np.flatnonzero((h[1:] == h[:-1]) & ~chunk.first[1:]) + 1
    yield np.full(len(again), _REPEATED), chunk.doc[again]
    for n in GRAMS:
        g, doc = chunk.grams(n)
        yield np.maximum(buckets(g, n, bits), 2), doc


def fit(texts: list[bytes], labels: list, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over texts, one at a time, the rate falling to zero.

    Without texts, or with a single class, the scores are those of the labels seen: even,
    or all for that class; two classes 0 and 1 are assumed if there are none.
    """
    classes, y = np.unique(np.array(labels, dtype=np.int64), return_inverse=True) if labels else (np.array([0, 1]), np.zeros(0, int))
    if len(classes) < 2:
        return Model(np.zeros((1 << bits, max(2, len(classes)))), np.array([0, 1]) if not len(classes) else np.array([classes[0], classes[0]]))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    heads = np.zeros((len(classes), dim), np.float32)
    rows = [bag(t, bits) for t in texts]
    # Rare classes get as much weight as frequent ones.
    weight = len(y) / (len(classes) * np.bincount(y))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            hidden = share @ vectors[ids]
            z = heads @ hidden
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[y[i]] -= 1
            step = rate * (1 - done / steps) * min(4.0, weight[y[i]])
            back = heads.T @ error
            heads -= (step * error[:, None] * hidden[None, :]).astype(np.float32)
            vectors[ids] -= (step * share[:, None] * back[None, :] * len(ids) ** 0.5).astype(np.float32)
            done += 1
    return Model((vectors @ heads.T).astype(np.float32), classes)


def bag(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found = [np.array([_END])]
    for chunk in chunks([text]):
        found += [ids for ids, _ in features(chunk, bits)]
    ids, counts = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", wanted: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model of at most `max_rows` labelled rows and `max_bytes` of their texts; `wanted` says which rows may be learned from."""
    sample = labelled_sample(df, labels, label_col, id_col, text_col, max_rows, max_bytes, wanted)
    return fit([t for _, t, _ in sample], [y for _, _, y in sample])


def with_scores(df: DataFrame, model: Model, text_col: str = "text", score: str = "score", positive: int = 1) -> DataFrame:
    """Adds `score`, the probability of class `positive`, from the whole text and nothing else.

    Null and empty texts are scored by the end of text alone. A column named like the score
    is replaced. No row moves.
    """
    rows = df.drop(score)
    names = rows.columns
    # The table of a model has a size fixed by its bits.
    table = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        at = np.flatnonzero(model.classes == positive)
        for batch in batches:
            found = model.scores(raw_texts(batch[text_col]))[:, at].sum(axis=1)
            if len(set(model.classes.tolist())) == 1:  # nothing but this class was seen
                found = np.full(batch.num_rows, float(len(at) > 0))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(found, pa.float64())], names=[*names, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{score}` double")


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return remainder_of_id(id_col, HOLD_OUT) != HELD


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with `held_out`, `score` and `predicted`, by a model trained here on rows not held out."""
    # What is not marked 1 counts against it, whatever else a label may be.
    marked = labels.withColumn("quality", (F.col("quality") == 1).cast("int"))
    model = train(df, marked, id_col=id_col, text_col=text_col, wanted=learnable(id_col))
    scored = with_scores(df.drop("held_out", "predicted"), model, text_col)
    return scored.withColumn("held_out", ~learnable(id_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
