"""Pooling, projecting and padding embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.constants import N_SPECIAL
from chatprep.sources.shared import stored

# A task stacks factors of this many squared doubles: 128 MB each.
MAX_DIM = 4096
_STACKED = 4
_ITERATIONS, _WIDER, _SEED = 6, 16, 5


def mean_vectors(df: DataFrame, key: str, vec: str, weight: str | None = None) -> DataFrame:
    """`(key, vec)`: component-wise mean per key, one partial mean per key and task shuffled."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    mean = Summarizer.mean(v, F.col(weight)) if weight else Summarizer.mean(v)
    return df.groupBy(key).agg(vector_to_array(mean).alias("vec"))


def pool_embeddings(pieces: DataFrame, source: DataFrame, vocab: DataFrame, dim: int) -> DataFrame:
    """`(id, vec)` for every vocabulary id: the mean vector of its pieces, zeros where it has none.

    `pieces` is `(id, piece_pos, source_id)`, `source` is `(source_id, vec)`. A piece a
    character uses twice counts twice, through its weight. Special ids are always zeros.
    """
    of_characters = pieces.filter(F.col("id") >= N_SPECIAL)
    weighted = of_characters.groupBy("id", "source_id").agg(F.count("*").cast("double").alias("weight"))
    pooled = mean_vectors(weighted.join(source, "source_id"), "id", "vec", "weight")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return vocab.select("id").join(pooled, "id", "left").select("id", F.coalesce("vec", zeros).alias("vec"))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(-1, dim)


def _factor(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, as many rows as the matrix has rank at most."""
    return np.linalg.qr(rows, mode="r")


def _factor_rows(part: int, factor: np.ndarray) -> pa.Table:
    return pa.table({
        "part": pa.array([part] * len(factor), pa.int64()),
        "i": pa.array(range(len(factor)), pa.int32()),
        "row": pa.array(list(factor), pa.list_(pa.float64())),
    })


_FACTORS = "part long, i int, row array<double>"


def triangular_factor(matrix: DataFrame, vec: str, dim: int) -> np.ndarray:
    """R of the matrix's QR decomposition: its singular values and right vectors are the matrix's own.

    Every task factors its rows a batch at a time, keeping `dim` rows; factors are then stacked
    and factored again, `_STACKED` at a time, until one is left. No product of the matrix with
    itself is formed, so small singular values are not lost in the square of the large ones.
    """

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, dim))
        for batch in batches:
            rows = _matrix(batch.column(0), dim)
            step = max(dim, 1024)
            for at in range(0, len(rows), step):
                factor = _factor(np.vstack([factor, rows[at : at + step]]))
        if len(factor):
            yield from _factor_rows(TaskContext.get().partitionId(), factor).to_batches()

    def stacked(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("i", "ascending")])
        return _factor_rows(table["part"][0].as_py() // _STACKED, _factor(_matrix(table["row"], dim)))

    factors = stored(matrix.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(of_task, _FACTORS), "factors")
    while (factors.agg(F.max("part")).first()[0] or 0) > 0:
        factors = stored(factors.groupBy(F.expr(f"part div {_STACKED}").alias("stack")).applyInArrow(stacked, _FACTORS), "factors")
    rows = factors.orderBy("i").select("row").collect()
    return np.array([r["row"] for r in rows]).reshape(-1, dim)


def _broad_product(matrix: DataFrame, vec: str, x: np.ndarray) -> np.ndarray:
    """A'(A x): tasks send a row for each of the matrix's dimensions, the driver gets as many."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(x)
        for batch in batches:
            rows = _matrix(batch.column(0), len(x))
            total += rows.T @ (rows @ x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(x)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = matrix.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(partial, "i int, row array<double>")
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    return np.array([r["row"] for r in summed.orderBy("i").collect()])


def right_vectors(matrix: DataFrame, vec: str, dim: int, k: int, max_dim: int = MAX_DIM) -> np.ndarray:
    """The first `k` right singular vectors as columns.

    Up to `max_dim` dimensions they are those of the triangular factor. Beyond, a factor would
    be too large for a task: they are looked for in the space that a random start comes to
    after `_ITERATIONS` products with A'A, a little wider than asked for.
    """
    if dim <= max_dim:
        return np.linalg.svd(triangular_factor(matrix, vec, dim))[2][:k].T
    width = min(dim, k + _WIDER)
    space = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, width)))[0]
    for _ in range(_ITERATIONS):
        space = np.linalg.qr(_broad_product(matrix, vec, space))[0]
    within = triangular_factor(matrix.select(_times(F.col(vec), space).alias("v")), "v", width)
    return space @ np.linalg.svd(within)[2][:k].T


def _times(vec: Column, x: np.ndarray) -> Column:
    """The row of a matrix times `x`."""

    @F.pandas_udf("array<double>")
    def product(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()) @ x)) if len(rows) else pd.Series([], dtype=object)

    return product(vec.cast("array<double>"))


def svd_project(matrix: DataFrame, key: str, vec: str, target_dim: int, max_dim: int = MAX_DIM) -> DataFrame:
    """`(key, vec)`: rows of U*S of the uncentred matrix's thin SVD, first `target_dim` columns.

    U*S is A*V, and V comes from a tree of triangular factors (`right_vectors`); its columns'
    signs are arbitrary. Never more columns than the matrix has rows or dimensions. Rows must
    all have the same number of dimensions, and none may be null.
    """
    n, known, least, dim = matrix.agg(F.count("*"), F.count(vec), F.min(F.size(vec)), F.max(F.size(vec))).first()
    if not n:
        return matrix.select(key, F.col(vec).cast("array<double>").alias("vec"))
    if known != n or least != dim:
        raise ValueError(f"a matrix needs rows of one size: {n - known} of {n} are null, sizes {least} to {dim}")
    v = right_vectors(matrix, vec, dim, min(target_dim, n, dim), max_dim)
    return matrix.select(key, _times(F.col(vec), v).alias("vec"))


def pad_dims(vectors: DataFrame, target_dim: int, vec: str = "vec") -> DataFrame:
    """Zero columns on the right up to `target_dim`."""
    missing = F.greatest(F.lit(target_dim) - F.size(vec), F.lit(0))
    filled = F.concat(F.col(vec).cast("array<double>"), F.array_repeat(F.lit(0.0), missing))
    return vectors.withColumn(vec, filled)


def assert_embedding_shape(matrix: DataFrame, n_rows: int, dim: int, vec: str = "vec") -> None:
    """Raises unless the matrix is `n_rows` by `dim`."""
    found = matrix.agg(F.count("*").alias("n"), F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if (found["n"], found["lo"], found["hi"]) != (n_rows, dim, dim):
        raise ValueError(f"embedding matrix is {found['n']} x [{found['lo']}, {found['hi']}], expected {n_rows} x {dim}")
