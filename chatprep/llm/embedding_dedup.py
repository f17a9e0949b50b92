"""Near-duplicate embeddings: binary codes of rotated vectors decide which pairs are computed exactly."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.frames import matrix, usable_vector
from chatprep.llm.graph import Forest, components
from chatprep.sources.shared import stored

THRESHOLD = 0.93
SPREADS = 6.0
BLOCK_ROWS = 2048
ROTATION_SEED = 5
_STRIP = 256
_TILE = "cid long, links long, root long"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def rotated(rows: np.ndarray) -> np.ndarray:
    """Unit rows, filled up to a multiple of 64 dimensions, in the rotated frame."""
    dim = -(-rows.shape[1] // 64) * 64
    return (np.pad(unit(rows), ((0, 0), (0, dim - rows.shape[1]))) @ rotation(dim)).astype(np.float32)


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated vectors, packed, and the correction factor of each: its inner product with its code."""
    turned = rotated(rows)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with rotated ones (columns)."""
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    return (signs @ turned.T) / (np.sqrt(turned.shape[1]) * factors[:, None])


def least_estimate(factors: np.ndarray, dim: int, threshold: float, spreads: float) -> np.ndarray:
    """Below this estimate a pair's cosine is under the threshold, but for an error of `spreads` standard deviations.

    The error of an estimate is sqrt(1 - cos^2) * sqrt(1 - f^2) / f times a coordinate of a
    random direction, whose deviation is 1 / sqrt(dim - 1); cos is at least the threshold
    for the pairs that matter.
    """
    spread = np.sqrt(np.maximum(0.0, 1 - factors**2)) / factors / np.sqrt(dim - 1)
    return threshold - spreads * np.sqrt(max(0.0, 1 - threshold**2)) * spread - 1e-5


def tile_links(left: dict, right: dict, same: bool, threshold: float, spreads: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) with cosine >= threshold in double precision."""
    turned = rotated(right["vec"])
    least = least_estimate(left["factor"], turned.shape[1], threshold, spreads)
    units = unit(left["vec"]), unit(right["vec"])
    found = []
    for at in range(0, len(least), _STRIP):
        rows = slice(at, at + _STRIP)
        maybe = estimates(left["code"][rows], left["factor"][rows], turned) >= least[rows, None]
        i, j = np.nonzero(maybe)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):
            a, b = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            cosine = np.einsum("ij,ij->i", units[0][a], units[1][b])
            found.append((a[cosine >= threshold], b[cosine >= threshold]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, spreads: float = SPREADS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows `(id, n_links, component_id, kept)`, one per id.

    Vectors with equal labels and dimensions are compared, block by block, every two blocks
    of a label in a task of their own. A vector's code is the sign bits of a random
    rotation, kept with a correction factor that makes the estimate of an inner product
    unbiased; its confidence bound decides which pairs are computed exactly. At 6 spreads
    the bound misses a link less than once in 10^8. Equal vectors of a label stand as one,
    with a count; tasks give counts and forests, never pairs.

    Left out are rows without an id; rows that repeat an id count once, with the smallest
    label and vector. Null labels, null or zero vectors and those with null or non-finite
    components link with nothing. An empty table gives an empty one.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    single = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x"))
    vectors = stored(single.select("id", "x.label", "x.vec"), "vectors")
    some = F.exists("vec", lambda x: x != 0)
    usable = vectors.filter(F.col("label").isNotNull() & usable_vector(F.col("vec")) & some)
    classes = usable.groupBy("label", "vec").agg(F.min("id").alias("cid"), F.count("*").alias("n"))
    kind = dict(vectors.dtypes)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                yield _coded(batch)

    schema = f"label {kind['label']}, vec {kind['vec']}, cid long, n long, dim int, code binary, factor double"
    codes = stored(classes.mapInArrow(coded, schema), "codes")
    blocks = codes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    meets = codes.join(blocks, ["label", "dim"]).withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = meets.select("label", "dim", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", "vec", "cid", "n", "code", "factor")

    def linked(table: pa.Table) -> pa.Table:
        return _linked(table, threshold, spreads)

    linked_rows = stored(tiles.groupBy("label", "dim", "i", "j").applyInArrow(linked, _TILE), "links")
    joined = components(linked_rows.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = linked_rows.groupBy("cid").agg(F.sum("links").alias("links"))
    named = codes.select("label", "vec", "cid", "n").join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    results = named.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    of_rows = usable.join(results, ["label", "vec"]).select("id", "n_links", "component_id")
    out = vectors.select("id").join(of_rows, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def _coded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds dimension, code and correction factor; rows of one dimension are coded together."""
    dims = np.diff(batch["vec"].offsets.to_numpy())
    codes, factors = [b""] * batch.num_rows, np.zeros(batch.num_rows)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        bits, factor = encode(matrix(batch["vec"].take(pa.array(at))))
        factors[at] = factor
        for i, row in zip(at, bits):
            codes[i] = row.tobytes()
    columns = [batch["label"], batch["vec"], batch["cid"], batch["n"], pa.array(dims, pa.int32()), pa.array(codes, pa.binary()), pa.array(factors, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["label", "vec", "cid", "n", "dim", "code", "factor"])


def _linked(table: pa.Table, threshold: float, spreads: float) -> pa.Table:
    """Of one tile: links of each class, counted by members, and the class that stands for its group."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    part, cid, n = table["s"].to_numpy(), table["cid"].to_numpy(), table["n"].to_numpy()
    code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(cid), -1)
    rows = {"vec": matrix(table["vec"]), "code": code, "factor": table["factor"].to_numpy()}
    at, to = np.flatnonzero(part == i), np.flatnonzero(part == j)
    links, forest = np.zeros(len(cid), np.int64), Forest(len(cid))
    if len(at) and len(to):
        a, b = tile_links({k: v[at] for k, v in rows.items()}, {k: v[to] for k, v in rows.items()}, i == j, threshold, spreads)
        a, b = at[a], to[b]
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        forest.join(a, b)
    some = np.flatnonzero(links)
    return pa.table({"cid": cid[some], "links": links[some], "root": cid[forest.roots()[some]]})
