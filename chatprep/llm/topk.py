"""Exact top-k by inner product: tiles of queries and shards, then a tree of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.frames import matrix, usable_vector
from chatprep.sources.shared import stored

TILE_ROWS = 4096
FAN_IN = 64
_STRIP = 256
_LONG = (1 << 63) - 1
_TOP = "query_id long, part int, top array<struct<minus: long, vec_id: long>>"


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Rows `(query_id, rank, vec_id, score)`: for every query its `k` other vectors of highest score, ties to the smaller id.

    Vectors are turned into integers, `floor(scale * x)`, and scores are their exact inner
    products. Both sides are dealt into pieces of about `tile_rows`; each pair of pieces is
    one task's matrix product, of which each query's `k` best are kept, and those lists meet
    `FAN_IN` at a time. What moves is (pieces of one side) x (rows of the other).

    Left out: null ids, null vectors, vectors with null or non-finite components. Rows that
    repeat an id count once, with the smallest vector. A shorter vector counts as filled up
    with zeros. Scores beyond a long count as the nearest long.
    An empty table, or a query without any other vector, gives no rows.
    """
    marked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    usable = marked.filter(F.col("id").isNotNull() & usable_vector(F.col("vec")))
    vectors = stored(usable.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")), "vectors")
    n, asked = vectors.agg(F.count("*"), F.count_if("asks")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked // tile_rows))
    shards = max(1, -(-n // tile_rows), min(-(-8 * cores // blocks), -(-n // _STRIP)))

    def dealt(rows: DataFrame, seed: int, own: int, other: int, tile: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return rows.select("id", "vec", mine.alias("mine")).select("*", each.alias("other")).select(tile.alias("tile"), F.col("id").alias("id"), F.col("vec").alias("vec"))

    asking = dealt(vectors.filter("asks"), 1, blocks, shards, F.expr(f"mine * {shards} + other"))
    others = dealt(vectors, 2, shards, blocks, F.expr(f"other * {shards} + mine"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        # A side without rows can come without its columns.
        if not all(side.num_rows and "id" in side.schema.names for side in (left, right)):
            return _tops([], [], 0)
        return best_of_tile(left, right, k, scale, left["tile"][0].as_py() % shards)

    tops = asking.groupBy("tile").cogroup(others.groupBy("tile")).applyInArrow(tile, _TOP)
    parts = shards
    while True:
        parts = -(-parts // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        tops = tops.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("query_id", "part").agg(merged.alias("top"))
        if parts == 1:
            break
    ranked = tops.select("query_id", F.posexplode("top").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", (-F.col("one.minus")).alias("score"))


def best_of_tile(left: pa.Table, right: pa.Table, k: int, scale: float, part: int) -> pa.Table:
    """One row per query of the tile: its `k` best of the tile's other rows."""
    asks, ids = left["id"].to_numpy(), right["id"].to_numpy()
    order = np.argsort(ids)  # so that the earlier of two equal scores has the smaller id
    ids = ids[order]
    width = max((matrix(t["vec"]).shape[1] for t in (left, right)), default=0)
    queries, others = (_integers(_wide(matrix(t["vec"]), width), scale) for t in (left, right))
    others = others[order]
    keys, lists = [], []
    for start in range(0, len(asks), _STRIP):
        strip = asks[start : start + _STRIP]
        for ask, scores, found in zip(strip, *_strip_best(queries[start : start + _STRIP], others, strip, ids, k)):
            if len(found):
                keys.append(ask)
                lists.append([{"minus": -int(s), "vec_id": int(i)} for s, i in zip(scores, found)])
    return _tops(keys, lists, part)


def _tops(keys: list, lists: list, part: int) -> pa.Table:
    kind = pa.list_(pa.struct([("minus", pa.int64()), ("vec_id", pa.int64())]))
    return pa.table({"query_id": pa.array(keys, pa.int64()), "part": pa.array([part] * len(keys), pa.int32()), "top": pa.array(lists, kind)})


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _integers(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): doubles while sums of products are sure to be exact, else Python's integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * rows)
    if np.abs(whole).max(initial=0.0) ** 2 * max(1, rows.shape[1]) < 2.0**46:
        return whole
    exact = [[int(y) if np.isfinite(y) else int(scale) * int(x) for x, y in zip(a, b)] for a, b in zip(rows, whole)]
    return np.array(exact, dtype=object).reshape(rows.shape)


def _strip_best(queries, others, asks, ids, k):
    """Scores and ids of the best `k`, per query: a partial selection, then a sort of what it kept."""
    if queries.dtype == object or others.dtype == object:
        scores = np.clip(queries.astype(object) @ others.astype(object).T, -_LONG, _LONG)
    else:
        scores = (queries @ others.T).astype(np.int64)
    own = asks[:, None] == ids[None, :]
    bits = max(1, len(ids)).bit_length()
    # Score (below 2**46, or Python's integers) and position in one number, so that selection heeds ties.
    ranked = scores * (1 << bits) + (np.arange(len(ids))[::-1] + 1)
    low = -(1 << 62) if ranked.dtype != object else min([0, *ranked.flat]) - 1
    ranked[own] = low
    m = min(k, len(ids))
    if ranked.dtype == object:
        best = np.array([sorted(range(len(ids)), key=row.__getitem__, reverse=True)[:m] for row in ranked], dtype=int).reshape(len(asks), m)
    else:
        best = np.argpartition(ranked, len(ids) - m, axis=1)[:, len(ids) - m :] if m else np.zeros((len(asks), 0), int)
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(ranked, best, 1), axis=1), 1)
    kept = [row[~mine[row]] for row, mine in zip(best, own)]
    return [s[row] for s, row in zip(scores, kept)], [ids[row] for row in kept]
