"""Connected components: forests inside a task, alternating stars across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.sources.shared import pinned

_MAX_ROUNDS = 100


class Forest:
    """Union-find over the rows of one task; edges come in arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        """The smallest row joined with each row."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every edge hangs the larger root under the smaller; those that lose to another edge go again."""
        while a.size:
            roots = self.roots()
            x, y = roots[a], roots[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.parent, high, low)


def components(edges: DataFrame) -> DataFrame:
    """Rows `(node, component)` for every node of the edges `(a, b)`: the smallest node reachable.

    Large stars and small stars take turns until nothing changes. A node's neighbours are
    never listed: their minimum is a combinable aggregate that meets the edges again in a
    join, which adaptive execution splits where one node has many edges. Each round is
    checkpointed in the shared folder.
    """
    stars = pinned(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(stars)
    for _ in range(_MAX_ROUNDS):
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # The smaller end of an edge tells the larger one of the smallest it knows.
        down = stars.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = down.join(low, "u").filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        turned = moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        stars = pinned(turned.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    centres = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres.select("node", "node"))


def _mark(stars: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
