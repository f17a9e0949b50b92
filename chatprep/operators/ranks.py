"""Global positions without a global sort in one task.

Two orders are needed. A shuffled order is the order of md5 hashes: its leading digits cut
any table into even buckets that are known in advance, whatever the data looks like. An
order by columns is cut by range partitioning; the bounds are sampled, so the frame is
written once to the shared folder before two passes look at it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.functions.hashing import hex_prefix, seeded_hash
from chatprep.sources.shared import pinned

_HEX_DIGITS = 4  # 65,536 buckets: 15 million rows each at a trillion rows
_FEW = 100_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _running_before(counts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over smaller keys; for tables of one row per bucket or partition."""
    before = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum(value).over(before), F.lit(0)).alias(out))


def shuffled_rank(df: DataFrame, keys: list[str], seed, rank: str = "rank", total: str = "total") -> DataFrame:
    """Adds `rank`, the 1-based position in the order of the seeded hash of the unique `keys`, and the row count.

    Rows move once, by hash bucket; the counts before each bucket come back by broadcast,
    one row per bucket.
    """
    h = seeded_hash(seed, *[F.col(c) for c in keys])
    hashed = df.withColumn("_h", h).withColumn("_bucket", hex_prefix(F.col("_h"), 1, _HEX_DIGITS))
    counts = df.select(hex_prefix(h, 1, _HEX_DIGITS).alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy()).alias(total),
    )
    numbered = hashed.withColumn("_i", F.row_number().over(W.partitionBy("_bucket").orderBy("_h", *keys)))
    joined = numbered.join(F.broadcast(offsets), "_bucket")
    return joined.withColumn(rank, F.col("_before") + F.col("_i")).drop("_h", "_bucket", "_before", "_i")


def smallest_hashes(df: DataFrame, h: Column, n_of_total) -> str | None:
    """The largest of the `n_of_total(row count)` smallest hashes; null for none.

    Counts by the leading digits say in which bucket the cut falls, and if that still holds
    many rows, counts by the next digits narrow it down: bounded tables reach the driver.
    """
    hashes = df.select(h.alias("h"))

    def counts(rows: DataFrame, start: int) -> list:
        prefix = F.substring("h", start, _HEX_DIGITS)
        return rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()

    first = counts(hashes, 1)
    left = n_of_total(sum(r["n"] for r in first))
    if left <= 0:
        return None
    prefix, level = "", first
    while True:
        for row in level:
            if left <= row["n"]:
                prefix += row["p"]
                break
            left -= row["n"]
        if row["n"] <= _FEW:
            break
        level = counts(hashes.filter(F.col("h").startswith(prefix)), 1 + len(prefix))
    tail = hashes.filter(F.col("h").startswith(prefix)).orderBy("h").limit(left)
    return tail.agg(F.max("h").alias("h")).first()["h"]


def range_ordered(df: DataFrame, order: list) -> DataFrame:
    """The frame cut by range of `order`, sorted within, pinned; adds `_part` and `_row`."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = pinned(spread.withColumn("_at", F.monotonically_increasing_id()))
    return marked.select(
        *df.columns,
        F.shiftright("_at", _ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def ordered_rank(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """Adds `rank`: 0-based position in the order of the unique `order` columns."""
    rows = range_ordered(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the cut.
    offsets = F.broadcast(_running_before(counts, "_part", "_n", "_before"))
    return rows.join(offsets, "_part").withColumn(rank, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def ordered_offset(df: DataFrame, order: list[str], size: str, offset: str = "offset") -> DataFrame:
    """Adds `offset`: sum of `size` over all rows earlier in the order of `order`."""
    rows = range_ordered(df, order)
    sums = rows.groupBy("_part").agg(F.sum(size).alias("_n"))
    offsets = F.broadcast(_running_before(sums, "_part", "_n", "_before"))
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return summed.join(offsets, "_part").withColumn(offset, F.col("_before") + F.col("_inside")).drop("_part", "_row", "_before", "_inside")


def grouped_offset(df: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """Adds `out`: sum of `value` over the group's rows that come earlier in `order`.

    Rows are cut by range of group and order, so a group of any size spreads over parts.
    At most one group reaches into a part from earlier ones, hence the sums carried into
    parts are no more rows than there are parts.
    """
    rows = range_ordered(df, [*group, *order])
    unit = ["_part", *group]
    inside = W.partitionBy(*unit).orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*unit).agg(F.sum(value).alias("_n"))
    carried = sums.select(*unit, F.sum("_n").over(earlier).alias("_carried")).filter("_carried IS NOT NULL")
    # Null is a group like any other.
    theirs = {c: f"_of_{i}" for i, c in enumerate(unit)}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(t)) for c, t in theirs.items()])
    joined = summed.join(F.broadcast(carried.withColumnsRenamed(theirs)), same, "left")
    return joined.withColumn(out, F.col("_inside") + F.coalesce("_carried", F.lit(0))).drop("_part", "_row", "_inside", "_carried", *theirs.values())
