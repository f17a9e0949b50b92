"""Rows joined in order and cut into blocks, moving what they hold once.

The rows are cut by range of their order and kept. Lengths alone then say, a row per part,
at which row, group and id a part begins. Each part joins and cuts its rows as they stand:
blocks that lie in one part are done there, and only the pieces at a part's ends, of which
there are two, travel to meet those of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.operators.ranks import range_ordered
from chatprep.sources.shared import stored

_BATCH_UNITS = 1 << 21  # ids or characters of a batch of blocks


def _parts(rows: DataFrame, n: Column, rows_per_group: int | None, unit: list[str] | None) -> DataFrame:
    """`(_part, _rank, _carried)`: the number of a part's first unit, and how many ids of its group come before it.

    Made of the length and the unit of every row, read once; what follows is a row per unit
    and part, and then a row per part.
    """
    named = {c: f"_u{i}" for i, c in enumerate(unit or [])}
    keys = list(named.values()) or ["_row"]
    slim = rows.select("_part", "_row", n.cast("bigint").alias("_n"), *[F.col(c).alias(u) for c, u in named.items()])
    met = slim.groupBy("_part", *keys).agg(F.sum("_n").alias("_n"), F.min("_row").alias("_first"))
    one = F.struct(*keys)
    # A unit that two parts share counts in the first of them. Rows are never shared.
    ends = met.groupBy("_part").agg(F.count("*").alias("_units"), F.min_by(one, "_first").alias("_head"), F.max_by(one, "_first").alias("_tail"))
    by_part = W.orderBy("_part")
    shared = F.coalesce((F.col("_head") == F.lag("_tail").over(by_part)).cast("int"), F.lit(0)) if unit else F.lit(0)
    counted = ends.withColumn("_shared", shared)
    before = F.coalesce(F.sum(F.col("_units") - F.col("_shared")).over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counted.select("_part", (before - F.col("_shared")).alias("_rank")), "part-ranks")
    if rows_per_group is None:
        sums = slim.groupBy("_part").agg(F.sum("_n").alias("_n")).withColumn("_group", F.lit(0).cast("bigint"))
    else:
        inside = F.row_number().over(W.partitionBy("_part").orderBy("_first")) - 1
        ranked = met.withColumn("_inside", inside).join(F.broadcast(starts), "_part")
        group = F.expr(f"(_rank + _inside) div {rows_per_group}L")
        sums = ranked.groupBy("_part", group.alias("_group")).agg(F.sum("_n").alias("_n"))
    earlier = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.withColumn("_carried", F.sum("_n").over(earlier)).filter("_carried IS NOT NULL").select("_part", "_carried")
    return stored(starts.join(carried, "_part", "left").select("_part", "_rank", F.coalesce("_carried", F.lit(0)).alias("_carried")), "part-starts")


class _Blocks:
    """Cuts the rows of one part. `held` is what has been said of a block not yet full, which began at id `at` of its group."""

    def __init__(self, max_len: int, text: bool):
        self.max_len, self.text = max_len, text
        self.group, self.at, self.held = None, 0, []
        self.out: list[tuple] = []  # group, at, whole, pieces
        self.size = 0

    def _emit(self, at: int, whole: bool, pieces: list, length: int) -> None:
        self.out.append((self.group, at, whole, pieces))
        self.size += length

    def begin(self, group: int, offset: int) -> None:
        self.group, self.at, self.held, self.length = group, offset, [], 0

    def add(self, values) -> None:
        """More ids of the group at hand."""
        begin = 0
        while begin < len(values):
            room = self.max_len - self.at % self.max_len - self.length
            piece = values[begin : begin + room]
            self.held.append(piece)
            self.length += len(piece)
            begin += len(piece)
            if len(piece) == room:
                # Without the beginning of the block it is a piece like any other.
                self._emit(self.at, self.at % self.max_len == 0, self.held, self.length)
                self.at, self.held, self.length = self.at + self.length, [], 0

    def end(self, known: bool) -> None:
        """No more of the group in this part; `known`: nor in any other."""
        if self.group is not None and self.length:
            complete = known and self.at % self.max_len == 0
            # What does not fill a block is left out, unless it is all there is.
            if not complete or self.at == 0:
                self._emit(self.at, complete, self.held, self.length)
        self.held, self.length = [], 0

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        done, self.out, self.size = self.out, [], 0
        if self.text:
            parts = pa.array(["".join(d[3]) for d in done], pa.string())
        else:
            lengths = [sum(map(len, d[3])) for d in done]
            values = np.concatenate([np.zeros(0, np.int32), *(piece for d in done for piece in d[3])])
            parts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values, pa.int32()))
        groups, at, whole = ([d[i] for d in done] for i in range(3))
        blocks = [a // self.max_len for a in at]
        columns = [pa.array(groups, pa.int64()), pa.array(blocks, pa.int64()), pa.array(at, pa.int64()), pa.array(whole, pa.bool_()), parts]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _joined(batch: pa.RecordBatch, text: bool) -> tuple[object, np.ndarray]:
    """The values of all rows one after the other, and where each row's end."""
    column = batch["_values"]
    if text:
        texts = [t or "" for t in column.to_pylist()]
        return "".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
    lengths = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(lengths)


def _assembled(rows: DataFrame, max_len: int, rows_per_group: int | None, n_unit: int, text: bool) -> DataFrame:
    kind = "string" if text else "array<int>"
    schema = pa.schema([("group_id", pa.int64()), ("block_id", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("part", pa.string() if text else pa.list_(pa.int32()))])
    units = [f"_u{i}" for i in range(n_unit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(max_len, text)
        rank, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, ends = _joined(batch, text)
            new = np.ones(batch.num_rows, bool)
            if units:
                named = list(zip(*(batch[u].to_pylist() for u in units)))
                new[0] = last is not None and named[0] != last
                new[1:] = [a != b for a, b in zip(named[1:], named)]
                last = named[-1]
            elif rank is None:
                new[0] = False
            if rank is None:
                rank, carried = batch["_rank"][0].as_py(), batch["_carried"][0].as_py()
            ranks = rank + np.cumsum(new)
            rank = int(ranks[-1])
            groups = ranks // rows_per_group if rows_per_group else np.zeros_like(ranks)
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)]):
                group = int(groups[a])
                if group != blocks.group:
                    offset = carried if blocks.group is None else 0
                    blocks.end(known=True)
                    blocks.begin(group, offset)
                blocks.add(values[int(ends[a - 1]) if a else 0 : int(ends[b - 1])])
                if blocks.size >= _BATCH_UNITS:
                    yield blocks.batch(schema)
        blocks.end(known=False)
        if blocks.out:
            yield blocks.batch(schema)

    return rows.mapInArrow(run, f"group_id long, block_id long, at long, whole boolean, part {kind}")


def packed(df: DataFrame, order: list[str], values: Column, n: Column, max_len: int, rows_per_group: int | None, unit: list[str] | None, text: bool) -> DataFrame:
    """`(group_id, block_id, part)`: blocks of `values`, lists of ids or texts of which `n` says the length."""
    rows = range_ordered(df, order)
    starts = F.broadcast(_parts(rows, n, rows_per_group, unit))
    named = [F.col(c).alias(f"_u{i}") for i, c in enumerate(unit or [])]
    # A broadcast join leaves the rows of a part where and as they are.
    begun = rows.join(starts, "_part").select("_rank", "_carried", *named, values.alias("_values"))
    made = stored(_assembled(begun, max_len, rows_per_group, len(named), text), "blocks")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])
    joined = F.array_join(pieces, "") if text else F.flatten(pieces)
    size = F.length if text else F.size
    edges = made.filter("NOT whole").groupBy("group_id", "block_id").agg(joined.alias("part"))
    kept = edges.filter((size("part") == max_len) | (F.col("block_id") == 0))
    return made.filter("whole").select("group_id", "block_id", "part").unionByName(kept)
