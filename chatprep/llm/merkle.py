"""Merkle manifest of a table: leaves, subtree roots per group, one root, and a proof for every row.

A group's leaves stand in order and are cut into aligned blocks of `fanout ** k` leaves. Each
block hashes its own subtree. Then blocks exchange the roots of ever larger subtrees: in
round r the blocks at the same offset of the sibling subtrees of `fanout ** r` blocks meet,
take each other's roots and all compute the parent. After the last round every block holds
the group's root and the path from its own root to it, and none was sent downwards. The
roots of the groups are leaves of a tree of their own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.frames import hint_small
from chatprep.operators.ranks import grouped_offset
from chatprep.sources.shared import stored

FANOUT = 2
BLOCK_ROWS = 4096
_PATH = "array<struct<left string, right string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in UTF-8 bytes, a colon and the text, or `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row."""
    return digest(*[field(v) for v in values])


def group_key(group: Column) -> Column:
    """Text that orders groups by their UTF-8 bytes, null before all, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def joined_hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def subtree(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """Levels of the tree over `nodes`, `height` of them above the leaves, or up to a single node."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([joined_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def siblings(level: list[str], i: int, fanout: int) -> dict[str, str]:
    """The other nodes of the run that node `i` is in, before and after it."""
    start = i - i % fanout
    return {"left": "".join(level[start:i]), "right": "".join(level[i + 1 : start + fanout])}


def _height(block_rows: int, fanout: int) -> int:
    """How many levels an aligned block spans; the block is the largest power that is no larger than `block_rows`."""
    height = 0
    while fanout ** (height + 1) <= block_rows:
        height += 1
    return height


def exchange(blocks: DataFrame, fanout: int, span: int) -> DataFrame:
    """One round among subtrees of `span` blocks: `root` becomes the parent's, `path` gains a step.

    A last subtree may have fewer blocks than its siblings; its blocks then also answer for the
    offsets that it lacks. Groups of a single subtree keep what they have.
    """
    node, at = F.expr(f"block div {span}L"), F.col("block") % span
    size = F.least(F.lit(span).cast("long"), F.col("n_blocks") - node * span)
    alone = (node % fanout == 0) & ((node + 1) * span >= F.col("n_blocks"))
    answers = F.when(alone | (size == span), F.array(at)).otherwise(F.sequence(at, F.lit(span - 1).cast("long"), size))
    sent = blocks.select("*", node.alias("node"), at.alias("own"), F.explode(answers).alias("at"))
    mine = F.when(F.col("at") == F.col("own"), F.struct("block", "n_blocks", "path"))
    met = sent.groupBy("group", F.expr(f"node div {fanout}L").alias("parent"), "at").agg(F.sort_array(F.collect_list(F.struct("node", "root", mine.alias("mine")))).alias("nodes"))
    each = met.select("group", "nodes", F.explode(F.filter("nodes", lambda x: x["mine"].isNotNull())).alias("one"))

    def roots(keep) -> Column:
        return F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["root"]), "")

    me = F.col("one.node")
    step = F.struct(roots(lambda x: x["node"] < me).alias("left"), roots(lambda x: x["node"] > me).alias("right"))
    several = F.col("one.mine.n_blocks") > span
    return each.select(
        "group",
        F.col("one.mine.block").alias("block"),
        F.col("one.mine.n_blocks").alias("n_blocks"),
        F.when(several, F.sha2(roots(lambda x: F.lit(True)), 256)).otherwise(F.col("one.root")).alias("root"),
        F.when(several, F.array_append("one.mine.path", step)).otherwise(F.col("one.mine.path")).alias("path"),
    )


def exchanged(leaves: DataFrame, order: list[str], fanout: int = FANOUT, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Leaves with `block` and `pos`, and blocks `(group, block, n_blocks, root, path)` that know their group's root.

    `leaves` has `group` (text, not null) and `leaf`; the leaves of a group stand in `order`,
    ties by `leaf`. `path` leads from a block's own root to `root`; a step holds the digests
    of the siblings `left` and `right` of the node, one after the other.
    """
    height = _height(block_rows, fanout)
    placed = grouped_offset(leaves.withColumn("one", F.lit(1)), ["group"], [*order, "leaf"], "one", "pos").drop("one")
    rows = stored(placed.withColumn("block", F.expr(f"pos div {fanout**height}L")), "leaves")
    counts = stored(rows.groupBy("group").agg((F.max("block") + 1).alias("n_blocks")), "groups")
    sized = rows.select("group", "block", "pos", "leaf").join(hint_small(counts), "group")

    def hashed(table: pa.Table) -> pa.Table:
        nodes = table.sort_by("pos")["leaf"].to_pylist()
        n_blocks = table["n_blocks"][0].as_py()
        top = subtree(nodes, fanout, height if n_blocks > 1 else None)[-1][0]
        return pa.table({"group": table["group"][:1], "block": table["block"][:1], "n_blocks": table["n_blocks"][:1], "root": [top]})

    blocks = sized.groupBy("group", "block").applyInArrow(hashed, "group string, block long, n_blocks long, root string")
    blocks = stored(blocks.withColumn("path", F.array().cast(_PATH)), "blocks")
    most = counts.agg(F.max("n_blocks").alias("n")).first()["n"] or 0
    span = 1
    while span < most:
        blocks = exchange(blocks, fanout, span)
        span *= fanout
    return rows, stored(blocks, "block-paths") if span > 1 else blocks


def with_paths(rows: DataFrame, blocks: DataFrame, fanout: int = FANOUT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every leaf with `path`, the steps inside its block and then the block's own, and the block's further columns."""
    height = _height(block_rows, fanout)
    names = [c for c in rows.columns if c not in ("block", "pos")]
    further = [c for c in blocks.columns if c not in ("group", "block", "n_blocks", "path")]
    kinds = dict(rows.dtypes)

    def climbed(mine: pa.Table, paths: pa.Table) -> pa.Table:
        mine = mine.sort_by("pos")
        upper = paths["path"][0].as_py()
        levels = subtree(mine["leaf"].to_pylist(), fanout, height if paths["n_blocks"][0].as_py() > 1 else None)
        found = [[siblings(level, i // fanout**k, fanout) for k, level in enumerate(levels[:-1])] + upper for i in range(len(mine))]
        steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        out = mine.select(names).append_column("path", pa.array(found, steps))
        for name in further:
            out = out.append_column(name, pa.array([paths[name][0].as_py()] * len(mine), pa.string()))
        return out

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), f"path {_PATH}", *(f"{n} string" for n in further)])
    return rows.groupBy("group", "block").cogroup(blocks.groupBy("group", "block")).applyInArrow(climbed, schema)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, node, lambda acc, step: digest(step["left"], acc, step["right"]))


def proof_digest(path: Column) -> Column:
    """One digest for a whole path: its siblings level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(df: DataFrame, order_col: str, group_col: str, leaf_col: str, carry: list[str] | None = None, fanout: int = FANOUT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows `(<order_col>, leaf, <carry>, subroot, root, path)`: every leaf with its proof.

    Leaves of a group ascend by `order_col` (nulls first), ties by the leaf itself, so equal
    rows have neighbouring places and rows of their own. `path` leads from the leaf over the
    root of its group, `subroot`, to `root`, which stands over the groups in the order of
    their UTF-8 bytes, null first. Null groups are a group; empty texts are values; a text of
    any length is hashed where it is and never moves. An empty table gives an empty frame.
    Further columns are left out unless named in `carry`; their names are free.
    """
    kept = [order_col, *(carry or [])]
    alias = {name: f"kept_{i}" for i, name in enumerate(kept)}
    leaves = df.select(group_key(F.col(group_col)).alias("group"), F.col(leaf_col).alias("leaf"), *[F.col(c).alias(a) for c, a in alias.items()])
    rows, blocks = exchanged(leaves, [alias[order_col]], fanout, block_rows)
    roots = blocks.filter("block = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("root").alias("leaf"))
    tops = with_paths(*exchanged(roots, ["name"], fanout, block_rows), fanout, block_rows)
    upper = stored(tops.select(F.col("name").alias("group"), F.col("path").alias("above"), "root"), "tops")
    known = blocks.withColumnRenamed("root", "subroot").join(hint_small(upper), "group")
    complete = known.select("group", "block", "n_blocks", "subroot", "root", F.concat("path", "above").alias("path"))
    proven = with_paths(rows, complete, fanout, block_rows)
    carried = [F.col(alias[c]).alias(c) for c in kept]
    return proven.select(carried[0], "leaf", *carried[1:], "subroot", "root", "path")
