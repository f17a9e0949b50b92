"""SimHash near-duplicates: fingerprints, pivot distance tables, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.frames import raw_texts, words
from chatprep.llm.graph import Forest, components
from chatprep.sources.shared import stored

SHINGLE = 4
HASH_SEED = 42
RADIUS = 4
N_PIVOTS = 16
PIVOT_SEED = 11
BUCKET_ROWS = 2048
_SUM_ROWS = 1 << 14
# Above so many fingerprints one more block is used; see `blocks_for`.
_ROWS_PER_KEY = 2000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if it is set in over half the XXH64 hashes of the text's shingles; 0 without words."""
    tokens = words(text)
    if not tokens:
        return 0
    # Cut the shingles from one normalised text instead of joining the words of each.
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    h = xxhash.xxh64_intdigest
    last = max(0, len(tokens) - shingle)
    reach = min(shingle, len(tokens)) - 1
    hashes = np.array([h(joined[starts[i] : stops[i + reach]], HASH_SEED) for i in range(last + 1)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SUM_ROWS):
        part = hashes[at : at + _SUM_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows `(id, text_hash, fp)`, one for each of the input; `fp` is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in raw_texts(batch["text"])], dtype=np.uint64)
            columns = [batch["id"], batch["text_hash"], pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "fp"])

    slim = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, text_hash long, fp long")


def pivots(n: int = N_PIVOTS, seed: int = PIVOT_SEED) -> np.ndarray:
    """Reference fingerprints."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Into how many blocks the 64 bits are cut, so that buckets stay small: of `radius + m`, `m` whole blocks are the key."""
    for blocks in range(radius + 1, radius + 5):
        if n <= _ROWS_PER_KEY * 2.0 ** (64 * (blocks - radius) // blocks):
            break
    return blocks


def key_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of bits of which two fingerprints within `radius` share all of at least one, by the pigeonhole principle."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(prints: DataFrame, radius: int = RADIUS, n_pivots: int = N_PIVOTS, blocks: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges `(a, b)` that join all distinct fingerprints `fp` linked by at most `radius` differing bits, directly or not.

    Fingerprints meet by whole blocks of bits, of which close ones share at least one. In a
    bucket, rows are sorted by their distance to the first pivot, and each is compared only
    with those that follow within `radius`. Pairs are discarded once their distances to any
    pivot differ by more than `radius`, which distances of close ones cannot; survivors are
    verified. A bucket of more than `bucket_rows` is cut into parts of that size, and every
    two parts are a task of their own. From each task comes a forest, never its pairs.
    """
    masks = key_masks(blocks or blocks_for(prints.count(), radius), radius)
    refs = pivots(n_pivots)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(refs.view(np.int64)[0]))))
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.v")
    counts = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    parts = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    sized = keyed.join(counts.select("c", "v", parts.alias("parts")), ["c", "v"])
    # Part s meets every other once, as task (smaller, larger).
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = sized.withColumn("s", part).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = meets.select("c", "v", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", near.alias("near"), "fp")
    together = tasks.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_tasks(batches, ["c", "v", "i", "j"]):
            a, b = swept(block, refs, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def whole_tasks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows in blocks that do not cut a key; adds `task`, which numbers the keys of a block."""
    rest: dict[str, np.ndarray] | None = None

    def numbered(rows: dict[str, np.ndarray]) -> np.ndarray:
        new = np.zeros(len(rows[keys[0]]), dtype=bool)
        for k in keys:
            new[1:] |= rows[k][1:] != rows[k][:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: batch[n].to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if rest is not None:
            rows = {n: np.concatenate([rest[n], rows[n]]) for n in rows}
        task = numbered(rows)
        last = int(np.searchsorted(task, task[-1]))
        rest = {n: v[last:] for n, v in rows.items()}
        if last:
            yield {n: v[:last] for n, v in rows.items()} | {"task": task[:last]}
    if rest is not None:
        yield rest | {"task": numbered(rest)}


def swept(rows: dict[str, np.ndarray], refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the close pairs within each task; rows are sorted by task and first distance."""
    fp, task, part = rows["fp"].view(np.uint64), rows["task"], rows["s"]
    diagonal = rows["i"] == rows["j"]
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8).T.copy()
    forest, left, lag = Forest(len(fp)), np.arange(len(fp)), 0
    while left.size:
        lag += 1
        left = left[left + lag < len(fp)]
        right = left + lag
        reach = (task[left] == task[right]) & (table[0][right] - table[0][left] <= radius)
        left = left[reach]
        right = left + lag
        # Pairs inside one part belong to the task of that part with itself.
        a = left[diagonal[left] | (part[left] != part[right])]
        for distances in table[1:]:
            a = a[np.abs(distances[a] - distances[a + lag]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= radius]
        if a.size:
            forest.join(a, a + lag)
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(fp)))
    return rows["fp"][moved], rows["fp"][roots[moved]]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, n_pivots: int = N_PIVOTS) -> DataFrame:
    """Rows `(id, text_hash, fp, root, component_id)`, one for each of the input.

    `fp` is the fingerprint as a long, `root` one of the component; `component_id` the smallest id reachable over links
    of at most `radius` differing bits, the row's own included. Rows of one fingerprint
    stand as one. Null and empty texts have fingerprint 0 and link like others; a null id
    takes part but is never a component's id, unless all its ids are null. Repeated rows
    stay. An empty table gives an empty one.
    """
    prints = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    joined = components(close_pairs(classes.select("fp"), radius, n_pivots))
    rooted = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("id", "text_hash", "fp", "root", "component_id")


def hex_fingerprint(fp="fp"):
    """The 64 bits as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, with the input's columns: that of the smallest id, null last.

    Of rows that repeat id and text any one stays.
    """
    near = stored(near_duplicates(df, id_col, text_col, radius), "near")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("x"))
    keep = stored(first.select(F.col("x.id").alias("_id"), F.col("x.text_hash").alias("_hash")), "keep")
    # Null ids match on the text alone.
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
    rows = df.join(keep, same, "left_semi")
    repeats = near.groupBy("id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    if repeats.isEmpty():
        return rows
    keyed = rows.withColumn("_hash", F.xxhash64(text_col))
    return keyed.dropDuplicates([id_col, "_hash"]).drop("_hash")
