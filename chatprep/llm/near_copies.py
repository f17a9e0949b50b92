"""Near copies by word shingles: SimHash fingerprints and pivot distances choose pairs, exact Jaccard decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.frames import raw_texts, words
from chatprep.llm.graph import Forest, components
from chatprep.llm.simhash import N_PIVOTS, pivots, whole_tasks
from chatprep.sources.shared import shuffles_let_go, stored

SHINGLE = 5
SIMILARITY = 0.8
# Texts of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9.
RADIUS = 20
# Of two such texts one in 10^4 shares none of these keys.
KEYS, MINIMA = 24, 5
KEY_ROWS = 2048
PART_SHINGLES = 1 << 20
_SEED = 42
_ROWS = 1 << 12
_MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, KEYS * MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than a shingle are one, no words none."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    stops = np.cumsum([len(t) + 1 for t in tokens]) - 1
    reach = min(shingle, len(tokens)) - 1
    ends = stops[reach:].tolist()
    starts = [0, *(stops[: len(ends) - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[a:b], _SEED) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        part = hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def keys(hashes: np.ndarray) -> np.ndarray:
    """`KEYS` numbers, each made of `MINIMA` minima of the hashes under as many mixings; none without hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _ROWS):
        mixed = (hashes[at : at + _ROWS, None] ^ _MIX[0]) * _MIX[1]
        np.minimum(least, mixed.min(axis=0), out=least)
    out = np.arange(KEYS, dtype=np.uint64)
    for column in least.reshape(KEYS, MINIMA).T:
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + column
    return out.view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows `(id, text_hash, node, fp, n, keys)`, one for each of the input; `node` is a hash of the set of shingles, `n` its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, n, found = [], [], [], []
            for text in raw_texts(batch["text"]):
                hashes = shingle_set(text, shingle)
                node.append(xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63))
                fp.append(fingerprint(hashes))
                n.append(len(hashes))
                found.append(keys(hashes))
            made = [pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text_hash"], *made], names=["id", "text_hash", "node", "fp", "n", "keys"])

    slim = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, text_hash long, node long, fp long, n long, keys array<long>")


def meetings(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Rows with tasks `(g, i, j)` in which all of a group `g` meet, sorted by the distance `near` to the first pivot.

    A group heavier than `limit` is cut into parts of that weight, and every two parts are a
    task of their own. Groups of one row are left out.
    """
    groups = rows.groupBy("g").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight")).filter("rows > 1")
    sized = rows.join(groups.select("g", F.ceil(F.col("weight") / F.lit(limit)).cast("int").alias("parts")), "g")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = sized.withColumn("s", part).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivots(1).view(np.int64)[0]))))
    placed = meets.withColumns({"i": F.least("s", "t"), "j": F.greatest("s", "t"), "near": near}).drop("t", "parts")
    return placed.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "near", "node")


def links(met: DataFrame, radius: int, similarity: Callable[[dict[str, np.ndarray]], Callable[[int, int], bool]] | None = None) -> DataFrame:
    """Edges `(a, b)` of nodes that join what is linked within each task: a forest, never all its pairs.

    Pairs whose distances to any pivot differ by more than `radius` are discarded, survivors
    verified by their bits, and then by `similarity`, a test made for each task of its rows;
    pairs that are joined already are not asked.
    """
    refs = pivots(N_PIVOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_tasks(batches, ["g", "i", "j"]):
            cuts = [0, len(block["task"])]
            if similarity:  # one task at a time is unpacked
                cuts = np.flatnonzero(np.diff(block["task"], prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                rows = {n: v[a:b] for n, v in block.items()}
                low, high = swept(rows, refs, radius, similarity(rows) if similarity else None)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def swept(rows: dict[str, np.ndarray], refs: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within each task; rows are sorted by task and first distance."""
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
        # Pairs inside one part belong to the task of that part with itself.
        a = left[diagonal[left] | (part[left] != part[left + lag])]
        for distances in table[1:]:
            a = a[np.abs(distances[a] - distances[a + lag]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= radius]
        if alike is None:
            forest.join(a, a + lag)
            continue
        for x in a[forest.roots()[a] != forest.roots()[a + lag]].tolist():
            if alike(x, x + lag):
                forest.join(np.array([x]), np.array([x + lag]))
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(fp)))
    return rows["node"][moved], rows["node"][roots[moved]]


def exactly(similarity: float, shingle: int) -> Callable[[dict[str, np.ndarray]], Callable[[int, int], bool]]:
    """A test of the rows' texts: the Jaccard similarity of their sets of shingles reaches `similarity`."""

    def of_rows(rows: dict[str, np.ndarray]) -> Callable[[int, int], bool]:
        sets = [shingle_set(t, shingle) for t in rows["text"]]

        def alike(x: int, y: int) -> bool:
            a, b = sorted((sets[x], sets[y]), key=len)
            if len(a) < similarity * len(b):
                return False
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            return both >= similarity * (len(a) + len(b) - both)

        return alike

    return of_rows


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Rows `(id, text_hash, root)`, one for each of the input; `root` is one for each group of near copies.

    Groups are what links of texts whose sets of shingles have a Jaccard similarity of at
    least `similarity` connect. Texts of one set stand as one. Those that share one of
    `KEYS` keys meet: pivot distances and fingerprints discard pairs of more than `RADIUS`
    differing bits, which leaves loose groups. In these the texts themselves meet, and every
    link is verified exactly, so a link told is a link; one of similarity 0.8 is missed about
    twice in 10^4. Null texts, empty ones and ones without words are one group. Texts
    are taken whole; a very long one is held by one task at a time with its shingles.
    Repeated rows stay, and an empty table gives an empty one.
    """
    found = stored(sketches(df, id_col, text_col, shingle), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first")
    classes = stored(found.groupBy("node").agg(first, F.any_value("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")), "classes")
    keyed = classes.select(F.explode("keys").alias("g"), "node", "fp")
    loose = components(links(meetings(keyed, F.lit(1), KEY_ROWS), RADIUS))
    members = classes.join(loose, "node").select("node", "fp", "n", F.col("component").alias("g"), F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.encode(text_col, "UTF-8").alias("text"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    # A repeated row would be the same node once more.
    rows = texts.join(stored(members, "members"), same).select("g", "node", "fp", "n", "text")
    joined = components(links(meetings(rows, F.col("n"), PART_SHINGLES), RADIUS, exactly(similarity, shingle)))
    named = found.select("id", "text_hash", "node").join(joined, "node", "left")
    return named.select("id", "text_hash", F.coalesce("component", "node").alias("root"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies, with the input's columns: that of the smallest id, null last.

    Of rows that repeat id and text any one stays.
    """
    with shuffles_let_go(df.sparkSession):
        near = stored(near_copies(df, id_col, text_col, similarity, shingle), "near")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("x"))
    keep = stored(first.select(F.col("x.id").alias("_id"), F.col("x.text_hash").alias("_hash")), "keep")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
    rows = df.join(keep, same, "left_semi")
    if near.groupBy("id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows
    return rows.withColumn("_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "_hash"]).drop("_hash")
