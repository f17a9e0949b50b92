"""Phrases whose words keep together, read off depth-truncated suffix subtrees.

Words become numbers, most frequent first. Every position of the text begins a suffix, which
is cut to the longest phrase asked for, at the end of its piece, and at a word too rare for
any phrase that counts. Suffixes are partitioned by their first words: a prefix with more
suffixes than the budget of a group is split by its next word, and so on; what is within the
budget is dealt to groups by hash. Tasks send each group its suffixes in order, equal ones
as one; a group brings them together and reads the counts of all its phrases off the totals
of the leaves below them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.llm.frames import hint_small, key_bits
from chatprep.sources.shared import arrow_rows, stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
HELD_WORDS = 1 << 18
HELD_BYTES = 48
# A group has a 1024th of all suffixes, but no more than fit a task, unless the prefixes beyond would be more than 2 ** 18.
GROUPS = 1 << 10
GROUP_ROWS = 1 << 18
MAX_HEAVY = 1 << 18
# The characters that end a piece, all as line ends; tabs as blanks.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", b"\n" * 9 + b" ")
_RUN_BYTES = 1 << 18
_RUN_WORDS = 1 << 12
# Rows that go to Python at a time: texts, encoded runs and blocks are kilobytes each.
_ARROW_ROWS = 256
_BUFFER_ROWS = 1 << 18
_HELD_MEMORY = 1 << 17
_END = b"\n"
_APART = 0x80  # of a column's width: negative numbers stand apart


def runs(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text and an end for each piece, in runs of about `_RUN_BYTES`; no word is cut."""
    at, size = 0, len(text or b"")
    while at < size:
        stop = size
        if size - at > _RUN_BYTES:
            ends = [x for x in (text.find(c, at + _RUN_BYTES) for c in (b" ", b"\n", b"\t")) if x >= 0]
            stop = min(ends) if ends else size
        part = text[at:stop].lower().translate(_PIECES).replace(_END, b" \n ")
        yield [w for w in part.split(b" ") if w]
        at = stop


def word_counts(texts: DataFrame, spare: int = _HELD_MEMORY) -> DataFrame:
    """Rows `(lang, word, n)`: every word's occurrences, added up before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in _texts(batch):
                mine = counts.setdefault(lang, Counter())
                for words in runs(text):
                    mine.update(words)
                    if sum(map(len, counts.values())) > spare:
                        yield from map(_counted, *zip(*counts.items()))
                        counts = {lang: (mine := Counter())}
        if counts:
            yield from map(_counted, *zip(*counts.items()))

    return texts.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Language and text of the rows, a text at a time."""
    texts = batch["text"].cast(pa.binary())
    for i, lang in enumerate(batch["lang"].to_pylist()):
        yield lang, texts[i].as_py()


def _counted(lang: str, found: Counter) -> pa.RecordBatch:
    found.pop(_END, None)
    words, n = pa.array(found.keys(), pa.binary()), pa.array(np.fromiter(found.values(), np.int64, len(found)))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), words, n], names=["lang", "word", "n"])


def word_symbol(lang: str, word: bytes) -> int:
    """The number of a word that has no rank: 63 bits of hash, negative."""
    return -1 - (xxhash.xxh64_intdigest(lang.encode() + b"\0" + word) >> 1)


def symbols(counts: DataFrame, min_count: int, held: int = HELD_WORDS) -> tuple[DataFrame, dict[str, dict[bytes, int]], bytes]:
    """Frequent words `(lang, word, n, symbol)`; the ranks of the `held` most frequent of them; `key_bits` of the symbols of the others, if any.

    What the driver holds is at most `held` words of at most `HELD_BYTES` bytes, and the bits.
    """
    frequent = stored(counts.filter(F.col("n") >= min_count), "words")
    short = frequent.filter(F.length("word") <= HELD_BYTES)
    top = short.orderBy(F.desc("n"), "lang", "word").limit(held).collect()
    ranks: dict[str, dict[bytes, int]] = {}
    for i, row in enumerate(top):
        ranks.setdefault(row["lang"], {})[bytes(row["word"])] = i + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["lang"].to_pylist(), batch["word"].to_pylist())
            found = [ranks.get(lang, {}).get(word) or word_symbol(lang, word) for lang, word in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "symbol"])

    known = stored(frequent.mapInArrow(run, "lang string, word binary, n long, symbol long"), "symbols")
    others = known.filter("symbol < 0").select(F.col("symbol").alias("key"))
    n_others = others.count()
    return known, ranks, key_bits(others, n_others).tobytes() if n_others else b""


def unranked_symbol(lang: str, word: bytes, others: bytes) -> int:
    """The symbol of a word that has no rank: 0 for a rare one, unless it is taken by chance for one of the `others`, which only costs rows."""
    symbol = word_symbol(lang, word)
    at = (symbol ^ ((symbol & 0xFFFFFFFFFFFFFFFF) >> 32)) & (len(others) * 8 - 1)
    return symbol if others[at >> 3] >> (at & 7) & 1 else 0


def encoded(texts: DataFrame, ranks: dict[str, dict[bytes, int]], others: bytes, max_words: int) -> DataFrame:
    """Rows `(ids, own)`: the texts as `packed` symbols, 0 where nothing frequent stands or a piece ends; see `symbols` for `others`.

    A row's first `own` places begin suffixes; those that follow are also the next row's and
    only complete them. Texts run on without a seam but for the 0 between them.
    """
    reach = max_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lang, text in _texts(batch):
                known = ranks.get(lang, {})
                for words in runs(text):
                    if others:
                        ids = [known.get(w) or (0 if w == _END else unranked_symbol(lang, w, others)) for w in words]
                    else:
                        ids = [known.get(w, 0) for w in words]
                    part = _thinned(np.array(ids, np.int64))
                    held.append(part)
                    size += len(part)
                    if size >= _RUN_WORDS + reach:
                        whole = np.concatenate(held)
                        stop = (len(whole) - reach) // _RUN_WORDS * _RUN_WORDS
                        for a in range(0, stop, _RUN_WORDS):
                            yield _encoded(whole[a : a + _RUN_WORDS + reach], _RUN_WORDS)
                        held, size = [whole[stop:]], len(whole) - stop
                held.append(np.zeros(1, np.int64))
                size += 1
        if size:
            whole = np.concatenate(held)
            yield _encoded(whole, len(whole))

    return texts.mapInArrow(run, "ids binary, own int")


def _thinned(ids: np.ndarray) -> np.ndarray:
    """The symbols with one 0 for every run of them."""
    if len(ids) < 2:
        return ids
    return ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])]


def _encoded(ids: np.ndarray, own: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([packed([ids])], pa.binary()), pa.array([own], pa.int32())], names=["ids", "own"])


def _mixed(h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a prefix from that of the prefix a word shorter."""
    h = (h ^ np.ascontiguousarray(symbol).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
    for ids, own in zip(batch["ids"], batch["own"].to_pylist()):
        yield unpacked(ids.as_py(), 1)[0], own


def _begun(ids: np.ndarray, own: int, max_words: int) -> np.ndarray:
    """The suffixes of two words and more that begin at the first `own` places, 0 beyond their ends."""
    goes_on = np.concatenate([(ids[:-1] != 0) & (ids[1:] != 0), np.zeros(max_words, bool)])
    starts = np.flatnonzero(goes_on[:own])
    out = np.zeros((len(starts), max_words), np.int64)
    live = np.ones(len(starts), bool)
    for k in range(max_words):
        out[live, k] = ids[starts[live] + k]
        live &= goes_on[starts + k]
    return out


def heavy_prefixes(texts: DataFrame, words: DataFrame, budget: int, max_words: int) -> list[np.ndarray]:
    """For each length, the hashes of the prefixes with more than `budget` suffixes, ordered; at most suffixes / budget of a length."""
    large = [r["symbol"] for r in words.filter(F.col("n") > budget).select("symbol").collect()]
    found = [np.sort(_mixed(np.zeros(len(large), np.uint64), np.array(large, np.int64)))]
    while len(found[-1]) and len(found) < max_words - 1:
        known = list(found)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for ids, own in _rows(batch):
                    h, depth = _placed(_begun(ids, own, max_words), known)
                    held.append(h[depth == len(known) + 1])
                    size += len(held[-1])
                    if size >= _BUFFER_ROWS:
                        yield _hash_counts(held)
                        held, size = [], 0
            yield _hash_counts(held)

        counts = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > budget)
        found.append(np.sort(np.array([r["h"] for r in counts.select("h").collect()], np.int64).view(np.uint64)))
    return found if len(found[-1]) else found[:-1]


def _hash_counts(held: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _placed(rows: np.ndarray, heavy: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each suffix's shortest prefix that is not heavy, its end included, and that prefix's length."""
    h = _mixed(np.zeros(len(rows), np.uint64), rows[:, 0])
    depth = np.ones(len(rows), np.int64)
    for k, known in enumerate(heavy):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        split = np.flatnonzero((depth == k + 1) & (known[at] == h))
        # Where the suffix ends the zero stands for the next word.
        h[split] = _mixed(h[split], rows[split, k + 1])
        depth[split] += 1
    return h, depth


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers by planes of their bytes, of which the upper ones say little and shrink to nothing.

    Negative numbers that are few stand behind the planes, which have 0 in their places and all others plus 1.
    """
    out = [len(columns[0]).to_bytes(4, "little")]
    for column in columns:
        apart, width, narrow = np.zeros(0, np.int64), _width(column.max()), _width(int(column.max()) + 1)
        if column.min() < 0:
            width, below = 8, np.flatnonzero(column < 0)
            if narrow * len(column) + 8 * len(below) + 4 < 8 * len(column):
                apart, column, width = column[below], column + 1, narrow
                column[below] = 0
        planes = np.ascontiguousarray(column.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width]
        out += [bytes([width | _APART * bool(len(apart))]), np.ascontiguousarray(planes.T).tobytes()]
        if len(apart):
            out += [len(apart).to_bytes(4, "little"), apart.astype("<i8").tobytes()]
    return b"".join(out)


def _width(largest: int) -> int:
    """Bytes of the largest number."""
    return max(1, (int(largest).bit_length() + 7) // 8)


def unpacked(data: bytes, n_columns: int) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(n_columns):
        width = data[at] & ~_APART
        planes = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n)
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = planes.T
        column = whole.view("<i8").ravel()
        apart = data[at] & _APART
        at += 1 + width * n
        if apart:
            m = int.from_bytes(data[at : at + 4], "little")
            column -= 1
            column[column < 0] = np.frombuffer(data, "<i8", m, at + 4)
            at += 4 + 8 * m
        out.append(column)
    return out


def _summed(rows: np.ndarray, n: np.ndarray, *first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows in order, by `first` before all, equal ones as one with the sum of their numbers."""
    order = np.lexsort([*rows.T[::-1], *first[::-1]])
    rows, n, first = rows[order], n[order], [f[order] for f in first]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[starts], np.add.reduceat(n, starts) if len(starts) else n, [f[starts] for f in first]


def suffix_blocks(texts: DataFrame, heavy: list[np.ndarray], groups: int, max_words: int) -> DataFrame:
    """Rows `(part, block)`: ordered suffixes of a group, equal ones of a stretch of text as one with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, own in _rows(batch):
                held.append(_begun(ids, own, max_words))
                size += len(held[-1])
                if size >= _BUFFER_ROWS:
                    yield _blocks(np.concatenate(held), heavy, groups)
                    held, size = [], 0
        if size:
            yield _blocks(np.concatenate(held), heavy, groups)

    return texts.mapInArrow(run, "part int, block binary")


def _blocks(rows: np.ndarray, heavy: list[np.ndarray], groups: int) -> pa.RecordBatch:
    h, depth = _placed(rows, heavy)
    part = (h % np.uint64(groups)).astype(np.int64)
    rows, n, (part, depth) = _summed(rows, np.ones(len(rows), np.int64), part, depth)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    blocks = [packed([*rows[a:b].T, n[a:b], depth[a:b]]) for a, b in zip(starts, [*starts[1:], len(rows)])]
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])


def phrase_counts(blocks: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """Rows `(s1, ..., length, n)`: all phrases of two words and more that occur `min_count` times."""
    names = [f"s{i + 1}" for i in range(max_words)]

    def counted(table: pa.Table) -> pa.Table:
        columns = list(zip(*(unpacked(b, max_words + 2) for b in table["block"].to_pylist())))
        *symbols, n, depth = [np.concatenate(c) for c in columns]
        rows, n, (depth,) = _summed(np.column_stack(symbols), n, depth)
        return _nodes(_totals(rows, n, depth, min_count), names)

    nodes = blocks.groupBy("part").applyInArrow(counted, ", ".join(f"{n} long" for n in names) + ", length int, n long")
    # Phrases above a group's prefix have leaves in several groups.
    return nodes.groupBy(*names, "length").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _totals(rows: np.ndarray, n: np.ndarray, depth: np.ndarray, min_count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, phrases, lengths and totals of the ordered leaves below.

    A phrase shorter than the prefix that its leaves are dealt by, `depth` words, has others
    elsewhere and counts whatever its total is here.
    """
    found = []
    for k in range(1, rows.shape[1]):
        changed = (rows[1:, : k + 1] != rows[:-1, : k + 1]).any(axis=1) | (depth[1:] != depth[:-1])
        starts = np.flatnonzero(np.concatenate([[True], changed]))
        sums = np.add.reduceat(n, starts)
        keep = (rows[starts, k] != 0) & ((sums >= min_count) | (k + 1 < depth[starts]))
        cut = rows[starts[keep]]
        cut[:, k + 1 :] = 0
        found.append((cut, np.full(len(cut), k + 1), sums[keep]))
    return found


def _nodes(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[str]) -> pa.Table:
    rows, lengths, totals = (np.concatenate(c) for c in zip(*found))
    columns = {name: np.ascontiguousarray(rows[:, i]) for i, name in enumerate(names)}
    return pa.table({**columns, "length": lengths.astype(np.int32), "n": totals.astype(np.int64)})


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, max_words: int, min_count: int, share: int = 100) -> DataFrame:
    """Phrases `(words, a, l, r, n, score, lang)` that no longer one stands for, with their lowest-scoring cut."""
    array = F.array(*[f"s{i + 1}" for i in range(max_words)])
    known = phrases.select(F.slice(array, F.lit(1), F.col("length")).alias("words"), F.col("n").alias("f"))
    single = words.select(F.array("symbol").alias("words"), F.col("n").alias("f"))
    counts = hint_small(stored(known.union(single), "counts"))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = known.select("words", F.col("f").alias("a"), cut.alias("k"))

    def sides(start: Column, length: Column) -> Column:
        return F.slice("words", start, length)

    parts = F.array(
        F.struct(F.lit(True).alias("first"), sides(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("first"), sides(F.col("k") + 1, F.size("words") - F.col("k")).alias("part")),
    )
    each = cuts.select("words", "a", "k", F.explode(parts).alias("side")).select("words", "a", "k", "side.first", "side.part")
    found = stored(each.join(counts.withColumnRenamed("words", "part"), "part"), "cuts")
    both = found.groupBy("words", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    # A phrase inside one that is two words longer is also inside one that is a word longer and no rarer.
    shorter = (F.size("part") == F.size("words") - 1) & (F.size("part") >= 2)
    inside = found.filter(shorter & (F.lit(100) * F.col("a") >= F.lit(share) * F.col("f"))).select(F.col("part").alias("words")).distinct()
    left = both.join(hint_small(stored(inside, "inside")), "words", "left_anti")
    lang_of = words.select(F.col("symbol").alias("s"), "lang")
    in_lang = left.withColumn("s", F.col("words")[0]).join(hint_small(lang_of), "s").join(hint_small(totals), "lang")

    def exact(name: str) -> Column:
        return F.col(name).cast("decimal(18,0)")

    in_lang = in_lang.withColumns({f"{c}_": exact(c) for c in ("a", "n", "l", "r")})
    rated = in_lang.withColumn("score", F.expr("(1000BD * (a_ * n_)) div (l_ * r_)"))
    best = rated.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: int = 100, held: int = HELD_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows `(lang, rank, phrase, a, l, r, n, score)`: the `top` phrases of each language.

    Texts are cut into pieces at `.,;:!?` and line ends and those into words at blanks and
    tabs, A-Z in lower case. A phrase of 2 to `max_words` words inside a piece counts from
    `min_count` occurrences on, overlapping ones included. `a` is its count, `n` the words of
    the language, `l` and `r` the counts of the two parts of the cut with the lowest
    `floor(1000 * a * n / (l * r))`, on ties the first one. A phrase inside a longer one with
    at least `share` percent of its occurrences is left out. Ranks go by score, count (both
    descending) and the phrase's UTF-8 bytes.

    Null languages are `und`, null and empty texts hold no words, a text or word of any length
    is read a megabyte (or a word) at a time, repeated rows count as often as they occur,
    other columns are not looked at, and an empty table gives an empty frame. The `held` most
    frequent words are known by their rank, others by 63 bits of hash.
    """
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    with arrow_rows(df.sparkSession, _ARROW_ROWS):
        counts = stored(word_counts(texts), "word-counts")
        totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        words, ranks, others = symbols(counts, min_count, held)
        ids = stored(encoded(texts, ranks, others, max_words), "encoded")
        total = words.agg(F.sum("n")).first()[0] or 0
        budget = max(1, min(group_rows, total // GROUPS), total // MAX_HEAVY)
        blocks = suffix_blocks(ids, heavy_prefixes(ids, words, budget, max_words), max(1, total // budget), max_words)
        phrases = stored(phrase_counts(blocks, max_words, min_count), "phrases")
    rated = stored(scored(phrases, words, totals, max_words, min_count, share), "scored")
    spelled = rated.select("lang", "words", F.posexplode("words").alias("at", "symbol")).join(hint_small(words.select("symbol", "word")), "symbol")
    texts_of = spelled.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("spelled"))
    phrase = F.array_join(F.transform("spelled", lambda x: x["word"]), " ")
    named = rated.join(texts_of.select("lang", "words", phrase.alias("phrase")), ["lang", "words"])
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
