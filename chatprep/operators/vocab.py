"""Character vocabularies, and encoding and decoding against them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.constants import BOS_TEXT, EOS_TEXT, MAX_CODE_POINTS, N_SPECIAL, PAD_TEXT, UNK_ID, UNK_TEXT
from chatprep.functions.codec import characters, ids_of, pieces, text_of, with_specials
from chatprep.functions.rows import each, each_value
from chatprep.sources.shared import stored
from chatprep.sources.tables import assert_vocab_size


def pair_text(pairs: DataFrame, *kept: str) -> DataFrame:
    """`(text, kept...)`: both sides of a pair, a blank between them."""
    return pairs.select(F.concat("input", F.lit(" "), "output").alias("text"), *kept)


def _distinct_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters of a task's texts, each once; texts are decoded a piece of a batch at a time."""
    seen = np.zeros(MAX_CODE_POINTS, bool)
    for batch in batches:
        for piece in pieces(batch["text"]):
            whole = b"".join(piece.drop_null().to_pylist()).decode("utf-8", "replace")
            seen[np.frombuffer(whole.encode("utf-32-le"), np.uint32)] = True
    yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in np.flatnonzero(seen).tolist()], pa.string())], names=["ch"])


def _each_char(df: DataFrame, text: str) -> DataFrame:
    return each_value(df, [], characters(F.col(text)), "ch")


def build_vocab(df: DataFrame, text: str = "text") -> DataFrame:
    """`(ch, id)`: the four special rows, then the distinct characters by code point.

    Characters are made distinct per task before the shuffle, so no more than
    one row per code point and task is moved; the numbering runs over at most all of Unicode.
    """
    texts = df.select(F.col(text).cast("binary").alias("text"))
    seen = texts.mapInArrow(_distinct_chars, "ch string").distinct().filter(F.col("ch") != UNK_TEXT)
    numbered = seen.select("ch", (F.row_number().over(W.orderBy("ch")) + (N_SPECIAL - 1)).alias("id"))
    specials = [(t, i) for i, t in enumerate([PAD_TEXT, BOS_TEXT, EOS_TEXT, UNK_TEXT])]
    return df.sparkSession.createDataFrame(specials, "ch string, id int").unionByName(numbered)


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("vocab_size"))


def char_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """`(ch, n)` over a text column."""
    return _each_char(df, text).groupBy("ch").agg(F.count("*").alias("n"))


def prune_vocab(frequency: DataFrame, min_count: int) -> DataFrame:
    """A vocabulary of the characters seen at least `min_count` times."""
    return build_vocab(frequency.filter(F.col("n") >= min_count), "ch")


def _counted(vocab: DataFrame) -> DataFrame:
    """The vocabulary as a stored table, made once for its count and its use, refused if it is none."""
    kept = stored(vocab.select("ch", "id").limit(MAX_CODE_POINTS + N_SPECIAL + 1), "vocabulary")
    assert_vocab_size(kept.count())
    return kept


def oov_report(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """`(ch, n)` of the characters the vocabulary does not hold.

    Counts come first, so both sides of the anti join are at most one row per code point.
    """
    known = _counted(vocab).filter(F.col("id") >= N_SPECIAL).select("ch")
    return char_frequency(df, text).join(F.broadcast(known), "ch", "left_anti")


def _constant_array(values: list, kind: str, sep: str) -> Column:
    """A constant array written as one string: a plan with one literal per entry is slow to build."""
    return F.split(F.lit(sep.join(values)), sep).cast(f"array<{kind}>")


@dataclass(frozen=True)
class Codec:
    """A vocabulary as two constant lookups; at most one entry per code point, so driver-safe."""

    lookup: str
    texts: tuple

    @property
    def size(self) -> int:
        return len(self.texts)

    @classmethod
    def of(cls, vocab: DataFrame) -> Codec:
        # One row more than can be, so that a table that is no vocabulary is refused, not gathered.
        rows = vocab.select("id", "ch").limit(MAX_CODE_POINTS + N_SPECIAL + 1).collect()
        assert_vocab_size(len(rows))
        texts = [UNK_TEXT] * (max((r["id"] for r in rows), default=-1) + 1)
        points = {}
        for r in rows:
            texts[r["id"]] = r["ch"]
            if len(r["ch"]) == 1:
                points[ord(r["ch"])] = r["id"]
        lookup = [UNK_ID] * (max(points, default=0) + 1)
        for point, i in points.items():
            lookup[point] = i
        return cls(",".join(map(str, lookup)), tuple(texts))

    def array(self) -> np.ndarray:
        """The id of each code point."""
        return np.array(self.lookup.split(","), np.int32)

    def ids(self, text: Column) -> Column:
        return ids_of(text, F.split(F.lit(self.lookup), ",").cast("array<int>"))

    def encode(self, text: Column, add_special: bool = True) -> Column:
        """Ids of the characters, unknown ones as 3, between begin and end ids if asked."""
        ids = self.ids(text)
        return with_specials(ids) if add_special else ids

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        """Text of the ids; special ids dropped if asked, unmapped ids as the unknown character."""
        # Every entry but the four special ones is one character, so they need no separator.
        singles = "".join(t if i >= N_SPECIAL else UNK_TEXT for i, t in enumerate(self.texts))
        texts = F.split(F.lit(singles), "")
        if not skip_special:
            named = F.array(*[F.lit(t) for t in self.texts[:N_SPECIAL]])
            texts = F.concat(named, F.slice(texts, N_SPECIAL + 1, F.lit(max(len(self.texts), 1))))
        return text_of(ids, texts, skip_special)


def encode_by_join(df: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`(keys..., ids)` through a broadcast join on the distinct characters of each text.

    For vocabularies that should stay a table; slower than `Codec.encode`, which is the
    default. Only a text's distinct characters become rows, the first with the text; the
    ids met are put in the places of the characters when the rows of a text, known by its
    keys and 64 bits of hash, are together again. Repeated rows are encoded each.
    """
    known = _counted(vocab).filter(F.col("id") >= UNK_ID).select("ch", "id")
    told = df.select(*keys, F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    rows = told.select("*", F.posexplode_outer(F.array_distinct(characters(F.col("_text")))).alias("_pos", "ch"))
    first = F.coalesce("_pos", F.lit(0)) == 0
    rows = rows.select(*keys, "_hash", "ch", F.when(first, F.col("_text")).alias("_text"), first.cast("int").alias("_n"))
    met = F.when(F.col("id").isNotNull(), F.struct("ch", "id"))
    looked = rows.join(F.broadcast(known), "ch", "left").groupBy(*keys, "_hash")
    grouped = looked.agg(F.first("_text", ignorenulls=True).alias("_text"), F.sum("_n").cast("int").alias("_n"), F.map_from_entries(F.collect_set(met)).alias("_ids"))
    each_time = grouped.select("*", F.explode_outer(F.sequence(F.lit(1), "_n")))
    ids = F.transform(characters(F.col("_text")), lambda ch: F.coalesce(F.try_element_at("_ids", ch), F.lit(UNK_ID)))
    return each_time.select(*keys, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def looked_up(texts: pa.Array, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all characters of the texts, and how many each has; null has none."""
    texts = pc.fill_null(texts, "")
    whole = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    known = whole < len(lookup)
    ids = np.full(len(whole), UNK_ID, np.int32)
    ids[known] = lookup[whole[known]]
    return ids, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def arrow_encoder(codec: Codec):
    """A function from text column to ids, the same as `Codec.ids`, vectorised over Arrow batches.

    A piece of a batch is decoded to code points in one go and looked up in one array access;
    moving the ids back costs more than that saves (half the speed of `Codec.ids` where
    measured), so it is meant for pipelines that are in Python already.
    """
    lookup = codec.array()

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch):
                ids, sizes = looked_up(piece, lookup)
                yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))

    return F.arrow_udf(encode, "array<int>")
