"""One JSON document of any size, read by byte ranges.

What a byte means depends on all bytes before it: whether they leave a string open and how
deep they nest. But the effect of a range on that is small and composes. Each range tells
how many quotes it has and how far it nests, once for either case, beginning inside a string
or outside; running sums over the ranges of a file, a row each, then say how every range
begins. With that known, each range finds the elements of the chosen list that begin in it,
and reads the last of them to its end, wherever that is.

A cut inside a character does no harm, as no byte of one looks like ASCII. Whether a first
quote is escaped is told by the backslashes before the range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.functions import jsonvals as J
from chatprep.sources.files import file_system
from chatprep.sources.shared import stored

SPLIT_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20
_BATCH_BYTES = 8 << 20
_BLANKS = b" \t\n\r"
_QUOTE, _BACKSLASH, _COLON, _COMMA = b'"\\:,'
_OPEN, _CLOSE = b"[{", b"]}"
# +1 where a byte nests, -1 where it ends, 2 for marks that do neither.
_KIND = np.zeros(256, np.int8)
_KIND[list(_OPEN)] = 1
_KIND[list(_CLOSE)] = -1
_KIND[[_COLON, _COMMA]] = 2


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where quotes stand that are not escaped; `escaped`: whether the byte before the data is an odd backslash."""
    at = np.flatnonzero(data == _QUOTE)
    back = data == _BACKSLASH
    if not escaped and not back.any():
        return at
    before = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
    run = at - 1 - np.where(at > 0, before[at - 1], -1)
    # A run that reaches the start goes on from before.
    run = run + (escaped & (run == at))
    return at[run % 2 == 0]


def ends_escaping(data: bytes, escaped: bool) -> bool:
    """Whether the data ends in an odd run of backslashes."""
    run = len(data) - len(data.rstrip(b"\\"))
    return bool((run + (escaped and run == len(data))) % 2)


@dataclass
class Marks:
    """Brackets, colons and commas outside strings: places, bytes, and how deep it is after each."""

    at: np.ndarray
    byte: np.ndarray
    depth: np.ndarray


def marks(data: bytes, escaped: bool, inside: bool, depth: int) -> tuple[Marks, bool, int]:
    """The marks of a chunk that begins as told, and how it ends."""
    array = np.frombuffer(data, np.uint8)
    found = quotes(array, escaped)
    kinds = _KIND[array]
    at = np.flatnonzero(kinds)
    outside = (np.searchsorted(found, at) + inside) % 2 == 0
    at = at[outside]
    step = kinds[at].astype(np.int64)
    step[step == 2] = 0
    depths = depth + np.cumsum(step)
    return Marks(at, array[at], depths), bool((len(found) + inside) % 2), int(depths[-1]) if len(depths) else depth


def effect(data: bytes, escaped: bool) -> tuple[bool, int, int]:
    """Whether the data has an odd number of quotes, and how far it nests from outside and from inside a string."""
    array = np.frombuffer(data, np.uint8)
    found = quotes(array, escaped)
    kinds = _KIND[array]
    at = np.flatnonzero((kinds == 1) | (kinds == -1))
    outside = np.searchsorted(found, at) % 2 == 0
    step = kinds[at].astype(np.int64)
    return len(found) % 2 == 1, int(step[outside].sum()), int(step[~outside].sum())


def escaped_at(source, at: int) -> bool:
    """Whether the byte at a place follows an odd run of backslashes."""
    run, end = 0, at
    while end > 0:
        start = max(0, end - 4096)
        source.seek(start)
        data = source.read(end - start)
        tail = len(data) - len(data.rstrip(b"\\"))
        run += tail
        if tail < len(data):
            break
        end = start
    return run % 2 == 1


def _chunks(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    while start < end:
        source.seek(start)
        data = source.read(min(size, end - start))
        if not data:
            return
        yield start, data
        start += len(data)


def range_effect(source, start: int, end: int, chunk: int) -> dict:
    """What a range does to the reader's state, whichever it is, and its first byte that is not blank."""
    escaped, odd, out, within, first = escaped_at(source, start), False, 0, 0, None
    for _, data in _chunks(source, start, end, chunk):
        if first is None and (rest := data.lstrip(_BLANKS)):
            first = chr(rest[0])
        odd_here, a, b = effect(data, escaped)
        # After an odd number of quotes the two cases change places.
        out, within = (out + b, within + a) if odd else (out + a, within + b)
        odd, escaped = odd != odd_here, ends_escaping(data, escaped)
    return {"odd": odd, "nests": out, "nests_inside": within, "first": first}


def string_before(source, end: int) -> str:
    """The string that ends right before a place, but for blanks."""
    size = 256
    while True:
        start = max(0, end - size)
        source.seek(start)
        data = source.read(end - start).rstrip(_BLANKS)
        opening = data.rfind(b'"', 0, max(0, len(data) - 1))
        while opening >= 0:
            run = opening - len(data[:opening].rstrip(b"\\"))
            if run == opening and start > 0:
                break  # the backslashes may go on before
            if run % 2 == 0:
                return json.loads(data[opening:].decode("utf-8", "replace"))
            opening = data.rfind(b'"', 0, opening)
        if start == 0:
            raise ValueError(f"no field name ends at byte {end}")
        size *= 8


def first_after(source, at: int) -> tuple[int, int]:
    """The first byte after a place that is not blank, and where it is."""
    while True:
        source.seek(at)
        data = source.read(256)
        rest = data.lstrip(_BLANKS)
        if rest or not data:
            return (rest[0] if rest else 0), at + len(data) - len(rest)
        at += len(data)


def range_fields(source, start: int, end: int, inside: bool, depth: int, chunk: int) -> Iterator[dict]:
    """Fields of the outermost object whose colon is in the range, and ends of lists that are their values."""
    escaped = escaped_at(source, start)
    for base, data in _chunks(source, start, end, chunk):
        found, inside, depth = marks(data, escaped, inside, depth)
        escaped = ends_escaping(data, escaped)
        told = (found.depth == 1) & ((found.byte == _COLON) | (found.byte == ord("]")))
        for at, byte in zip((found.at[told] + base).tolist(), found.byte[told].tolist()):
            if byte == _COLON:
                value, place = first_after(source, at + 1)
                yield {"pos": at, "key": string_before(source, at), "opens": place if value == ord("[") else None}
            else:
                yield {"pos": at, "key": None, "opens": None}


def range_elements(source, start: int, end: int, size: int, inside: bool, depth: int, opens: int, level: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    """`(place, text)` of the elements that begin in the range, of the list that opens at a byte and nests `level` deep."""
    escaped = escaped_at(source, start)
    held: list[bytes] | None = None
    place, ended = 0, False
    for base, data in _chunks(source, start, size, chunk):
        if held is None and base >= end:
            return
        found, inside, depth = marks(data, escaped, inside, depth)
        escaped = ends_escaping(data, escaped)
        at = found.at + base
        edge = ((found.depth == level) & (at > opens) & (found.byte == _COMMA)) | (at == opens)
        edge |= (found.depth == level - 1) & (at > opens) & (found.byte == ord("]"))
        begin = 0
        for i in np.flatnonzero(edge).tolist():
            here, stop = int(at[i]), int(found.at[i])
            if held is not None:
                held.append(data[begin:stop])
                text = b"".join(held).strip(_BLANKS)
                if text or place > opens + 1 or found.byte[i] == _COMMA:  # else an empty list
                    yield place, text
                held = None
            ended = found.byte[i] == ord("]")
            if ended or here >= end:
                return
            held, begin, place = [], stop + 1, here + 1
        if held is not None:
            held.append(data[begin:])


def large_documents(spark: SparkSession, path, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`(doc, file, size)`: the files larger than a split, from their listing alone."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("doc"), F.col("path").alias("file"), F.col("length").alias("size"))
    return files.filter(F.col("size") > split_bytes)


def _over_ranges(ranges: DataFrame, run, schema: str) -> DataFrame:
    """A task's generator over every range: dictionaries of columns added to `doc` and `start`."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = file_system(row["file"])
                with store.open_input_file(name) as source:
                    yield from run(row, source)

    return ranges.mapInArrow(apply, schema)


def _batched(rows: Iterator[dict], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _tasks(spark: SparkSession, n: int, split_bytes: int) -> int:
    """A task for every range, or for so many as `SPLIT_BYTES` hold once all cores have enough to do."""
    return max(1, min(n, max(3 * spark.sparkContext.defaultParallelism, n * split_bytes // SPLIT_BYTES)))


def _spread(df: DataFrame, n: int) -> DataFrame:
    """So many tasks: ranges are few bytes here and many where they lead."""
    return df.repartition(n)


def split_documents(spark: SparkSession, path, split_bytes: int = SPLIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Records `(rec_id, raw)` of the files larger than a split, in the order of their documents.

    Which list holds the records is decided as in `records_of_documents`; `rec_id` is the file
    and the byte an element begins at. A document that does not close what it opens, or is
    neither list nor object, gives one null `raw`. Elements are checked one by one: one that is no JSON
    gives a null. An object without a list is itself the record, and read as one.
    """
    files = large_documents(spark, path, split_bytes)
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint")))
    ranges = files.select("doc", "file", "size", start.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "size"))
    n = _tasks(spark, ranges.count(), split_bytes)

    def effects(row: dict, source) -> Iterator[pa.RecordBatch]:
        found = range_effect(source, row["start"], row["end"], chunk_bytes)
        yield pa.RecordBatch.from_pylist([row | found], _EFFECTS)

    base = "doc string, file string, size long, start long, end long"
    told = _over_ranges(_spread(ranges, n), effects, f"{base}, odd boolean, nests long, nests_inside long, first string")
    # From here on a row per range: what they begin with is a running sum.
    told = stored(told, "json-ranges")
    order = W.partitionBy("doc").orderBy("start")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    parity = F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    entered = told.withColumn("inside", parity).withColumn("step", F.when(F.col("inside"), F.col("nests_inside")).otherwise(F.col("nests")))
    entered = entered.withColumn("depth", F.coalesce(F.sum("step").over(earlier), F.lit(0)))
    roots = entered.groupBy("doc").agg(
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("start"))).alias("root"),
        (F.sum("step") == 0).alias("closed"),
        (F.sum(F.col("odd").cast("int")) % 2 == 0).alias("even"),
    )
    whole = F.col("closed") & F.col("even") & F.col("root").isin("[", "{")
    roots = stored(roots.select("doc", F.when(whole, F.col("root")).alias("root")), "json-roots")
    known = stored(entered.join(roots, "doc").select("doc", "file", "size", "start", "end", "inside", "depth", "root"), "json-entries")
    chosen = _chosen_lists(known, n, chunk_bytes)

    def elements(row: dict, source) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            if row["root"] is None or row["opens"] is None:
                if row["start"] == 0:
                    source.seek(0)
                    yield {"doc": row["doc"], "pos": 0, "text": source.read() if row["root"] else None, "whole": True}
                return
            opens = row["opens"] if row["root"] == "{" else first_after(source, 0)[1]
            if row["end"] <= opens or (row["closes"] is not None and row["start"] > row["closes"]):
                return
            found = range_elements(source, row["start"], row["end"], row["size"], row["inside"], row["depth"], opens, row["level"], chunk_bytes)
            yield from ({"doc": row["doc"], "pos": place, "text": text, "whole": False} for place, text in found)

        yield from _batched(each(), _ELEMENTS, lambda r: 64 + len(r["text"] or b""))

    read = _over_ranges(_spread(known.join(chosen, "doc"), n), elements, "doc string, pos long, text binary, whole boolean")
    text = F.col("text").cast("string")
    element = F.get(J.root_list(F.concat(F.lit("["), text, F.lit("]"))), F.lit(0))
    return read.select(F.struct("doc", "pos").alias("rec_id"), F.when(F.col("whole"), text).otherwise(element).alias("raw"))


_EFFECTS = pa.schema([
    ("doc", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
    ("odd", pa.bool_()), ("nests", pa.int64()), ("nests_inside", pa.int64()), ("first", pa.string()),
])
_FIELDS = pa.schema([("doc", pa.string()), ("pos", pa.int64()), ("key", pa.string()), ("opens", pa.int64())])
_ELEMENTS = pa.schema([("doc", pa.string()), ("pos", pa.int64()), ("text", pa.binary()), ("whole", pa.bool_())])


def _chosen_lists(known: DataFrame, n: int, chunk_bytes: int) -> DataFrame:
    """`(doc, opens, closes, level)`: where the list of records begins and ends; 0 stands for a document that is the list."""

    def fields(row: dict, source) -> Iterator[pa.RecordBatch]:
        found = range_fields(source, row["start"], row["end"], row["inside"], row["depth"], chunk_bytes)
        yield from _batched(({"doc": row["doc"], **f} for f in found), _FIELDS, lambda f: 64 + len(f["key"] or ""))

    docs = known.select("doc", "root").distinct()
    objects = known.filter("root = '{'")
    told = stored(_over_ranges(_spread(objects, n), fields, "doc string, pos long, key string, opens long"), "json-fields")
    # Of a field given twice the last value counts, at the place of the first.
    named = told.filter("key IS NOT NULL").groupBy("doc", "key").agg(F.min("pos").alias("at"), F.max(F.struct("pos", "opens"))["opens"].alias("opens"))
    rank = F.struct((F.col("key") != "data").alias("other"), F.col("at"))
    lists = named.filter("opens IS NOT NULL").groupBy("doc").agg(F.min_by("opens", rank).alias("opens"))
    ends = told.filter("key IS NULL").select("doc", F.col("pos").alias("end_at"))
    spans = lists.join(ends, "doc").filter("end_at > opens").groupBy("doc", "opens").agg(F.min("end_at").alias("closes"))
    met = docs.join(spans, "doc", "left")
    is_list = F.col("root") == "["
    return met.select(
        "doc",
        F.when(is_list, F.lit(0)).otherwise(F.col("opens")).cast("bigint").alias("opens"),
        "closes",
        F.when(is_list, 1).otherwise(2).alias("level"),
    )
