"""WARC archives: pages as records of their own gzip members, and a reader that splits archives by bytes.

Both are data sources. The writer's tasks append records to archives of bounded size; the
job's commit moves the finished ones of the tasks that count into the folder. The reader cuts
every archive into byte ranges. A task looks for the magic bytes of a gzip member from its
range's start on, takes a place for a record's beginning if a WARC header can be decoded from
it, and goes on from record to record while they begin inside the range; the last one is read
to its end wherever that is.

Folders are opened by `pyarrow.fs`: local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from chatprep.llm.frames import hint_small
from chatprep.sources.shared import new_folder, stored

SPLIT_BYTES = 64 << 20
ARCHIVE_BYTES = 1 << 30
SUFFIX = ".warc.gz"
SCHEMA = "record_type string, record_id string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to string"
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_HEAD = 1 << 16
_BLANK_LINE = b"\r\n\r\n"
_BATCH_BYTES = 16 << 20
_SALTS = 16
_PAGE, _NO_PAGE = "urn:page:", "urn:page-without-id"
_PENDING = "_pending"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path or URI is in, and the path within."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def page_urn(page: str | None) -> str:
    return _NO_PAGE if page is None else _PAGE + quote(page, safe="-._~")


def page_of(urn: str | None) -> str | None:
    """The id that `page_urn` made a name of; other names as they are."""
    if urn is None or urn == _NO_PAGE:
        return None
    return unquote(urn[len(_PAGE) :]) if urn.startswith(_PAGE) else urn


def record(page: str | None, url: str | None, payload: bytes, revisits: bool, first: str | None, date: str) -> bytes:
    """A gzip member with a response, or with a revisit that keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _BLANK_LINE
    block = http if revisits else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <{page_urn(page)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha1_base32(hashlib.sha1(payload).digest())}")
    if revisits:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{page_urn(first)}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + _BLANK_LINE
    return squeeze.compress(head) + squeeze.compress(block) + squeeze.compress(_BLANK_LINE) + squeeze.flush()


# All printable ASCII but the blank: white space and control characters would break the header.
_URL_SAFE = "".join(map(chr, range(33, 127)))


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.archive_bytes = int(options.get("archivebytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        store, folder = file_system(self.path)
        pending = f"{folder}/{_PENDING}"
        store.create_dir(pending, recursive=True)
        task = TaskContext.get().partitionId()
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for page, url, payload, revisits, first in zip(*(batch[n].to_pylist() for n in ("page", "url", "payload", "revisits", "first"))):
                member = record(page, url, payload, revisits, first, self.date)
                if out is None or size + len(member) > self.archive_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{task:05d}-{len(names):04d}-{uuid.uuid4().hex}{SUFFIX}")
                    out, size = store.open_output_stream(f"{pending}/{names[-1]}", compression=None), 0
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return Archives(names)

    def commit(self, messages: list[Archives | None]) -> None:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{folder}/{_PENDING}/{name}", f"{folder}/{name}")
        self._forget(store, folder)

    def abort(self, messages: list[Archives | None]) -> None:
        self._forget(*file_system(self.path))

    @staticmethod
    def _forget(store: fs.FileSystem, folder: str) -> None:
        """Also what tasks left that were run twice."""
        if store.get_file_info(f"{folder}/{_PENDING}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{_PENDING}")


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    end: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[ByteRange]:
        store, folder = file_system(self.path)
        info = store.get_file_info(folder)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        archives = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))
        ranges = [ByteRange(p, a, min(n, a + self.split), n) for p, n in archives for a in range(0, n, self.split)]
        # A read without partitions is not planned.
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, _ = file_system(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.name) as source:
            for found in records_in(source, partition, self.payload):
                rows.append(found)
                held += 256 + len(found["payload"] or b"")
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


_ARROW = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
])


class WarcSource(DataSource):
    """Options: `path`; for reading `splitBytes` and `payload` (false: only its size and digest are read);
    for writing `archiveBytes` and `date`."""

    @classmethod
    def name(cls) -> str:
        return "chatprep_warc"

    def schema(self) -> str:
        return SCHEMA

    def _lowered(self) -> dict[str, str]:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def reader(self, schema) -> _Reader:
        return _Reader(self._lowered())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._lowered())


def records_in(source, part: ByteRange, payload: bool) -> Iterator[dict]:
    """The responses and revisits of all records that begin inside the range."""
    at = next_member(source, part.start, part.end, part.size)
    while at is not None and at < part.end:
        found, stop = read_record(source, at, part.size, payload, part.name)
        if found:
            yield found
        at = stop if stop >= part.end or begins_record(source, stop) else next_member(source, stop, part.end, part.size)


def next_member(source, start: int, end: int, size: int) -> int | None:
    """The first place in [start, end) at which a record begins."""
    overlap = len(_MAGIC) - 1
    at = start
    while at < end:
        source.seek(at)
        data = source.read(min(_READ, end - at) + overlap)
        i = data.find(_MAGIC)
        while i >= 0 and at + i < end:
            if begins_record(source, at + i):
                return at + i
            i = data.find(_MAGIC, i + 1)
        at += _READ
    return None


def begins_record(source, at: int) -> bool:
    """Whether a gzip member with a WARC header can be decoded from here."""
    source.seek(at)
    data = source.read(_HEAD)
    if not data.startswith(_MAGIC) or len(data) < 18 or data[3] & 0xE0:
        return False
    try:
        head = zlib.decompressobj(31).decompress(data, _HEAD)
    except zlib.error:
        return False
    return head.startswith(b"WARC/") and (b"\r\ncontent-length:" in head.lower() or _BLANK_LINE not in head)


def _inflated(source, at: int, size: int, ends: list[int], name: str) -> Iterator[bytes]:
    """The member's bytes piece by piece; `ends` receives where it ends."""
    inflate = zlib.decompressobj(31)
    source.seek(at)
    place = at
    try:
        while not inflate.eof:
            data = inflate.unconsumed_tail
            if not data:
                data = source.read(_READ)
                place += len(data)
                if not data:
                    raise ValueError(f"{name}: the record at byte {at} is cut off at byte {size}")
            piece = inflate.decompress(data, _READ)
            if piece:
                yield piece
    except zlib.error as error:
        raise ValueError(f"{name}: the record at byte {at} cannot be decoded: {error}") from error
    ends.append(place - len(inflate.unused_data))


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _until_blank_line(held: bytes, pieces: Iterator[bytes]) -> tuple[bytes, bytes]:
    """What comes before the first blank line, and what has been read after it."""
    while _BLANK_LINE not in held:
        piece = next(pieces, None)
        if piece is None:
            break
        held += piece
    head, _, rest = held.partition(_BLANK_LINE)
    return head, rest


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_record(source, at: int, size: int, payload: bool, name: str) -> tuple[dict | None, int]:
    """The record that begins at a byte, or None if it is of another kind, and where it ends."""
    ends: list[int] = []
    pieces = _inflated(source, at, size, ends, name)
    head, rest = _until_blank_line(b"", pieces)
    told = _headers(head)
    kind = told.get("warc-type")
    if kind not in ("response", "revisit"):
        for _ in pieces:
            pass
        return None, ends[0]
    left = int(told["content-length"])
    http: dict[str, str] = {}
    if told.get("content-type", "").startswith("application/http"):
        block, after = _until_blank_line(rest, pieces)
        http, left, rest = _headers(block), left - len(block) - len(_BLANK_LINE), after
    sha, kept, n = hashlib.sha1(), [], 0
    while True:
        body = rest[: max(0, left - n)]
        n += len(body)
        sha.update(body)
        if payload:
            kept.append(body)
        rest = next(pieces, None)
        if rest is None:
            break
    if kind == "response" and n != max(0, left):
        raise ValueError(f"{name}: the record at byte {at} holds {n} of {left} payload bytes")
    digest = told.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        found = sha1_base32(sha.digest())
        if digest not in (None, found):
            raise ValueError(f"{name}: the payload of the record at byte {at} does not agree with its digest")
        digest = found
    whole = http.get("content-length")
    out = {
        "record_type": kind,
        "record_id": page_of(_bare(told.get("warc-record-id"))),
        "target_uri": told.get("warc-target-uri"),
        "payload": b"".join(kept) if payload and kind == "response" else None,
        "payload_bytes": n if kind == "response" else int(whole) if whole else None,
        "payload_digest": digest,
        "refers_to": page_of(_bare(told.get("warc-refers-to"))) if kind == "revisit" else None,
    }
    return out, ends[0]


def revisited(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages `(page, url, payload, revisits, first)`: whether another has the payload and a smaller id, and the smallest."""
    print_of = [F.sha2("payload", 256).alias("print"), F.octet_length("payload").alias("n_bytes")]
    slim = stored(pages.select("page", *print_of), "prints")
    same = slim.filter(F.col("n_bytes") >= min_bytes).groupBy("print", "n_bytes").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    firsts = same.filter("n > 1").select("print", "n_bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(_SALTS)).cast("int"))
    copies = salted.join(hint_small(stored(firsts, "firsts")), ["print", "n_bytes", "salt"]).filter("first IS NOT NULL AND NOT (page <=> first)")
    # Pages stay where they are if few are copies, and else meet by their own id and payload: copies spread over tasks.
    marks = hint_small(stored(copies.select(F.col("page").alias("copy"), F.col("print").alias("copy_print"), "first").distinct(), "copies"))
    whole = pages.withColumn("print", print_of[0])
    met = whole.join(marks, F.col("page").eqNullSafe(F.col("copy")) & (F.col("print") == F.col("copy_print")), "left")
    return met.select("page", "url", "payload", F.col("copy_print").isNotNull().alias("revisits"), "first")


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, **options: str) -> str:
    """Writes a record for every row into archives in `folder` (a new one in the shared folder) and returns it.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the smallest id is
    written as a response and the others as revisits of it; a null id is greater than all,
    and rows that repeat the smallest id are all responses. A null payload is empty, a null
    address is left out, and ids and addresses of any text are escaped. A payload of any
    length is a record. Other columns are not written. An empty table leaves an empty folder.
    """
    session = df.sparkSession
    session.dataSource.register(WarcSource)
    folder = folder or new_folder(session, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    told = revisited(pages, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page", "first")})
    told.write.format(WarcSource.name()).options(**options).mode("append").save(folder)
    return folder


def read(spark: SparkSession, folder: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows `SCHEMA`: responses and revisits of all archives in a folder, or of one archive.

    Digests (SHA-1, base32) and sizes are those of the whole payload, of revisits as their
    record tells them. Records of other kinds are passed over, as is what lies between
    records; one that is cut off or does not agree with its digest is an error. A payload
    that holds whole gzipped WARC records of its own, stored without compression, could be
    taken for them if a range begins in it.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format(WarcSource.name()).options(payload=str(payload).lower(), splitBytes=str(split_bytes)).load(folder)
