import base64
import gzip
import hashlib
import io
import random

import pytest

from chatprep.llm import warc as W

SCHEMA = "page_id long, url string, html string, page string, payload string, first string, salt int, revisits string, record_type string"


def pages(rng, n):
    texts = ["", "ä" * 5, *(f"<p>{i}</p>" * rng.randint(1, 400) for i in range(n // 3))]
    rows = [(i, f"http://x.example/{i}", rng.choice(texts)) for i in rng.sample(range(10_000), n)]
    rows += [(rows[0][0], "http://again.example", rows[0][2]), rows[1], (None, None, rows[2][2]), (None, "http://null.example", None)]
    rows += [(20_000, "http://x.example/a b\r\nWARC-Type: fake\x00é", "odd address"), (20_001, "", "big " * 1_500_000)]
    return rows


def brute(rows, min_bytes=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        smallest = first.get(html or "")
        same = smallest is None or page == smallest or len(body) < min_bytes
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((None if page is None else str(page), len(body), sha, "response" if same else "revisit", None if same else str(smallest)))
    return sorted(out, key=repr)


def seen(df):
    return sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("min_bytes, archive_bytes, split_bytes", [(0, 1 << 30, 1 << 26), (12, 20_000, 301), (0, 5_000, 64)])
def test_round_trip(spark, min_bytes, archive_bytes, split_bytes):
    """Ranges shorter than a record, archives of a few records, copies, nulls, a payload of 6 MB."""
    rows = pages(random.Random(split_bytes), 90)
    df = spark.createDataFrame([(*r, "a", "b", "c", 1, "d", "e") for r in rows], SCHEMA).repartition(3)
    folder = W.write(df, min_bytes=min_bytes, archiveBytes=str(archive_bytes), date="2024-01-01T00:00:00Z")
    got = W.read(spark, folder, split_bytes=split_bytes)
    assert seen(got) == brute(rows, min_bytes)
    assert seen(W.read(spark, folder, payload=False, split_bytes=split_bytes)) == brute(rows, min_bytes)
    texts = {(None if p is None else str(p), (h or "").encode()) for p, _, h in rows}
    assert all((r["record_id"], bytes(r["payload"])) in texts for r in got.filter("record_type = 'response'").collect())
    odd = got.filter("record_id = '20000'").first()
    assert odd["target_uri"] == "http://x.example/a%20b%0D%0AWARC-Type:%20fake%00%C3%A9"


def member(head, body=b""):
    return gzip.compress(b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")


def scanned(data, split):
    found = []
    for start in range(0, len(data), split):
        found += list(W.records_in(io.BytesIO(data), W.ByteRange("test", start, min(len(data), start + split), len(data)), True))
    return found


def test_archives_of_others():
    """Records of other kinds, payloads without an HTTP header, junk and false magic between and inside records."""
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(3000))
    false = W._MAGIC + b"\x00" * 40
    parts = [
        member(b"WARC-Type: warcinfo\r\n", b"software: x"),
        member(b"warc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\n", noise + false + noise),
        noise + false + gzip.compress(b"no archive"),
        member(b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http; msgtype=response\r\n", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore"),
        member(b"WARC-Type: request\r\n", b"GET /"),
        member(b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:2>\r\nWARC-Payload-Digest: sha1:ABC\r\n"),
    ]
    data = b"".join(parts)
    for split in (len(data), 997, 100, 7):
        found = scanned(data, split)
        assert [(r["record_id"], r["payload"]) for r in found] == [("urn:uuid:1", noise + false + noise), ("urn:uuid:2", b"body\r\n\r\nmore"), ("urn:uuid:3", None)]
        assert (found[2]["refers_to"], found[2]["payload_digest"], found[2]["payload_bytes"]) == ("urn:uuid:2", "ABC", None)


def test_damage_is_an_error():
    whole = member(b"WARC-Type: response\r\n", b"x" * 5000 + bytes(range(256)) * 9)
    with pytest.raises(ValueError, match="cut off"):
        scanned(whole[:-20], 10_000)
    wrong = member(b"WARC-Type: response\r\nWARC-Payload-Digest: sha1:ABC\r\n", b"x")
    with pytest.raises(ValueError, match="does not agree"):
        scanned(wrong, 10_000)


def test_no_rows(spark):
    folder = W.write(spark.createDataFrame([], SCHEMA))
    assert W.read(spark, folder).collect() == []
