import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from lecturelake.llm import topk, warc


def record(kind, block, *more, content="application/http; msgtype=response", rid="<urn:uuid:1f0a8c1e-0000-4000-8000-000000000001>"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2024-05-01T10:00:00Z", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_of_other_writers(spark):
    page = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n two\r\n"
    records = [
        record("warcinfo", b"software: x\r\n", content="application/warc-fields"),
        record("response", http + b"\r\n" + page, "WARC-Target-URI: http://a.org/x%20y?q=%C3%BC", f"WARC-Payload-Digest: {sha1(page)}"),
        record("response", http + b"Transfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n" + page, "WARC-Concurrent-To: <urn:uuid:2>", "WARC-Concurrent-To: <urn:uuid:3>"),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Refers-To: <urn:uuid:7>", f"WARC-Payload-Digest: {sha1(page)}"),
        record("metadata", b"k: v\r\n", content="application/warc-fields"),
        record("response", b"a.org 1.2.3.4", content="text/dns"),
        record("request", b"GET / HTTP/1.1\r\nHost: a.org\r\n\r\n", content="application/http; msgtype=request"),
    ]
    bad = [record("response", http + b"\r\n" + page, f"WARC-Payload-Digest: {sha1(b'other')}"), record("response", http + b"Content-Length: 3\r\n\r\n" + page), record("response", page, rid="none"), record("response", page)]
    content = b"".join(zstandard.ZstdCompressor().compress(r) for r in records + bad)
    rows = warc.read_archives(spark.createDataFrame([("a", content)], "archive string, content binary"), on_error="report").orderBy("record").collect()
    assert [r.error is None for r in rows] == [True] * len(records) + [False] * len(bad)
    assert [r.record_type for r in rows[:7]] == ["warcinfo", "response", "response", "revisit", "metadata", "response", "request"]
    assert rows[1].url == "http://a.org/x%20y?q=%C3%BC" and rows[1].page_id is None and rows[1].record_id.startswith("<urn:uuid:")
    assert all(bytes(rows[i].payload) == page and rows[i].payload_digest == hashlib.sha256(page).hexdigest() for i in (1, 2))
    assert rows[3].payload is None and rows[3].payload_digest == sha1(page) and rows[3].refers_to_id == "<urn:uuid:7>" and rows[3].refers_to is None
    assert bytes(rows[5].payload) == b"a.org 1.2.3.4"


def test_addresses_stay_as_they_are(spark):
    urls = ["http://a.org/x%20y", "http://a.org/%", "http://a/ü b%41", "http://[::1]/a?b=c#d", "", None, "x\r\nWARC-Type: y", 'a"<>\\^`{|}']
    for url in urls:
        raw = warc.record_bytes(1, url, b"p", hashlib.sha256(b"p").hexdigest())
        assert warc.parse_record(raw)["url"] == url
    raw = warc.record_bytes(1, urls[0], b"p", hashlib.sha256(b"p").hexdigest())
    assert b"WARC-Target-URI: http://a.org/x%20y\r\n" in raw and b"X-Page" not in raw
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(raw.replace(b"sha256:1", b"sha256:2").replace(b"sha256:", b"sha256:0", 1))


def test_queries_that_repeat_a_key_take_the_least_vector(spark):
    rows = [(0, [0.5, 0.0]), (0, [0.0, 0.5]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>").repartition(3)
        assert [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, 1).collect()] == [(1, 1, 512 * 1024)]
