"""Zstandard-compressed WARC archives: a dictionary in the leading skippable frame, then one frame per record.

Archives are rows (archive, content): the writer makes them inside tasks and they are stored through Spark, so any
file system that Spark reaches will do; `spark.read.format("binaryFile")` gives the same shape for .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats: magic numbers of a zstd frame and of the skippable frame that holds a dictionary.
ZSTD_MAGIC, DICTIONARY_MAGIC = 0xFD2FB528, 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d{1,9})?Z"

ARCHIVE_BYTES = 4 << 20
RECORD_SCHEMA = "archive string, record int, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string, record_id string, refers_to_id string"


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


def mark_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """key, url, payload (UTF-8; null: empty), payload_digest, first: the smallest key with that payload.

    Payloads under `least` bytes get no first. Rows that repeat the smallest key stay responses; a null key is larger
    than any other, and where all keys are null every row is a response. Digests are counted first; then every payload of
    `least` bytes or more meets the first key of its digest, by a shuffle where the repeated digests are too many to be
    broadcast. Smaller ones, which often are the same, meet nothing and are dealt out by their key.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    repeated = rows.filter(F.length("payload") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1").drop("n")
    meets = F.when(F.length("payload") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.xxhash64("url", "payload")).cast("string")))
    return rows.withColumn("meets", meets).join(repeated.withColumnRenamed("payload_digest", "meets"), "meets", "left").select("page_id", "url", "payload", "payload_digest", "first")


def train_dictionary(pages: DataFrame, html: str = "html", sample: int = 200, size: int = 32 << 10) -> bytes:
    """A dictionary from a bounded sample: `sample` distinct pages, least hashes first, and 20,000 characters of each.

    Hashes alone are ordered; only the pages picked are read for their text. Empty where the sample is too thin to train
    on.
    """
    rows = pages.filter(F.length(html) > 0).select(F.xxhash64(html).alias("h"), F.substring(html, 1, 20_000).alias("t"))
    least = rows.select("h").distinct().orderBy("h").limit(sample)
    picked = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(sample).collect()
    texts = [r.t.encode() for r in picked]
    if len(texts) < 20:
        return b""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit whose block ends after the HTTP header.

    The URI stands as it is, but for characters that no URI holds, which are escaped; then the address itself, escaped
    throughout, stands in a header of its own beside it.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:
            head.append("X-Page-Address: " + quote(url, safe=""))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Rows of mark_revisits to (archive string, content binary), a new archive whenever one has reached archive_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)
        part = TaskContext.get().partitionId()
        parts, size, made = [dictionary_frame(dictionary)], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{made:05d}.warc.zst"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, first = (batch.column(j)[i].as_py() for j in range(5))
                revisit = first is not None and first != page_id
                frame = squeeze.compress(record_bytes(page_id, url, payload, digest, first, revisit))
                parts.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield archive()
                    parts, size, made = [dictionary_frame(dictionary)], 0, made + 1
        if size:
            yield archive()

    return marked.select("page_id", "url", "payload", "payload_digest", "first").mapInArrow(run, "archive string, content binary")


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstd frame that begins at `at` ends, from its header and block headers."""
    try:
        if struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        checksum = bool(data[at + 4] & 4)
        end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
        while True:
            head = int.from_bytes(data[end : end + 3], "little")
            if end + 3 > len(data):
                raise ArchiveError("the archive ends inside a frame")
            kind, size = head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
            if head & 1:
                break
    except (struct.error, zstandard.ZstdError, IndexError) as e:
        raise ArchiveError(f"bad frame at byte {at}: {e}") from None
    end += 4 * checksum
    if end > len(data):
        raise ArchiveError("the archive ends inside a frame")
    return end


def leading_dictionary(data: memoryview) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame (itself compressed or not) and where the next frame begins."""
    if len(data) < 8 or struct.unpack_from("<I", data, 0)[0] != DICTIONARY_MAGIC:
        return b"", 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ArchiveError("the dictionary's frame is cut off")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw, 8 + size


def _fields(lines: list[str], what: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ArchiveError(f"bad {what} line {line[:60]!r}")
        if name.lower() in out and (name.lower() == "content-length" or what == "header" and name.lower() != "warc-concurrent-to"):
            raise ArchiveError(f"{what} {name} is repeated")
        out[name.lower()] = value.strip()
    return out


def _length(fields: dict[str, str]) -> int:
    if not re.fullmatch(r"[0-9]+", value := fields.get("content-length", "")):
        raise ArchiveError("Content-Length is missing or no number")
    return int(value)


def _page(value: str | None) -> int | None:
    """The key in a record id that record_bytes has written; null for other ids."""
    m = re.fullmatch(r"<urn:page:(-?\d*)>", value or "")
    return int(m[1]) if m and m[1] else None


def _checked(stated: str | None, data: bytes, what: str) -> None:
    """Compare data with a digest `algorithm:value`, the value in hex or base32; algorithms that hashlib lacks aren't told."""
    if stated is None:
        return
    name, colon, value = stated.partition(":")
    if not colon or not value:
        raise ArchiveError(f"{what} is malformed")
    name = name.lower().replace("-", "")
    if name in hashlib.algorithms_guaranteed and not name.startswith("shake"):
        found = hashlib.new(name, data)
        if value.lower() != found.hexdigest() and value.upper().rstrip("=") != base64.b32encode(found.digest()).decode().rstrip("="):
            raise ArchiveError(f"{what} is not that of what is there")


def parse_record(raw: bytes) -> dict:
    """Check one record's version, headers, lengths and digests.

    Of HTTP messages the payload is what follows their header; of all other records (warcinfo, metadata, resource and the
    like) it is the whole block. payload_digest is the payload's SHA-256, or what a revisit states, without "sha256:".
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "strict")).split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("no WARC header")
    fields = _fields(lines[1:], "header")
    size = _length(fields)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length {size} is not that of the block")
    if not re.fullmatch(DATE, fields.get("warc-date", "")):
        raise ArchiveError("WARC-Date is missing or malformed")
    kind, record_id = fields.get("warc-type"), fields.get("warc-record-id")
    if not kind or not re.fullmatch(r"<[^<>\s]+>", record_id or ""):
        raise ArchiveError("WARC-Type or WARC-Record-ID is missing or malformed")
    block = rest[:size]
    _checked(fields.get("warc-block-digest"), block, "WARC-Block-Digest")
    payload, n, stated = block, size, fields.get("warc-payload-digest")
    if fields.get("content-type", "").lower().startswith("application/http") and kind in ("response", "revisit", "request"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, *more = re.sub(r"\r\n[ \t]+", " ", http.decode("latin-1")).split("\r\n")
        if not gap or not (status.startswith("HTTP/") or kind == "request"):
            raise ArchiveError("no HTTP header")
        more = _fields(more, "HTTP header")
        told = "content-length" in more and "transfer-encoding" not in more
        n = _length(more) if told else len(payload)
        if kind == "response" and len(payload) != n and "warc-truncated" not in fields:
            raise ArchiveError("the payload doesn't have the length stated")
    if kind == "revisit":
        if payload:
            raise ArchiveError("a revisit with a payload")
        digest = stated.removeprefix("sha256:") if stated else None
    else:
        _checked(stated, payload, "WARC-Payload-Digest")
        digest = hashlib.sha256(payload).hexdigest()
    refers = fields.get("warc-refers-to") if kind == "revisit" else None
    address = fields.get("x-page-address")
    return {
        "page_id": _page(record_id), "url": fields.get("warc-target-uri") if address is None else unquote(address), "record_type": kind, "refers_to": _page(refers),
        "payload": None if kind == "revisit" else payload, "payload_bytes": n, "payload_digest": digest, "record_id": record_id, "refers_to_id": refers,
    }


def read_archives(archives: DataFrame, name: str = "archive", content: str = "content", on_error: str = "raise", with_payload: bool = True) -> DataFrame:
    """Records of archives (RECORD_SCHEMA), one frame each, of any type and by any writer; page_id and refers_to are null where
    the ids are not those of record_bytes.

    on_error "raise" ends the query at the first bad record; "report" gives it a row with what is wrong in `error`
    and goes on with the next frame, if the frame's end can be told. Null or empty content has no records.
    """

    def records(label: str, data: memoryview) -> Iterator[dict]:
        try:
            dictionary, at = leading_dictionary(data)
        except (ArchiveError, zstandard.ZstdError) as e:
            yield {"record": None, "error": str(e)}
            return
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        k = 0
        while at < len(data):
            try:
                end = frame_end(data, at)
            except ArchiveError as e:
                yield {"record": k, "error": str(e)}
                return
            try:
                yield {"record": k, **parse_record(expand.decompress(bytes(data[at:end]), max_output_size=1 << 31))}
            except (ArchiveError, zstandard.ZstdError, UnicodeDecodeError) as e:
                yield {"record": k, "error": str(e)}
            at, k = end, k + 1

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"record": pa.int32(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                rows = []
                for row in records(label, memoryview(data) if data is not None else memoryview(b"")):
                    if row.get("error") and on_error == "raise":
                        raise ArchiveError(f"{label}, record {row['record']}: {row['error']}")
                    if not with_payload:
                        row["payload"] = None
                    rows.append({"archive": label} | row)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

    return archives.select(F.col(name).cast("string"), F.col(content)).mapInArrow(run, RECORD_SCHEMA)
