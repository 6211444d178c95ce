"""WARC archives compressed by Zstandard with a dictionary per archive.

An archive starts with a skippable frame that holds the dictionary; every record is one frame.
A task writes its rows into archives of a bounded size. The reader walks the frames of an
archive one after another and checks every header and length, so it holds one record at a time
besides the archive's bytes. Of rows with equal payloads, the one with the smallest id is
written in full and the others refer to it.

Null payloads are written as empty ones. A row without an id is written; it can refer to a row
with an id but no row refers to it. Rows that repeat the smallest id are all written in full.
Control characters of a URL are percent-encoded; a null URL leaves the header out.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm.common import small_side, store
from paneltide.llm.registry import query, table

#: Fixed values of the format: magic numbers of the dictionary frame and of a data frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None, date: str) -> bytes:
    """One record; without its payload if it refers to another row."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode("ascii")
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of the records; a dictionary of their first ones, as raw content."""
    content, size = [], 0
    for record in records:
        content.append(record[:DICTIONARY_BYTES - size])
        size += len(content[-1])
        if size >= DICTIONARY_BYTES:
            break
    raw = b"".join(content)
    frames = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw]
    given = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
    writer = zstd.ZstdCompressor(level=3, dict_data=given, write_checksum=True)
    frames += [writer.compress(record) for record in records]
    return b"".join(frames)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive."""
    data = memoryview(content)
    reader, at = zstd.ZstdDecompressor(), 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(data[8:8 + size])
                if len(raw) != size:
                    raise ValueError("dictionary is cut off")
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstd.ZstdDecompressor().decompress(raw)
                if len(raw) >= 8:
                    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(data, at)
        yield reader.decompressobj().decompress(data[at:end])
        at = end


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if not sep or not name.strip():
            raise ValueError(f"not a header line: {line[:60]!r}")
        out[name.strip().decode("ascii").lower()] = value.strip().decode("utf-8")
    return out


def number(text: str, what: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"{what} is not a number: {text[:40]!r}")
    return int(text)


def page_of(reference: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", reference)
    if not found:
        raise ValueError(f"not a record id: {reference[:60]!r}")
    return int(found[1]) if found[1] else None


def parse(record: bytes) -> tuple:
    """(page id, url, type, refers to, payload bytes, payload digest, payload) of one record."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    own = fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in own:
            raise ValueError(f"{name} is missing")
    size = number(own["content-length"], "content-length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block has {len(rest) - 4} bytes instead of {size}")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not sep or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = number(fields(lines).get("content-length", ""), "HTTP content-length")
    digest = own.get("warc-payload-digest", "").removeprefix("sha256:")
    if own["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in own:
            raise ValueError("revisit with a payload or without a reference")
        refers_to, payload = page_of(own["warc-refers-to"]), None
    elif own["warc-type"] == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload does not match its length or digest")
        refers_to = None
    else:
        raise ValueError(f"unknown type {own['warc-type'][:40]!r}")
    return (page_of(own["warc-record-id"]), own.get("warc-target-uri"), own["warc-type"], refers_to,
            length, digest, payload)


def mark_repeats(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of (page_id, url, html).

    Only digests that occur twice are looked up, so that their table is small as a rule; it is
    broadcast if its counted size allows it.
    """
    full = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    full = full.withColumn("digest", F.sha2("payload", 256))
    first = store(full.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
                  .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                  .where("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeats")
    return (full.join(small_side(first, 120), "digest", "left")
            .withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")),
                                            F.col("first")))
            .select("page_id", "url", "payload", "digest", "refers_to"))


def write_archives(marked: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, content): the rows of ``mark_repeats`` in archives of about ``ARCHIVE_BYTES``."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            nonlocal done, held, size
            name, content = f"part-{part:05d}-{done:05d}.warc.zst", pack(held)
            done, held, size = done + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())],
                                              names=["archive", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record_bytes(*row, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
        if held:
            yield archive()

    return (marked.select("page_id", "url", "payload", "digest", "refers_to")
            .mapInArrow(run, "archive string, content binary"))


READ_SCHEMA = ("archive string, record_no bigint, page_id bigint, url string, record_type string, "
               "refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string")


def read_archives(archives: DataFrame, keep_errors: bool = False, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives (archive, content).

    A malformed archive stops the job, or with ``keep_errors`` gives one row with ``error``
    after the records before the fault.
    """
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
             pa.string(), pa.binary(), pa.string()]

    def read(name: str, content: bytes | None) -> Iterator[tuple]:
        at = 0
        try:
            for frame in frames(content or b""):
                page_id, url, kind, refers_to, size, digest, payload = parse(frame)
                yield name, at, page_id, url, kind, refers_to, size, digest, payload if with_payload else None, None
                at += 1
        except (ValueError, UnicodeError, IndexError, zstd.ZstdError) as fault:
            if not keep_errors:
                raise ValueError(f"{name}, record {at}: {fault}") from fault
            yield name, at, None, None, None, None, None, None, None, str(fault)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for row in read(name, content):
                    rows.append(row)
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return archives.select("archive", "content").mapInArrow(run, READ_SCHEMA)


def read_files(spark: SparkSession, path: str, keep_errors: bool = False) -> DataFrame:
    """Records of the ``.warc.zst`` files under ``path``, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return read_archives(files.select(F.col("path").alias("archive"), "content"), keep_errors)


@query("op10_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM q""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = store(write_archives(mark_repeats(table(spark, sf_dir, "pages"))), "archives")
    return (read_archives(archives, with_payload=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
