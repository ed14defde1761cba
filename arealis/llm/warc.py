"""WARC archives: one gzip member per record, written and read by Spark.

Writing: of records with equal payloads of at least ``least`` bytes the one with
the largest id is a response and the others revisit it. Archives are files of
concatenated gzip members in any folder that Spark can write.

Reading: every file is read from its start, member by member. Inflation is
incremental, so a record is held as far as its headers and one buffer say, its
block is framed by Content-Length, and block and payload digests are verified.
What is not a sound record raises, with the file and the place.

A null payload is empty; a null id makes a record without one, never referred
to. Repeated ids are separate records; if theirs is the largest id of a payload,
all of them are responses. Without rows an archive folder is empty and reads as no
records. Payloads are kept whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_map, stored

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
BUFFER = 1 << 16
#: Records of one archive.
RECORDS = 20_000

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(number: int | None) -> str:
    """Record id: the number is readable from it."""
    return f"<urn:x-record:{'' if number is None else number}>"


def member(record_id, uri, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", urn(record_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(uri)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([pack.compress(VERSION + b"\r\n" + head + b"\r\n"), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()])


def _line(uri: str | None) -> str | None:
    """A header value stays on its line."""
    return uri and uri.replace("\r", "%0D").replace("\n", "%0A")


class Inflated:
    """Bytes of consecutive gzip members, inflated a buffer at a time."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.held = data, 0, b""
        self.unpack = None

    def next_member(self) -> bool:
        if self.at >= len(self.data):
            return False
        self.unpack, self.held = zlib.decompressobj(31), b""
        return True

    def _more(self) -> bool:
        if self.unpack.eof:
            return False
        part = self.unpack.unconsumed_tail
        if not part:
            part = self.data[self.at : self.at + BUFFER]
            self.at += len(part)
        got = self.unpack.decompress(part, BUFFER)
        if not len(part) and not got and not self.unpack.eof:
            raise ValueError("the file ends inside a member")
        self.held += got
        if self.unpack.eof:
            self.at -= len(self.unpack.unused_data)
        return True

    def empty(self) -> bool:
        """Whether nothing is in the member."""
        while not self.held and self._more():
            pass
        return not self.held

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            if not self._more():
                raise ValueError("a header line without end")
        out, _, self.held = self.held.partition(b"\r\n")
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while True:
            parts.append(self.held[: n - have])
            self.held = self.held[n - have :]
            have += len(parts[-1])
            if have == n:
                return b"".join(parts)
            if not self._more():
                raise ValueError("a block shorter than its Content-Length")

    def end(self) -> None:
        while self._more():
            pass
        if self.held:
            raise ValueError("bytes behind a record")


def records(data: memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of every record of an archive, in order."""
    stream = Inflated(data)
    while stream.next_member():
        place = stream.at
        if stream.empty():
            continue
        if not stream.line().startswith(b"WARC/"):
            raise ValueError(f"no record at byte {place}")
        head: dict[str, str] = {}
        while line := stream.line():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.take(int(head["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {place} isn't closed")
        stream.end()
        if (said := head.get("warc-block-digest")) and said != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"block digest of the record at byte {place}")
        yield place, head, block


def _number(said: str | None) -> int | None:
    digits = (said or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _parsed(path: str, data) -> Iterator[tuple]:
    try:
        for at, head, block in records(memoryview(data)):
            kind = head.get("warc-type")
            if kind not in ("response", "revisit"):
                continue
            _, _, payload = block.partition(b"\r\n\r\n")
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response" and digest and digest != sha1_base32(payload):
                raise ValueError(f"payload digest of the record at byte {at}")
            yield (
                path, at, _number(head.get("warc-record-id")), kind, head.get("warc-target-uri"), digest,
                _number(head.get("warc-refers-to")), len(payload) if kind == "response" else None, payload if kind == "response" else None,
            )
    except (ValueError, KeyError, zlib.error) as e:
        raise ValueError(f"{path}: {e}") from e


def with_revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", uri_col: str = "url", least: int = 0) -> DataFrame:
    """Rows (id, uri, text, digest, response) with the id each record refers to.

    ``response`` is the id of the response with the same payload, ``revisit`` says
    whether the row refers to it. Payloads are told apart by digest and length.
    """
    digest = column_map(lambda ts: [sha1_base32((t or "").encode()) for t in ts], T.StringType())
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(text_col).alias("text"))
    rows = rows.withColumn("size", size).withColumn("digest", digest(F.col("text")))
    best = rows.groupBy("digest", "size").agg(F.max("id").alias("response"))
    joined = rows.join(best, ["digest", "size"])
    return joined.withColumn("revisit", F.coalesce((F.col("size") >= least) & (F.col("id") != F.col("response")), F.lit(False)))


def write_archives(pages: DataFrame, path: str, records_per_archive: int = RECORDS, **columns) -> None:
    """Write every row of ``pages`` as a record into archives under ``path``.

    An archive goes to the text writer as one row. A gzip member ends in the
    highest byte of its length, zero below 16 MiB; that byte is what the writer
    adds behind the row. Behind a larger record stands an empty member.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0

        def closed():
            if held[-1][-1]:
                held.append(zlib.compress(b"", wbits=31))
            data = b"".join(held)
            return pa.RecordBatch.from_pydict({"value": pa.array([data[:-1]], pa.binary())})

        for b in batches:
            for number, uri, text, digest, response, revisit in zip(*(b.column(i).to_pylist() for i in range(6))):
                held.append(member(number, uri, (text or "").encode(), digest, response, revisit))
                size += len(held[-1])
                count += 1
                if count >= records_per_archive or size >= 64 << 20:
                    yield closed()
                    held, count, size = [], 0, 0
        if held:
            yield closed()

    rows = with_revisits(pages, **columns).select("id", "uri", "text", "digest", "response", "revisit")
    made = rows.mapInArrow(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).mode("error").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of all archives under ``path``.

    Revisits have no payload; ``payload_bytes`` and ``refers_to`` of each are as in
    its archive. See :func:`resolved`.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [
                ("archive", pa.string()), ("at", pa.int64()), ("record_id", pa.int64()), ("type", pa.string()), ("uri", pa.string()),
                ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
            ]
        )
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for r in _parsed(path, data.as_buffer()):
                    rows.append(r)
                    size += r[7] or 0
                    if size > 16 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parsed, RECORD)


def resolved(read: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` of the full payload: a revisit's are those of
    the response it refers to; one whose response isn't there keeps null."""
    light = stored(read.drop("payload"))
    full = light.where("type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    )
    full = full.groupBy("_id", "_digest").agg(F.max("_bytes").alias("_bytes"))
    revisits = light.where("type = 'revisit'").join(
        full, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left"
    )
    return light.where("type = 'response'").unionByName(
        revisits.withColumn("payload_bytes", F.col("_bytes")).drop("_id", "_digest", "_bytes")
    )


# The same table as SQL; base32 writes five bytes as eight characters.
ORACLE = r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
best AS (SELECT h, n, max(page_id) AS response FROM p GROUP BY h, n)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN best USING (h, n)
"""
