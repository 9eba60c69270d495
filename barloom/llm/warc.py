"""WARC archives: writing with revisits, segments and chunked transfer framing, and reassembly on reading (operator 5).

Writing: each page becomes an HTTP response in chunked framing. Of records with equal payloads of at least LEAST_SHARED bytes the one
with the smallest page_id is stored, the others are revisit records that refer to it. A block of more than ``segment``
bytes is written as a first segment and continuation records. Archives are files in the shared folder, written by
Spark's own committer and compressed, so that a lost executor leaves no half file behind. A file is cut by bytes: it holds records of at most file_bytes and one
segment more before they are compressed, however large pages are.

Reading: files are parsed record by record. Continuations are grouped by the record they continue, ordered by segment number,
and checked for gaps and for the total length; then the chunked framing is decoded. Only segmented records are shuffled.

Defined cases: a null html is an empty payload. A null page_id is written as such and is never referred to; a payload that only
rows with a null page_id carry is a response in each. Rows that repeat the smallest page_id of a payload are all responses. An incomplete or
inconsistent record raises ``ValueError`` with its identifier; nothing is dropped.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import shared_dir, text_bytes

LEAST_SHARED = 100
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_BYTES = 16 << 20
END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of a chunked transfer, with extensions and trailers; raises ValueError if it is cut short."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size expected")
        size = int(data[at:end].split(b";", 1)[0].strip() or b"?", 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(data[at : at + size])
        at += size + 2


def _record(kind: str, identifier: str, block: bytes, more: dict[str, object]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{identifier}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response"} | more | {"Content-Length": len(block)}
    # The end of the record is the line separator of the writer.
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block


def records(page_id: int | None, identifier: str, url: str, body: bytes, digest: str, refers_to: int | None, segment: int) -> list[bytes]:
    """The records of a page."""
    about = {"WARC-Target-URI": url, "X-Page-ID": "" if page_id is None else page_id, "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": len(body)}
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record("revisit", identifier, HTTP, about | {"WARC-Profile": profile, "WARC-Refers-To": f"<urn:page:{refers_to}>", "X-Refers-To-Page": refers_to})]
    block = HTTP + chunked(body)
    if len(block) <= segment:
        return [_record("response", identifier, block, about)]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", identifier, pieces[0], about | {"WARC-Segment-Number": 1})]
    for n, piece in enumerate(pieces[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(pieces) else {}
        out.append(_record("continuation", f"{identifier}:{n}", piece, {"WARC-Segment-Origin-ID": f"<{identifier}>", "WARC-Segment-Number": n} | last))
    return out


def _written(segment: int, archive: str, file_bytes: int):
    """The contents of files: records up to the size of a file, with the separator between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Identifiers name the archive, the task and the record's place in it: rows that repeat differ.
        own, n, out, size = f"{archive}/{TaskContext.get().partitionId()}", 0, [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, body, digest, refers_to = (c[row].as_py() for c in batch.columns)
                # Line ends in a url would end its header.
                url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                for record in records(page_id, f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}/{n}')}", url, body, digest, refers_to, segment):
                    if size and size + len(record) > file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([END.join(out)], pa.binary())], ["file"])
                        out, size = [], 0
                    out.append(record)
                    size += len(record) + len(END)
                n += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(out)], pa.binary())], ["file"])

    return run


def write(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """pages (page_id, url, html) as archives under path."""
    body = text_bytes(F.col("html"))
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"))
    large = F.coalesce(F.octet_length("html"), F.lit(0)) >= LEAST_SHARED
    # One row for each shared payload; a payload in a third of all rows combines before the shuffle, and is split in the join.
    shared = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first"))
    out = rows.join(shared, "digest", "left").select("page_id", "url", text_bytes(F.col("html")).alias("b"), "digest", refers.alias("refers_to"))
    files = out.mapInArrow(_written(segment, path, file_bytes), "file binary").select(F.col("file").cast("string").alias("value"))
    # A row is a file. The text writer puts its bytes as they are, and the end of the last record behind them.
    files.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).mode("errorifexists").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if data[at : at + len(VERSION)] != VERSION or end < 0:
            raise ValueError(f"no record at byte {at}")
        head = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        start = end + len(END)
        stop = start + int(head["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"{head.get('warc-record-id')} is cut short")
        yield head, data[start:stop]
        at = stop + len(END)


_FIELDS = "origin string, segment int, total long, kind string, page_id long, url string, length long, digest string, refers_to long, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            out: list[tuple] = []
            data = content.as_py()
            for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                number = lambda name: int(h[name]) if h.get(name) else None  # noqa: B023, E731
                kind = h["warc-type"]
                first = kind != "continuation"
                out.append((h["warc-record-id"] if first else h["warc-segment-origin-id"], number("warc-segment-number"), number("warc-segment-total-length"), kind, number("x-page-id"), h.get("warc-target-uri"), number("x-payload-length"), h.get("warc-payload-digest", "").removeprefix("sha256:"), number("x-refers-to-page"), block))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def payload(identifier: str, block: bytes, digest: str, length: int | None) -> bytes:
    """The decoded body of an HTTP response, checked against the record's digest."""
    head, _, body = block.partition(END)
    if b"transfer-encoding: chunked" in head.lower():
        try:
            body = dechunked(body)
        except ValueError as e:
            raise ValueError(f"{identifier}: {e}") from None
    if digest and hashlib.sha256(body).hexdigest() != digest or length is not None and len(body) != length:
        raise ValueError(f"{identifier}: its payload differs from its digest")
    return body


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest of each page."""
    # A file for a task at most, so that a few files are enough for all cores.
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, _FIELDS)
    whole = rows.where("segment is null")
    pieces = rows.where("segment is not null")
    parts = pieces.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), *(F.max_by(c, F.col("kind") != "continuation").alias(c) for c in ("kind", "page_id", "url", "length", "digest", "refers_to")), F.sum((F.col("kind") != "continuation").cast("int")).alias("firsts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p.block.cast("string")), "").cast("binary")
    complete = (F.col("firsts") == 1) & (F.transform("parts", lambda p: p.segment) == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length(joined) == F.col("total"))
    once = parts.withColumn("block", F.when(F.coalesce(complete, F.lit(False)), joined).otherwise(F.raise_error(F.concat(F.lit("segments do not fit: "), "origin")).cast("binary")))
    columns = ["origin", "kind", "page_id", "url", "length", "digest", "refers_to", "block"]
    return whole.select(*columns).unionByName(once.select(*columns)).select("page_id", "url", F.col("kind").alias("record_type"), "refers_to", F.when(F.col("kind") == "response", F.col("block")).alias("block"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "origin")


def _decoded(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies = [None if x is None else payload(o, x, d, n) for o, x, d, n in zip(b["origin"], b["block"], b["payload_digest"], b["payload_bytes"], strict=True)]
            out = b[["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]].astype({"page_id": "Int64", "refers_to": "Int64"})
            yield out.assign(payload=bodies) if with_payload else out

    return run


def decode(found: DataFrame, with_payload: bool = True) -> DataFrame:
    """What ``read`` found, its framing decoded and its digests checked."""
    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return found.mapInPandas(_decoded(with_payload), kinds)


def round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages as archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, segment, file_bytes)
    return decode(read(spark, path), False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
