"""WARC archives: a writer with revisit records, and a reader that splits files by byte ranges (operator 1).

Each record is a gzip member by itself. The writer hands members to Spark's text sink as rows; the last byte of a member
is the high byte of its length, 0 below 16 MiB, and is written as the row separator, so that a file holds members and
nothing else, in any store that Spark writes to. A longer record gets an empty member behind it, which also ends in 0.

The reader deals byte ranges of the files. A task looks for the bytes that begin a member, decodes what follows until it
has a record's headers or knows that there is none, and owns the records that start in its range, whichever range they
end in. It holds one record and one block of the file at a time.

Defined results: a null payload is empty; a null page id is written as an empty header and read as null, and a null URL
as one made from the page id; rows with equal id and payload are all of the same type; an empty table gives files
without a response; bytes that are no member are skipped, as are members that break off or hold no WARC record. Headers
and payloads of any length are read. Columns besides id, URL and html play no part, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import small_batches

MAGIC = b"\x1f\x8b\x08"
LONG = 1 << 24
BLOCK = 1 << 20
#: Stores that tasks can read ranges of; files in others are read whole, by Spark.
RANGED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
FIELDS = "file string, start long, warc_type string, record_id string, uri string, headers map<string,string>, payload binary"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32: four digits from each five of the hexadecimal form."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(F.sha1(data), i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(digits, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(record: bytes) -> bytes:
    """A gzip member whose last byte is 0, or such a member and an empty one."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out + member(b"") if out[-1] else out


def record_bytes(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {''.join(c if c >= ' ' else f'%{ord(c):02X}' for c in v)}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page: Any) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def with_originals(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, uri parts, payload, payload_digest, and refers_to: of payloads of min_bytes or more that are equal, the row with
    the largest key is the original and the others refer to it. Only what occurs more than once takes part in the join."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page_id"), F.col("url"), payload.alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    groups = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    return rows.join(groups, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))).drop("original")


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of with_originals to files below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [member(record_bytes("warcinfo", {"WARC-Record-ID": record_id("info"), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))[:-1]]
        size = 0
        for batch in batches:
            for page, url, payload, digest, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                page_text = "" if page is None else str(page)
                headers = {
                    "WARC-Record-ID": record_id(page), "WARC-Date": date, "WARC-Target-URI": url if url is not None else f"urn:page:{page_text}",
                    "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response", "X-Page-ID": page_text, "X-Payload-Length": str(len(payload)),
                }
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if original is None:
                    rows.append(member(record_bytes("response", headers, head + payload))[:-1])
                else:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(original), "X-Refers-To-Page": str(original)}
                    rows.append(member(record_bytes("revisit", headers, head))[:-1])
                size += len(rows[-1])
                if size > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
                    rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    small_batches(pages.sparkSession)
    pages.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.mode("error").option("lineSep", "\0").text(path)


class Blocks:
    """Bytes of a file, read a block at a time."""

    def __init__(self, file: Any, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, place: int, n: int = 1) -> memoryview:
        """The held bytes from place on, n at least unless the file ends."""
        if not (self.at <= place and place + n <= self.at + len(self.held)) and place < self.size:
            self.file.seek(place)
            self.at, self.held = place, self.file.read(max(n, BLOCK))
        return memoryview(self.held)[max(0, place - self.at) :] if place < self.size else memoryview(b"")


def parse_headers(head: bytes) -> dict[str, str] | None:
    """Headers of a record from the bytes before its first empty line; None if that is no WARC record."""
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        return None
    return {k.decode("utf-8", "replace"): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}


def decode_member(blocks: Blocks, at: int) -> tuple[dict[str, str] | None, bytes, int]:
    """Headers, block and end of the record in the member at a place; no headers if there is none."""
    z, place, out, headers, body = zlib.decompressobj(31), at, bytearray(), None, 0
    try:
        while not z.eof:
            part = blocks.get(place)[: 1 << 16]
            if not len(part):
                return None, b"", at + 1
            out += z.decompress(part)
            place += len(part) - len(z.unused_data)
            if headers is None:
                if out and not b"WARC/".startswith(bytes(out[:5])):
                    return None, b"", at + 1
                body = out.find(b"\r\n\r\n")
                if body >= 0:
                    headers = parse_headers(bytes(out[:body]))
                    if headers is None or "WARC-Type" not in headers or not headers.get("Content-Length", "").isdigit():
                        return None, b"", at + 1
    except zlib.error:
        return None, b"", at + 1
    if headers is None:
        return None, b"", place if not out else at + 1
    end = body + 4 + int(headers["Content-Length"])
    return (headers, bytes(out[body + 4 : end]), place) if end <= len(out) else (None, b"", at + 1)


def records(file: Any, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and block of the records that start from start to before end."""
    blocks, at = Blocks(file, size), start
    while at < end:
        seen = blocks.get(at, len(MAGIC)).tobytes()
        if len(seen) < len(MAGIC):
            break
        found = seen.find(MAGIC)
        if found < 0:
            at += len(seen) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            break
        headers, block, following = decode_member(blocks, at)
        if headers is not None:
            yield at, headers, block
        at = following


def open_file(path: str) -> Any:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


def read_warc(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """A row for each record of the files below path; the payload is what follows the HTTP headers, if there are any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    scheme = path.split(":", 1)[0] if ":/" in path else "file"
    names = [x.split()[0] for x in FIELDS.split(", ")]
    if scheme in RANGED:
        total = files.agg(F.sum("length")).first()[0] or 0
        at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("at")
        ranges = files.where("length > 0").select("path", "length", at).repartition(max(1, -(-total // split_bytes)), "path", "at")
    else:
        ranges = files.select("path", "length", F.lit(0).cast("long").alias("at"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, size, at = (batch.column(c)[row].as_py() for c in ("path", "length", "at"))
                rows: list[tuple] = []
                held = 0
                with pa.BufferReader(batch.column("content")[row].as_py()) if scheme not in RANGED else open_file(name) as file:
                    for place, headers, block in records(file, size, at, min(size, at + split_bytes) if scheme in RANGED else size):
                        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                        rows.append((name, place, headers["WARC-Type"], headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), list(headers.items()), payload))
                        held += len(payload)
                        if held > BLOCK:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.mapInArrow(run, FIELDS)
