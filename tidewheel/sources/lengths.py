"""Length-delimited files read by byte ranges: four bytes of length, the high one first, and the payload, over and over.

Such a file has no mark that a record begins with, so a task that gets a range follows the lengths from each place of it at
once: the places whose chain of lengths stays inside the file and comes out behind the range are its possible entries, each with
the place where its chain comes out and the records on the way. Chains soon run together, so these are few. Then the ranges of a
file are gone through in order, a row for each: the first entry is 0, and where one range is left is where the next one is
entered. A range with more possible entries than are sent (most), of which the needed one is none, is looked at again from the
known place. At last each task reads the records that begin in its range.

A record that breaks off ends its file, as does a length with the highest bit set. Files in stores whose ranges tasks cannot
open are read whole, a row for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

RANGE = "file string, size long, first long, last long"
FOUND = f"{RANGE}, entries array<long>, exits array<long>, counts array<long>, whole boolean"
#: Stores whose files tasks open by ranges.
RANGED = ("file:", "/", "hdfs:", "s3:", "gs:")


def _bytes(file: str, first: int, last: int) -> bytes:
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as f:
        f.seek(first)
        return f.read(last - first)


def chains(data: np.ndarray, first: int, last: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places from first to last whose lengths lead on, record by record, to a place behind them: the places, where they
    lead, and how many records begin on the way. data: bytes from first to three behind last, or to the file's end."""
    at = np.arange(max(min(last - first, len(data) - 3), 0))
    b = data.astype(np.uint32)
    length = (b[at] << 24 | b[at + 1] << 16 | b[at + 2] << 8 | b[at + 3]).astype(np.int64)
    after = first + at + 4 + length
    good = np.flatnonzero((after <= size) & (length < 1 << 31))
    place, after = first + good, after[good]
    if not len(place):
        return place, place, place
    following = np.searchsorted(place, after)
    inside = (after < last) & (following < len(place))
    inside &= place[np.minimum(following, len(place) - 1)] == after
    # doubling: jump leads to the last place of a chain in ever fewer steps, before counts the records up to it
    jump, before = np.where(inside, following, np.arange(len(place))), inside.astype(np.int64)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        before, jump = before + before[jump], further
    ends = after[jump]
    out = ends >= last
    return place[out], ends[out], before[out] + 1


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long")))
    return files.select("file", "size", starts.alias("first")).select("*", F.least(F.col("first") + size, "size").alias("last"))


def _scanned(most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(_bytes(row["file"], row["first"], min(row["last"] + 3, row["size"])), np.uint8)
                place, out, count = chains(data, row["first"], row["last"], row["size"])
                # the longest chains are the likeliest
                keep = np.sort(np.argsort(-count, kind="stable")[:most])
                yield _found([{**row, "entries": place[keep].tolist(), "exits": out[keep].tolist(), "counts": count[keep].tolist(), "whole": len(place) <= most}])

    return run


def _found(rows: list[dict]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = {"file": pa.string(), "size": pa.int64(), "first": pa.int64(), "last": pa.int64(), "entries": longs, "exits": longs, "counts": longs, "whole": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with a known entry, record by record."""
    for batch in batches:
        for row in batch.to_pylist():
            at, n = row.pop("entry"), 0
            data, entry = _bytes(row["file"], at, min(row["last"] + 3, row["size"])), at
            while at < row["last"] and (end := _end(data, at - entry, row["size"] - entry)) is not None:
                at, n = entry + end, n + 1
            done = at >= row["last"]
            yield _found([{**row, "entries": [entry] if done else [], "exits": [at] if done else [], "counts": [n] if done else [], "whole": True}])


def _end(data: bytes, at: int, size: int) -> int | None:
    """Where the record at a place ends, if it is whole."""
    if at + 4 > size:
        return None
    length = int.from_bytes(data[at : at + 4], "big")
    return at + 4 + length if length < 1 << 31 and at + 4 + length <= size else None


PLAN = "file string, size long, first long, last long, entry long, number long, ask boolean"


def _in_order(rows):  # noqa: ANN001, ANN202
    """The ranges of a file that records begin in, with their entries and numbers; the first one that cannot be told is asked
    for, and those behind it are left out."""
    import pandas as pd

    out, entry, number = [], 0, 0
    for r in rows.sort_values("first").itertuples():
        if entry >= r.last:
            continue
        told = dict(zip(r.entries, zip(r.exits, r.counts, strict=True), strict=True))
        out.append((r.file, r.size, r.first, r.last, entry, number, entry not in told and not r.whole))
        if entry not in told:
            break  # asked for, or the file's records end in this range
        entry, number = told[entry][0], number + told[entry][1]
    return pd.DataFrame(out, columns=["file", "size", "first", "last", "entry", "number", "ask"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file, size, at, number = row["file"], row["size"], row["entry"], row["number"]
            data, base, held, bytes_held = _bytes(file, at, min(row["last"] + 3, size)), at, [], 0
            while at < row["last"] and (end := _end(data, at - base, size - base)) is not None:
                payload = data[at - base + 4 : end]
                if end > len(data):  # the record goes on behind the range
                    payload += _bytes(file, base + len(data), base + end)
                held.append(payload)
                at, bytes_held = base + end, bytes_held + len(payload) + 16
                if bytes_held > 4 << 20 or at >= row["last"]:
                    yield _payloads(file, number, held)
                    number, held, bytes_held = number + len(held), [], 0
            if held:
                yield _payloads(file, number, held)


def _payloads(file: str, number: int, held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array(range(number, number + len(held)), pa.int64()), pa.array(held, pa.binary())], names=["file", "number", "payload"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            at, held, number = 0, [], 0
            while (end := _end(raw, at, len(raw))) is not None:
                held.append(raw[at + 4 : end])
                at = end
                if len(held) >= 10_000:
                    yield _payloads(file, number, held)
                    number, held = number + len(held), []
            yield _payloads(file, number, held)


def length_delimited(spark: SparkSession, path: str, size: int = 4 << 20, most: int = 64) -> DataFrame:
    """file, number, payload of the records of binary files. size: bytes of a range. most: possible entries sent of one."""
    fields = "file string, number long, payload binary"
    if not path.startswith(RANGED):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_whole, fields)
    top, step = shared_dir(spark, "lengths"), 0
    ranges = _ranges(spark, path, size)
    ranges.repartition("file", "first").mapInArrow(_scanned(most), FOUND).write.parquet(f"{top}/found0")
    while True:
        found = spark.read.schema(FOUND).parquet(f"{top}/found{step}")
        found.groupBy("file").applyInPandas(_in_order, PLAN).write.parquet(f"{top}/plan{step}")
        plan = spark.read.schema(PLAN).parquet(f"{top}/plan{step}")
        asked = plan.where("ask").select("file", "size", "first", "last", "entry")
        if asked.isEmpty():
            return plan.select("file", "size", "first", "last", "entry", "number").repartition("file", "first").mapInArrow(_read, fields)
        again = asked.mapInArrow(_walked, FOUND)
        step += 1
        found.join(asked.select("file", "first"), ["file", "first"], "left_anti").select(found.columns).unionByName(again).write.parquet(f"{top}/found{step}")
