"""Sinks that write in batches: log lines, and rows through a writer with size limits, keys and retries."""

from __future__ import annotations

import itertools
import json
import logging
import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

LOG = logging.getLogger("tidewheel.sink")


def log_lines(df: DataFrame, kind: str = "+I") -> DataFrame:
    """A line for each row: the kind of change, a colon and the row as JSON."""
    return df.select(F.concat(F.lit(f"{kind}: "), F.to_json(F.struct("*"))).alias("line"))


def log_batch(mode: str = "LOG_INFO") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that puts out a batch's lines where its tasks run."""
    mode = mode.upper()
    if mode not in ("STDOUT", "LOG_INFO", "LOG_WARN"):
        raise ValueError(f"no such log mode: {mode}")

    def put(rows: Iterable[Row]) -> None:
        for r in rows:
            print(r.line) if mode == "STDOUT" else LOG.log(logging.WARNING if mode == "LOG_WARN" else logging.INFO, "%s", r.line)

    return lambda df, _: log_lines(df).foreachPartition(put)


def log_some(df: DataFrame, interval_seconds: float, kind: str = "+I", put: Callable[[str], None] | None = None) -> DataFrame:
    """df as it is; where its tasks run each puts out a row's line at most every interval_seconds, the first one at once. Rows
    between are looked at a batch at a time."""
    names = df.columns

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        last = None
        say = put or (lambda line: LOG.info("%s", line))
        for batch in batches:
            now = time.monotonic()
            if batch.num_rows and (last is None or now - last >= interval_seconds):
                say(f"{kind}: {json.dumps({c: batch.column(c)[0].as_py() for c in names}, default=str)}")
                last = now
            yield batch

    return df.mapInArrow(run, df.schema)


@dataclass
class Batching:
    """rows, size (bytes of the rows, by size_of), interval_seconds: what of these a flush reaches first ends it; the time is
    looked at when a row comes. pause_seconds: between two flushes at least. key: one row is kept for each key, in order of
    arrival, by replace(new, old). retries: further tries of a flush that fails. drop_failed: a flush that fails for good is
    counted and left out, else raised."""

    rows: int = 5000
    size: int | None = None
    interval_seconds: float | None = None
    pause_seconds: float = 0.0
    key: Callable[[dict], Any] | None = None
    replace: Callable[[dict, dict], dict] = field(default=lambda new, old: new)
    retries: int = 2
    drop_failed: bool = False
    size_of: Callable[[dict], int] = field(default=lambda row: len(repr(row)))
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


def flushes(rows: Iterable[dict], batching: Batching) -> Iterator[list[dict]]:
    """The batches that rows are written in."""
    held: dict[Any, dict] = {}
    size, since, last = 0, batching.clock(), None

    def batch() -> list[dict]:
        nonlocal held, size, since, last
        if last is not None and (wait := last + batching.pause_seconds - batching.clock()) > 0:
            batching.sleep(wait)
        out, held, size = list(held.values()), {}, 0
        since = last = batching.clock()
        return out

    for n, row in enumerate(rows):
        key = batching.key(row) if batching.key else n
        new = batching.replace(row, held[key]) if key in held else row
        if batching.size is not None:
            size += batching.size_of(new) - (batching.size_of(held[key]) if key in held else 0)
        held[key] = new
        due = batching.interval_seconds is not None and batching.clock() - since >= batching.interval_seconds
        if len(held) >= batching.rows or (batching.size is not None and size >= batching.size) or due:
            yield batch()
    if held:
        yield batch()


Writer = Callable[[list[dict]], None]


def over_hosts(hosts: list[str], connect: Callable[[str], Writer]) -> Callable[[], Writer]:
    """Opens a writer on the next host each time, beginning anywhere."""
    order = itertools.cycle(random.sample(hosts, len(hosts)))
    return lambda: connect(next(order))


def saves_then_deletes(save: Writer, delete: Writer, is_deleted: Callable[[dict], bool]) -> Writer:
    """A writer that saves a batch's rows and then deletes those marked; by keyed batching no key is in both."""

    def write(batch: list[dict]) -> None:
        gone = [r for r in batch if is_deleted(r)]
        kept = [r for r in batch if not is_deleted(r)]
        for rows, put in ((kept, save), (gone, delete)):
            if rows:
                put(rows)

    return write


COUNTS = ("in", "out", "dropped", "errors", "flushes")


def write_partition(rows: Iterable[dict], open_writer: Callable[[], Writer], batching: Batching, beside: Callable[[float], None] | None = None) -> dict[str, int]:
    """Writes rows; a failed try opens a new writer. beside is called with the time before each flush, for statements that
    run now and then. Returns counts of rows in, out and dropped, of failed tries, and of flushes."""
    seen = dict.fromkeys(COUNTS, 0)
    write = open_writer()

    def counted() -> Iterator[dict]:
        for r in rows:
            seen["in"] += 1
            yield r

    for batch in flushes(counted(), batching):
        if beside:
            beside(batching.clock())
        for n in range(batching.retries + 1):
            try:
                write(batch)
                seen["out"] += len(batch)
                seen["flushes"] += 1
                break
            except Exception:
                seen["errors"] += 1
                if n == batching.retries:
                    if not batching.drop_failed:
                        raise
                    seen["dropped"] += len(batch)
                else:
                    write = open_writer()
    return seen


def write_batches(df: DataFrame, open_writer: Callable[[], Writer], batching: Batching = Batching()) -> dict[str, int]:
    """Each task writes its rows through a writer of its own; for foreachBatch or a batch. Returns the counts over all tasks;
    tasks that Spark runs again count again."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        rows = (r for b in batches for r in b.to_pylist())
        seen = write_partition(rows, open_writer, batching)
        yield pa.RecordBatch.from_arrays([pa.array([seen[c]], pa.int64()) for c in COUNTS], names=list(COUNTS))

    got = df.mapInArrow(run, ", ".join(f"`{c}` long" for c in COUNTS)).agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in COUNTS]).first()
    return got.asDict()


def upsert_sql(table: str, columns: list[str], keep_old: list[str] | None = None, keys: list[str] | None = None) -> str:
    """An insert that updates the row of an equal key; columns in keep_old keep a value that is not null."""
    keep_old = keep_old or []
    sets = [f"{c}=IFNULL({c},VALUES({c}))" if c in keep_old else f"{c}=VALUES({c})" for c in columns if c not in (keys or [])]
    return f"INSERT INTO {table}({', '.join(columns)}) VALUES({', '.join('?' * len(columns))}) ON DUPLICATE KEY UPDATE {', '.join(sets)}"


def delete_sql(table: str, keys: list[str]) -> str:
    return f"DELETE FROM {table} WHERE {' AND '.join(f'{k} = ?' for k in keys)}"


def jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 5000, **options: str) -> None:
    """Appends through Spark's JDBC writer; needs the driver of the database on the class path."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_rows).options(**options).mode("append").save()


def kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Writes rows as JSON values; needs the connector on the class path."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
