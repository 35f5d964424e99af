"""A table of Parquet files whose rows appear batch by batch, all of a batch or none: the sink "committed".

Tasks write files that nobody reads yet and send back what they wrote. The commit puts one entry for the batch into the
table's log, by a rename; readers take the files that the log names. A batch that is committed already, because a query began
again from its checkpoint after a stop between this commit and its own, leaves the log as it is and drops the new files. Files
of tasks that failed or ran twice are in no entry. So each batch of a stream, or of foreachBatch with the option batch, is
there once, whatever was stopped when.

Options: path; batch, the number for writes that are not streams (else the next one); rows, after how many a task begins
another file; tops, columns whose largest values so far the log keeps with each batch, which top_before() reads back. A checkpoint has
one active query, so entries have one writer; the store must be one that pyarrow knows, with renames that are atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: files below the table's path, rows of each, and the largest values of the tops."""

    files: list[str] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    tops: dict[str, Any] = field(default_factory=dict)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _larger(a: Any, b: Any) -> Any:
    return b if a is None else a if b is None else max(a, b)


class Table:
    """The parts of a write that are the same for batches and streams."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("committed needs a path")
        self.path, self.kind = options["path"], schema.json()
        self.batch = options.get("batch")
        self.limit = int(options.get("rows", 1_000_000))
        self.tops = [c for c in options.get("tops", "").split(",") if c]

    def put(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.path)
        store.create_dir(f"{top}/data", recursive=True)
        out, writer = Written(tops=dict.fromkeys(self.tops)), None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if writer is None:
                    out.files.append(f"data/{uuid.uuid4().hex}.parquet")
                    out.rows.append(0)
                    writer = pq.ParquetWriter(f"{top}/{out.files[-1]}", batch.schema, filesystem=store)
                part = batch.slice(at, self.limit - out.rows[-1])
                writer.write_batch(part)
                out.rows[-1] += part.num_rows
                at += part.num_rows
                for c in self.tops:
                    out.tops[c] = _larger(out.tops[c], pc.max(part.column(c)).as_py())
                if out.rows[-1] >= self.limit:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        return out

    def enter(self, messages: list[Written | None], number: int) -> None:
        """Puts the batch into the log, if it is not there."""
        store, top = _store(self.path)
        if store.get_file_info(_entry(top, number)).type != fs.FileType.NotFound:
            self.drop(messages)
            return
        parts = [m for m in messages if m is not None]
        tops = {c: top_before(self.path, c, number) for c in self.tops}
        for m in parts:
            tops = {c: _larger(v, m.tops[c]) for c, v in tops.items()}
        entry = {"batch": number, "files": [f for m in parts for f in m.files], "rows": sum(n for m in parts for n in m.rows), "tops": tops, "schema": self.kind}
        store.create_dir(f"{top}/log", recursive=True)
        draft = f"{top}/log/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(entry).encode())
        store.move(draft, _entry(top, number))

    def drop(self, messages: list[Written | None], number: int | None = None) -> None:
        """Deletes what was written, but for what the batch's entry names: a commit may fail after its rename."""
        store, top = _store(self.path)
        named = {f for e in ([] if number is None else entries(self.path, number, number)) for f in e["files"]}
        for f in (f for m in messages if m is not None for f in m.files if f not in named):
            try:
                store.delete_file(f"{top}/{f}")
            except FileNotFoundError:
                pass  # gone by an earlier abort


def _entry(top: str, number: int) -> str:
    return f"{top}/log/{number:012d}.json"


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, table: Table):
        self.table = table

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.table.put(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        number = int(self.table.batch) if self.table.batch is not None else max(numbers(self.table.path), default=-1) + 1
        self.table.enter(messages, number)

    def abort(self, messages: list[Written | None]) -> None:
        named = {f for e in entries(self.table.path) for f in e["files"]} if self.table.batch is None else set()
        left = [Written([f for f in m.files if f not in named]) for m in messages if m is not None]
        self.table.drop(left, None if self.table.batch is None else int(self.table.batch))


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, table: Table):
        self.table = table

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.table.put(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.table.enter(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.table.drop(messages, batchId)


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("committed only appends")
        return BatchWriter(Table(schema, dict(self.options)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(Table(schema, dict(self.options)))


def append(df: DataFrame, path: str, batch: int | None = None, tops: list[str] | None = None) -> None:
    """Writes df as one batch of the table."""
    df.sparkSession.dataSource.register(Committed)
    out = df.write.format("committed").mode("append").option("path", path).option("tops", ",".join(tops or []))
    (out if batch is None else out.option("batch", batch)).save()


def numbers(path: str) -> list[int]:
    """The batches that the log has."""
    store, top = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{top}/log", allow_not_found=True))
    return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json") and not x.base_name.startswith("."))


def entries(path: str, first: int | None = None, last: int | None = None) -> list[dict]:
    store, top = _store(path)
    wanted = [n for n in numbers(path) if (first is None or n >= first) and (last is None or n <= last)]
    out = []
    for n in wanted:
        with store.open_input_stream(_entry(top, n)) as f:
            out.append(json.loads(f.read()))
    return out


def read(spark: SparkSession, path: str, schema: str | StructType | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of committed batches, of those from first to last if given. schema: for a table that may have no batch yet."""
    found = entries(path, first, last)
    if not found and schema is None:
        raise ValueError(f"no batch is committed in {path}")
    kind = schema or StructType.fromJson(json.loads(found[-1]["schema"]))
    files = [f"{path}/{f}" for e in found for f in e["files"]]
    return spark.read.schema(kind).parquet(*files) if files else spark.createDataFrame([], kind)


def top_before(path: str, column: str, batch: int) -> Any:
    """The largest value of a column of tops over the batches before batch, or None: each entry has that of all up to it."""
    last = max((n for n in numbers(path) if n < batch), default=None)
    return None if last is None else entries(path, last, last)[0]["tops"].get(column)


def forget(path: str, before: int) -> None:
    """Deletes the batches before a number, entries first: for tables of which the last batches are read alone."""
    store, top = _store(path)
    for e in entries(path, last=before - 1):
        store.delete_file(_entry(top, e["batch"]))
        for f in e["files"]:
            store.delete_file(f"{top}/{f}")
