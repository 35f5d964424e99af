"""A stream of records from a socket, ended by a byte that can be chosen: the source "socket_example".

One thread of the driver's reader holds the connection; while there is none it tries again every few seconds, and what a
connection leaves unfinished is no record. What a micro-batch is planned from is written to a spool file before its offset is
given out, so a batch that runs again, after a restart too, reads the same records; files go once their batch is committed.
Offsets count records.

Options: hostname, port; byte-delimiter, a number, 10 if not given; retry-seconds, 5; spool, a folder that the driver and the
tasks share; most-bytes, what the reader holds before it lets the sender wait."""

from __future__ import annotations

import logging
import pickle
import socket
import threading
from collections.abc import Iterator
from typing import Any

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..functions.coercion import json_checked
from ..session import shared_dir

LOG = logging.getLogger("tidewheel.socket")


class Connection(threading.Thread):
    """Reads records into a list until it is stopped."""

    def __init__(self, host: str, port: int, delimiter: int, retry_seconds: float, most_bytes: int):
        super().__init__(daemon=True)
        self.address, self.delimiter, self.retry_seconds, self.most_bytes = (host, port), bytes([delimiter]), retry_seconds, most_bytes
        self.held: list[bytes] = []
        self.size = self.broken = 0
        self.changed, self.stopped = threading.Condition(), threading.Event()

    def take(self) -> list[bytes]:
        with self.changed:
            out, self.held, self.size = self.held, [], 0
            self.changed.notify_all()
        return out

    def run(self) -> None:
        while not self.stopped.is_set():
            try:
                with socket.create_connection(self.address, timeout=1) as s:
                    self._follow(s)
            except OSError as e:
                LOG.warning("no connection to %s:%d (%s), next try in %s seconds", *self.address, e, self.retry_seconds)
            self.stopped.wait(self.retry_seconds)

    def _follow(self, s: socket.socket) -> None:
        rest = b""
        while not self.stopped.is_set():
            try:
                data = s.recv(1 << 16)
            except TimeoutError:
                continue
            except OSError:
                data = b""
            if not data:
                self.broken += bool(rest)
                return
            *records, rest = (rest + data).split(self.delimiter)
            with self.changed:
                self.held += records
                self.size += sum(map(len, records))
                while self.size > self.most_bytes and not self.stopped.is_set():
                    self.changed.wait(0.2)

    def stop(self) -> None:
        self.stopped.set()


class SocketReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        for name in ("hostname", "port", "spool"):
            if name not in options:
                raise ValueError(f"socket_example needs {name}")
        self.spool = options["spool"]
        self.delimiter = int(options.get("byte-delimiter", 10))
        self.settings = (options["hostname"], int(options["port"]), self.delimiter % 256, float(options.get("retry-seconds", 5)), int(options.get("most-bytes", 64 << 20)))
        self.connection: Connection | None = None

    def __getstate__(self) -> dict[str, Any]:
        return {**self.__dict__, "connection": None}  # tasks read the spool alone

    def initialOffset(self) -> dict:  # noqa: N802
        return {"record": 0}

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, top = fs.FileSystem.from_uri(self.spool)
        store.create_dir(top, recursive=True)
        return store, top

    def _files(self) -> list[tuple[int, int, str]]:
        """First record, the one behind the last, and path of the spool's files."""
        store, top = self._store()
        found = [x for x in store.get_file_info(fs.FileSelector(top)) if x.base_name.endswith(".records")]
        return sorted((*map(int, x.base_name.split(".")[0].split("-")), x.path) for x in found)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.connection is None:
            self.connection = Connection(*self.settings)
            self.connection.start()
        records = self.connection.take()
        if not records:
            return iter([]), start
        first = start["record"]
        end = first + len(records)
        store, top = self._store()
        draft = f"{top}/draft"
        with store.open_output_stream(draft) as out:
            out.write(pickle.dumps(records))
        store.move(draft, f"{top}/{first:015d}-{end:015d}.records")
        return iter([(first + i, r) for i, r in enumerate(records)]), {"record": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        store, at = self._store()[0], start["record"]
        for first, stop, path in self._files():
            if first < end["record"] and stop > start["record"]:
                if first > at:
                    break
                with store.open_input_stream(path) as f:
                    records = pickle.loads(f.read())
                yield from ((first + i, r) for i, r in enumerate(records) if start["record"] <= first + i < end["record"])
                at = stop
        if at < end["record"]:
            raise ValueError(f"the spool has no records from {at} on")

    def commit(self, end: dict) -> None:
        store = self._store()[0]
        for _, stop, path in self._files():
            if stop <= end["record"]:
                store.delete_file(path)


class SocketExample(DataSource):
    @classmethod
    def name(cls) -> str:
        return "socket_example"

    def schema(self) -> str:
        return "record bigint, value binary"

    def simpleStreamReader(self, schema: StructType) -> SocketReader:  # noqa: N802
        return SocketReader(dict(self.options))


def socket_records(spark: SparkSession, host: str, port: int, delimiter: int = 10, spool: str | None = None, **options: str) -> DataFrame:
    """record (its number), value (its bytes). spool: the same folder again for a query that begins again."""
    spark.dataSource.register(SocketExample)
    reader = spark.readStream.format("socket_example").option("hostname", host).option("port", port).option("byte-delimiter", delimiter)
    return reader.option("spool", spool or shared_dir(spark, "socket")).options(**{k.replace("_", "-"): v for k, v in options.items()}).load()


def decoded(records: DataFrame, decode: Column, name: str = "decoded") -> DataFrame:
    """The columns of a struct that decode makes of each record; rows for which it is null are bad and left out. Each
    micro-batch's progress has, under the name, the numbers of rows and of bad ones."""
    rows = records.withColumn("_row", decode).observe(name, F.count("*").alias("rows"), F.count_if(F.col("_row").isNull()).alias("bad"))
    return rows.where(F.col("_row").isNotNull()).select("_row.*")


def json_rows(records: DataFrame, schema: str, name: str = "decoded") -> DataFrame:
    return decoded(records, json_checked(F.col("value").cast("string"), schema, ignore_errors=True), name)
