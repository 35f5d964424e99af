"""Options of sinks whose servers or drivers are not at hand: checked, with defaults, and turned into a Batching or into
options of Spark's writers. What they send goes through sinks.batched with a writer that the caller gives."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .batched import Batching, Writer, over_hosts, write_batches

_SIZES = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}
_SPANS = {"ms": 0.001, "s": 1, "min": 60, "h": 3600}


def size_of(text: str) -> int:
    """Bytes of a size such as 200mb."""
    m = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower())
    if not m or m[2] not in _SIZES:
        raise ValueError(f"no size: {text}")
    return int(m[1]) * _SIZES[m[2]]


def seconds_of(text: str) -> float:
    m = re.fullmatch(r"(\d+)\s*([a-z]+)", text.strip().lower())
    if not m or m[2] not in _SPANS:
        raise ValueError(f"no time span: {text}")
    return int(m[1]) * _SPANS[m[2]]


@dataclass
class ClickHouse:
    """table and hosts are required; connection options pass through. A batch is tried three times, each time on the next
    host; if all fail, the write fails, or with drop_failed the batch is left out and counted."""

    table: str
    hosts: list[str]
    batch_rows: int = 100_000
    batch_bytes: int = 200 << 20
    interval_seconds: float = 30.0
    connection: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, options: dict[str, str]) -> ClickHouse:
        missing = {"table", "host"} - set(options)
        if missing:
            raise ValueError(f"missing options: {sorted(missing)}")
        known = {"table", "host", "batch.size", "batch.byte.size", "batch.interval"}
        odd = [k for k in options if k not in known and not k.startswith("connection.")]
        if odd:
            raise ValueError(f"unknown options: {odd}")
        out = cls(
            options["table"], [h.strip() for h in options["host"].split(",") if h.strip()], int(options.get("batch.size", 100_000)), size_of(options.get("batch.byte.size", "200mb")),
            seconds_of(options.get("batch.interval", "30s")), {k.removeprefix("connection."): v for k, v in options.items() if k.startswith("connection.")},
        )
        if out.batch_rows <= 0 or not 0 < out.batch_bytes < 1000 << 20 or not out.hosts:
            raise ValueError("batch sizes must be positive, and less than 1000mb")
        return out

    def batching(self, drop_failed: bool = False) -> Batching:
        return Batching(rows=self.batch_rows, size=self.batch_bytes, interval_seconds=self.interval_seconds, retries=2, drop_failed=drop_failed)

    def write(self, df: DataFrame, connect: Callable[[str], Writer], drop_failed: bool = False) -> dict[str, int]:
        """Writes rows in batches; connect opens a writer on a host. Returns the counts of write_batches."""
        return write_batches(df, _Rotation(self.hosts, connect), self.batching(drop_failed))


class _Rotation:
    """over_hosts, made anew in each task."""

    def __init__(self, hosts: list[str], connect: Callable[[str], Writer]):
        self.hosts, self.connect, self.open = hosts, connect, None

    def __getstate__(self) -> dict:
        return {"hosts": self.hosts, "connect": self.connect, "open": None}

    def __call__(self) -> Writer:
        self.open = self.open or over_hosts(self.hosts, self.connect)
        return self.open()


@dataclass
class StreamLoad:
    """A load over HTTP of tab-separated lines or Arrow. columns may derive one from others, in text only."""

    table: str
    label_prefix: str
    columns: list[str]
    form: str = "csv"
    derived: dict[str, str] = field(default_factory=dict)

    def headers(self, batch: int) -> dict[str, str]:
        if self.form not in ("csv", "arrow"):
            raise ValueError(f"no such format: {self.form}")
        if self.form == "arrow" and self.derived:
            raise ValueError("derived columns need the text format")
        out = {"label": f"{self.label_prefix}-{batch}", "format": self.form, "columns": ",".join([*self.columns, *(f"{k}={v}" for k, v in self.derived.items())])}
        return out | ({"column_separator": "\\t"} if self.form == "csv" else {})


@dataclass
class Period:
    """Statements beside the flushes: those that make gives for a time, at most each interval; as write_partition's beside
    it hands them to execute."""

    make: object
    interval_seconds: float
    last: float | None = None
    execute: Callable[[str], None] | None = None

    def __call__(self, now: float) -> None:
        for statement in self.due(now):
            self.execute(statement)

    def due(self, now: float) -> list[str]:
        if self.last is not None and now - self.last < self.interval_seconds:
            return []
        self.last = now
        return list(self.make(now))
