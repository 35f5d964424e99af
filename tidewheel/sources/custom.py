"""Sources that a class gives the elements of, one after the other, in several tasks: extend Elements and register it.

Options: rows-per-second and most-rows (in a micro-batch, so that a pause is not made up for at once), both of all tasks;
partitions, of which each makes every partitions-th element; number-of-rows, after which the source ends and which a batch needs."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Share(InputPartition):
    """Elements from first to last that one task makes."""

    def __init__(self, task: int, tasks: int, first: int, last: int):
        self.task, self.tasks, self.first, self.last = task, tasks, first, last

    def numbers(self) -> range:
        return range(self.first + (self.task - self.first) % self.tasks, self.last, self.tasks)


class Paced:
    """How far a stream has come: by the clock, at a rate, no further than the most rows beyond where it was."""

    def __init__(self, options: dict[str, str], clock=time.time):  # noqa: ANN001
        self.rate = float(options.get("rows-per-second", 10_000))
        self.most = int(options.get("most-rows", 1_000_000))
        self.end = int(options.get("number-of-rows", -1))
        self.clock, self.began, self.last = clock, None, None

    def latest(self) -> int:
        now = self.clock()
        if self.began is None:
            self.began = (now, self.last or 0)
        at, rows = self.began
        due = min(rows + int((now - at) * self.rate), (self.last or 0) + self.most)
        return due if self.end < 0 else min(due, self.end)

    def reached(self, row: int) -> None:
        self.last = max(row, self.last or 0)


def shares(options: dict[str, str], first: int, last: int) -> list[InputPartition]:
    tasks = int(options.get("partitions", 4))
    return [Share(t, tasks, first, last) for t in range(tasks)]


class Elements(DataSource):
    """Extend by name, schema and element."""

    def element(self, number: int, task: int) -> tuple:
        raise ValueError("a source of elements says what they are")

    def reader(self, schema: StructType) -> ElementReader:
        return ElementReader(self)

    def streamReader(self, schema: StructType) -> ElementStream:  # noqa: N802
        return ElementStream(self)


class ElementReader(DataSourceReader):
    def __init__(self, source: Elements):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        n = int(self.source.options.get("number-of-rows", -1))
        if n < 0:
            raise ValueError("a batch needs number-of-rows")
        return shares(self.source.options, 0, n)

    def read(self, partition: Share) -> Iterator[tuple]:
        return (self.source.element(n, partition.task) for n in partition.numbers())


class ElementStream(DataSourceStreamReader):
    def __init__(self, source: Elements):
        self.source, self.pace = source, Paced(source.options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"row": self.pace.latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.pace.reached(end["row"])
        return shares(self.source.options, start["row"], end["row"])

    def read(self, partition: Share) -> Iterator[tuple]:
        return (self.source.element(n, partition.task) for n in partition.numbers())
