"""The committing sink with stops at stated batches, to try out what a query does that begins again."""

from __future__ import annotations

from pyspark.sql.types import StructType

from .committed import Committed, StreamWriter, Table, Written


class StoppingWriter(StreamWriter):
    def __init__(self, table: Table, before: int | None, after: int | None):
        super().__init__(table)
        self.before, self.after = before, after

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        if batchId == self.before:
            raise RuntimeError(f"stopped between the writes and the commit of batch {batchId}")
        super().commit(messages, batchId)
        if batchId == self.after:
            raise RuntimeError(f"stopped between the commit of batch {batchId} and the checkpoint's")


class Stopping(Committed):
    """Options before, after: numbers of batches to stop at."""

    @classmethod
    def name(cls) -> str:
        return "stopping"

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        at = {k: int(self.options[k]) if k in self.options else None for k in ("before", "after")}
        return StoppingWriter(Table(schema, dict(self.options)), **at)
