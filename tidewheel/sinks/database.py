"""Batched saves and deletes through a database's Python driver (any that follows the DB-API).

Each task opens a connection and writes batches by write_batches: a batch's saves, then its deletes, in one transaction. A
batch that fails is rolled back, and tried again on a new connection. Deal rows by key first where the order of a key's rows
counts; of a batch one row is kept for each key (Batching.key), so no key is saved and deleted in one batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .batched import Batching, Writer, delete_sql, saves_then_deletes, upsert_sql, write_batches


@dataclass(frozen=True)
class Table:
    """connect opens a connection. dialect: mysql, or conflict for databases whose inserts take ON CONFLICT. keep_old: columns
    that keep a value that is not null. is_deleted: rows that are deleted by their keys. mark: the driver's parameter mark."""

    connect: Callable[[], Any]
    name: str
    columns: tuple[str, ...]
    keys: tuple[str, ...]
    keep_old: tuple[str, ...] = ()
    is_deleted: Callable[[dict], bool] = lambda row: False
    dialect: str = "conflict"
    mark: str = "?"

    def save_sql(self) -> str:
        if self.dialect == "mysql":
            sql = upsert_sql(self.name, list(self.columns), list(self.keep_old), list(self.keys))
        elif self.dialect == "conflict":
            sets = [f"{c}=COALESCE({self.name}.{c}, excluded.{c})" if c in self.keep_old else f"{c}=excluded.{c}" for c in self.columns if c not in self.keys]
            then = f"DO UPDATE SET {', '.join(sets)}" if sets else "DO NOTHING"
            sql = f"INSERT INTO {self.name}({', '.join(self.columns)}) VALUES({', '.join('?' * len(self.columns))}) ON CONFLICT({', '.join(self.keys)}) {then}"
        else:
            raise ValueError(f"no such dialect: {self.dialect}")
        return sql.replace("?", self.mark)

    def open_writer(self) -> Writer:
        connection = self.connect()
        cursor = connection.cursor()
        save, delete = self.save_sql(), delete_sql(self.name, list(self.keys)).replace("?", self.mark)
        put = saves_then_deletes(
            lambda rows: cursor.executemany(save, [tuple(r[c] for c in self.columns) for r in rows]),
            lambda rows: cursor.executemany(delete, [tuple(r[c] for c in self.keys) for r in rows]),
            self.is_deleted,
        )

        def write(batch: list[dict]) -> None:
            try:
                put(batch)
                connection.commit()
            except Exception:
                connection.rollback()
                connection.close()
                raise

        return write

    def key_of(self, row: dict) -> tuple:
        return tuple(row[k] for k in self.keys)


def write_table(df: DataFrame, table: Table, rows: int = 5000, retries: int = 2, order: str | None = None) -> dict[str, int]:
    """Writes df's rows, each key's in one task and, with order, in that order; for foreachBatch or a batch."""
    dealt = df.repartition(*table.keys)
    if order:
        dealt = dealt.sortWithinPartitions(order)
    return write_batches(dealt, table.open_writer, Batching(rows=rows, retries=retries, key=table.key_of))
