"""Aggregates whose states are stored: a binary for each group, which tasks build, and which merge in any order.

A task builds the states of the groups that it meets and puts them out when they grow large, so that a group sends a state
for each task, not its rows. States are then dealt by group and merged in a sorted stream: a task holds a few states of one
group at a time, however many tasks have sent one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of states that a task holds, and states that are merged at once.
HELD, AT_ONCE = 32 << 20, 64


class Sketch(Protocol):
    def of(self, values: pa.Array) -> bytes:
        """The state of values without nulls."""

    def merge(self, states: list[bytes]) -> bytes:
        """The state of all that the states have seen."""


def _schema(df: DataFrame, keys: list[str], state: str) -> StructType:
    return StructType([*[df.schema[k] for k in keys], StructField(state, BinaryType())])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def states(df: DataFrame, keys: list[str], value: str, sketch: Sketch, state: str = "state") -> DataFrame:
    """keys, state of each group; rows whose value is null count for nothing, but their group has a state."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, bytes] = {}
        size = 0
        kinds = None
        for batch in batches:
            kinds = [*[batch.schema.field(k).type for k in keys], pa.binary()]
            code = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                column = batch.column(k).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(column.dictionary) + column.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
            values = batch.column(value).take(pa.array(order))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(batch.column(k)[int(order[a])].as_py() for k in keys)
                new = sketch.of(values.slice(a, b - a).drop_null())
                old = held.get(key)
                held[key] = new if old is None else sketch.merge([old, new])
                size += len(held[key]) - len(old or b"") + (200 if old is None else 0)
            if size > HELD:
                yield _batch([(*k, s) for k, s in held.items()], [*keys, state], kinds)
                held, size = {}, 0
        if held:
            yield _batch([(*k, s) for k, s in held.items()], [*keys, state], kinds)

    return merged(df.select(*keys, value).mapInArrow(build, _schema(df, keys, state)), keys, sketch, state)


def merged(df: DataFrame, keys: list[str], sketch: Sketch, state: str = "state") -> DataFrame:
    """keys, state of each group of states; without keys of all of them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = None
        parts: list[bytes] = []
        out: list[tuple] = []
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in [*keys, state]]
            for *k, s in zip(*[batch.column(c).to_pylist() for c in [*keys, state]], strict=True):
                if parts and k != key:
                    out.append((*key, sketch.merge(parts)))
                    parts = []
                key = k
                if s is not None:
                    parts.append(s)
                if len(parts) >= AT_ONCE:
                    parts = [sketch.merge(parts)]
                if len(out) >= 256:
                    yield _batch(out, [*keys, state], kinds)
                    out = []
        if parts:
            out.append((*key, sketch.merge(parts)))
        if out:
            yield _batch(out, [*keys, state], kinds)

    rows = df.select(*keys, state)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys) if keys else rows.coalesce(1)
    return dealt.mapInArrow(merge, _schema(df, keys, state))
