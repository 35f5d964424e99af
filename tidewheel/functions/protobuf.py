"""Protobuf records by a schema given in code or by a descriptor set; decoding and encoding of binary columns in Arrow batches.
Decoding works on whole batches (wire.py), encoding record by record.

A schema is a list of fields (name, number, type, label). A type is a name in TYPES, a schema for a message, or a dict of
names and numbers for an enumeration, which is read as its names. Labels are singular, optional and repeated. schema_of
gives the schema of a message of a compiled descriptor set.

Defined results: a broken record is all nulls, unless fail is set; a null record gives nulls. Without defaults, absent
fields and fields of the type's default value are null; with defaults they have it, but for optional fields and messages.
Unknown fields are skipped. 64-bit unsigned numbers wrap into bigint, 32-bit ones into int, as they are stored.
"""

from __future__ import annotations

from itertools import count
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wire

# Field types of the wire format by the names used in schemas, and the Spark types they are read as.
TYPES = {
    "double": (1, "double"),
    "float": (2, "float"),
    "int64": (3, "bigint"),
    "uint64": (4, "bigint"),
    "int32": (5, "int"),
    "fixed64": (6, "bigint"),
    "fixed32": (7, "int"),
    "bool": (8, "boolean"),
    "string": (9, "string"),
    "bytes": (12, "binary"),
    "uint32": (13, "int"),
    "sfixed32": (15, "int"),
    "sfixed64": (16, "bigint"),
    "sint32": (17, "int"),
    "sint64": (18, "bigint"),
}
MESSAGE, ENUM = 11, 14
_ARROW = {"double": pa.float64(), "float": pa.float32(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_UNSIGNED = {"uint32": 32, "fixed32": 32, "uint64": 64, "fixed64": 64}
Kind = str | dict | list
Schema = list[tuple[str, int, Kind, str]]


def _add_message(file: Any, schema: Schema, name: str, numbers: Any) -> None:
    message = file.message_type.add(name=name)
    for field, number, kind, label in schema:
        added = message.field.add(name=field, number=number, label=3 if label == "repeated" else 1)
        if isinstance(kind, str):
            added.type = TYPES[kind][0]
        else:
            inner = f"{name}_{next(numbers)}"
            added.type, added.type_name = (ENUM, f".tidewheel.{inner}") if isinstance(kind, dict) else (MESSAGE, f".tidewheel.{inner}")
            if isinstance(kind, dict):
                values = file.enum_type.add(name=inner)
                for value, at in sorted(kind.items(), key=lambda x: x[1] != 0):  # the first one has to be zero
                    values.value.add(name=f"{inner}_{value}", number=at)
            else:
                _add_message(file, kind, inner, numbers)
        if label == "optional":
            added.proto3_optional = True
            added.oneof_index = len(message.oneof_decl)
            message.oneof_decl.add(name=f"_{field}")


def message_class(schema: Schema, name: str = "Row") -> Any:
    file = descriptor_pb2.FileDescriptorProto(name=f"{name.lower()}.proto", package="tidewheel", syntax="proto3")
    _add_message(file, schema, name, count(1))
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"tidewheel.{name}"))


def schema_of(descriptor_set: bytes, message: str) -> Schema:
    """The schema of a message (by its full name) of a serialized descriptor set. Messages that hold themselves have none."""
    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set).file:
        pool.Add(file)
    names = {number: name for name, (number, _) in TYPES.items()}

    def fields(found: Any, above: tuple[str, ...]) -> Schema:
        if found.full_name in above:
            raise ValueError(f"{found.full_name} holds itself")
        inside, out = (*above, found.full_name), []
        for f in found.fields:
            kind = fields(f.message_type, inside) if f.type == MESSAGE else {v.name: v.number for v in f.enum_type.values} if f.type == ENUM else names[f.type]
            out.append((f.name, f.number, kind, "repeated" if f.is_repeated else "optional" if f.has_presence and f.type != MESSAGE else "singular"))
        return out

    return fields(pool.FindMessageTypeByName(message), ())


def _ddl(kind: Kind, read_as: dict[str, str] | None = None, path: str = "") -> str:
    if isinstance(kind, list):
        return "struct<" + ", ".join(f"`{f}`: {_labelled(k, label, read_as, f'{path}{f}')}" for f, _, k, label in kind) + ">"
    return _read_as(kind, (read_as or {}).get(path.rstrip("."))) if isinstance(kind, str) else "string"


def _labelled(kind: Kind, label: str, read_as: dict[str, str] | None = None, path: str = "") -> str:
    inner = _ddl(kind, read_as, f"{path}.")
    return f"array<{inner}>" if label == "repeated" else inner


def ddl(schema: Schema) -> str:
    return ", ".join(f"`{f}` {_labelled(k, label)}" for f, _, k, label in schema)


def _read_as(kind: str, wanted: str | None) -> str:
    """The Spark type that a kind is read as. Numbers are read as any other type of numbers, booleans as int too."""
    own = TYPES[kind][1]
    if wanted is None or wanted == own:
        return own
    known = {"bigint", "int", "double", "float"}
    if (own in known and wanted in known) or (own == "boolean" and wanted == "int"):
        return wanted
    raise ValueError(f"{kind} is not read as {wanted}")


def _cast(values: np.ndarray, to: str) -> np.ndarray:
    """As numbers of a language with casts: whole numbers lose their high bits, fractions are cut off and stay in range."""
    kind = {"bigint": np.int64, "int": np.int32, "double": np.float64, "float": np.float32, "boolean": np.bool_}[to]
    if values.dtype.kind == "f" and to in ("bigint", "int"):
        low, high = np.iinfo(kind).min, np.iinfo(kind).max
        whole = np.nan_to_num(np.trunc(values.astype(np.float64)), nan=0.0)
        inside = (whole >= float(low)) & (whole < float(high))
        return np.where(inside, np.where(inside, whole, 0).astype(kind), np.where(whole < 0, low, high)).astype(kind)
    with np.errstate(over="ignore"):
        return values.astype(kind)


class _Decoder:
    """Reads a batch of records as a struct array; read_as holds other types of numbers by dotted names."""

    def __init__(self, schema: Schema, defaults: bool, read_as: dict[str, str]):
        self.schema, self.defaults, self.read_as = schema, defaults, read_as

    def struct(self, r: wire.Records, schema: Schema, path: str = "", above: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
        """The struct array and which records are broken. above: records that are broken or missing elsewhere."""
        f = wire.walk(r)
        broken, children = f.broken.copy(), []
        for name, number, kind, label in schema:
            mine = np.flatnonzero((f.number == number) & ~broken[f.record])
            child, odd = self._field(r, f, mine, kind, label, f"{path}{name}")
            broken[odd] = True
            children.append(child)
        hidden = pa.array(broken if above is None else broken | above)
        if hidden.true_count:
            children = [pc.if_else(hidden, pa.scalar(None, c.type), c) for c in children]
        kinds = [pa.field(s[0], c.type) for s, c in zip(schema, children, strict=True)]
        return pa.StructArray.from_arrays(children, fields=kinds), np.flatnonzero(broken)

    def _field(self, r: wire.Records, f: wire.Fields, mine: np.ndarray, kind: Kind, label: str, path: str) -> tuple[pa.Array, np.ndarray]:
        n, none = len(r.start), np.zeros(0, np.int64)
        if isinstance(kind, list):
            mine = mine[f.wire[mine] == wire.BYTES]
            if label == "repeated":
                inner, odd = self.struct(wire.Records(r.data, f.start[mine], f.end[mine]), kind, f"{path}.")
                return self._lists(f.record[mine], inner, n), f.record[mine][odd]
            data, offsets = wire.gather(r.data, f.start[mine], f.end[mine])  # a field's messages in one record, joined
            ends = offsets[np.searchsorted(f.record[mine], np.arange(n + 1))]
            there = np.isin(np.arange(n), f.record[mine])
            inner, odd = self.struct(wire.Records(data, ends[:-1], ends[1:]), kind, f"{path}.")
            return pc.if_else(pa.array(there), inner, pa.scalar(None, inner.type)), odd
        base = "enum" if isinstance(kind, dict) else kind
        own = wire.WIRE[base]
        if label == "repeated":
            if own == wire.BYTES:
                mine = mine[f.wire[mine] == own]
                record, start, end, odd = f.record[mine], f.start[mine], f.end[mine], none
            else:
                mine = mine[(f.wire[mine] == own) | (f.wire[mine] == wire.BYTES)]
                record, start, end, odd = wire.elements(base, r.data, f, mine)
            values, bad = self._values(r.data, start, end, kind, path)
            return self._lists(record, values, n), np.concatenate([odd, record[bad]])
        mine = mine[f.wire[mine] == own]
        last = mine[np.flatnonzero(np.diff(f.record[mine], append=-1))] if len(mine) else mine
        values, bad = self._values(r.data, f.start[last], f.end[last], kind, path)
        place = np.full(n, -1, np.int64)
        place[f.record[last]] = np.arange(len(last))
        plain = self._default(kind, values.type)
        held = place >= 0
        if label != "optional" and not self.defaults:
            zero = f.end[last] == f.start[last] if own == wire.BYTES else wire.zeros(base, r.data, f.start[last], f.end[last])
            held[f.record[last[zero]]] = False
        out = values.take(pa.array(np.where(held, place, 0), mask=~held)) if len(values) else pa.nulls(n, values.type)
        if self.defaults and label != "optional":
            out = out.fill_null(plain)
        return out, f.record[last][bad]

    def _default(self, kind: Kind, to: pa.DataType) -> pa.Scalar:
        if isinstance(kind, dict):
            return pa.scalar(next((n for n, at in kind.items() if at == 0), "0"))
        return pa.scalar({"string": "", "bytes": b""}.get(kind, False if pa.types.is_boolean(to) else 0), to)

    def _values(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: Kind, path: str) -> tuple[pa.Array, np.ndarray]:
        """The values at places, and the numbers of those that are no text though they should be."""
        none = np.zeros(0, np.int64)
        if isinstance(kind, dict):
            codes, which = np.unique(wire.numbers("enum", data, start, end), return_inverse=True)
            names = {at: name for name, at in reversed(kind.items())}
            return pa.array([names.get(c, str(c)) for c in codes.tolist()], pa.string()).take(pa.array(which.astype(np.int64))), none
        if wire.WIRE[kind] != wire.BYTES:
            values = wire.numbers(kind, data, start, end)
            to = _read_as(kind, self.read_as.get(path))
            return pa.array(_cast(values, to), _ARROW[to]), none
        raw, offsets = wire.gather(data, start, end)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
        if kind == "bytes":
            return column, none
        try:
            return column.cast(pa.string()), none
        except pa.ArrowInvalid:
            bad = np.array([i for i, x in enumerate(column.to_pylist()) if not _is_text(x)])
            keep = np.ones(len(column), bool)
            keep[bad] = False
            return pc.if_else(pa.array(keep), column, pa.scalar(b"", pa.binary())).cast(pa.string()), bad

    def _lists(self, record: np.ndarray, values: pa.Array, n: int) -> pa.Array:
        """values by record; a record without any has a null, or an empty list by default."""
        ends = np.searchsorted(record, np.arange(n + 1)).astype(np.int32)
        mask = None if self.defaults else pa.array(np.diff(ends) == 0)
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=mask)


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def read_column(column: pa.Array, schema: Schema, fail: bool = False, defaults: bool = False, read_as: dict[str, str] | None = None) -> pa.Array:
    """A struct for each record of a binary column; a null one, and a broken one unless fail is set, has nulls alone."""
    out, broken = _Decoder(schema, defaults, read_as or {}).struct(wire.records_of(column), schema, above=np.asarray(column.is_null()))
    if fail and len(broken):
        raise ValueError(f"no whole record: {column[int(broken[0])].as_py()!r:.80}")
    return out


def _written(value: Any, kind: Kind) -> Any:
    """The value as the type takes it: text becomes a number and a number text, and whole numbers are cut to their bits."""
    if isinstance(kind, dict):
        return kind[value] if value in kind else int(value)
    if kind in ("double", "float"):
        return float(value)
    if kind == "bool":
        return value.lower() in ("true", "1") if isinstance(value, str) else bool(value)
    if kind in ("string", "bytes"):
        return value if isinstance(value, (str if kind == "string" else bytes)) else str(value) if kind == "string" else str(value).encode()
    if kind in _UNSIGNED:
        return int(value) % (1 << _UNSIGNED[kind])
    bits = 32 if kind.endswith("32") else 64
    return (int(value) + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))


def _fill(m: Any, schema: Schema, row: dict[str, Any]) -> None:
    for field, _, kind, label in schema:
        value = row.get(field)
        if value is None:
            continue
        if isinstance(kind, list):
            if label == "repeated":
                for x in value:
                    _fill(getattr(m, field).add(), kind, x or {})
            else:
                getattr(m, field).SetInParent()
                _fill(getattr(m, field), kind, value)
        elif label == "repeated":
            getattr(m, field).extend(_written(v, kind) for v in value if v is not None)
        else:
            setattr(m, field, _written(value, kind))


def write(cls: Any, schema: Schema, row: dict[str, Any] | None) -> bytes | None:
    """A record; nulls and unknown names are left out. A null row is null."""
    if row is None:
        return None
    m = cls()
    _fill(m, schema, row)
    return m.SerializeToString(deterministic=True)


def decode(raw: Column, schema: Schema, fail: bool = False, defaults: bool = False, read_as: dict[str, str] | None = None) -> Column:
    """A struct of the schema's fields. Only these are decoded; unknown fields are skipped. read_as: Spark types by field (by
    dotted names within messages) that numbers are read as, where they are not those of TYPES."""

    @F.arrow_udf(_ddl(schema, read_as))
    def run(column: pa.Array) -> pa.Array:
        return read_column(column, schema, fail, defaults, read_as)

    return run(raw)


def encode(row: Column, schema: Schema) -> Column:
    """Bytes of a struct column."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        cls = message_class(schema)
        return pa.array([write(cls, schema, r) for r in column.to_pylist()], pa.binary())

    return run(row)
