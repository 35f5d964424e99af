"""The Protobuf wire format of a whole Arrow batch at once, in numpy.

Records of a batch are walked side by side: in each round every record reads one tag and steps over its value, so a batch takes
as many rounds as its longest record has fields, and each round is a few array operations. When few records are left, these are
walked alone. The values of the fields that are asked for are then read from their places, all of a field at once: varints,
fixed numbers, text, packed and unpacked repeats together, and the messages of a field as a batch of their own.

Of a singular field the last value counts; messages that stand more than once are joined, as the format has it. Fields of another
wire type than theirs, and unknown ones, are skipped, groups too."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

VARINT, FIXED64, BYTES, GROUP, GROUP_END, FIXED32 = range(6)
#: Records are walked alone when fewer are left.
FEW = 24
WIDTH = {VARINT: 0, FIXED64: 8, FIXED32: 4}
# The wire type of each kind of field.
WIRE = {
    "double": FIXED64, "float": FIXED32, "int64": VARINT, "uint64": VARINT, "int32": VARINT, "fixed64": FIXED64, "fixed32": FIXED32, "bool": VARINT,
    "string": BYTES, "bytes": BYTES, "uint32": VARINT, "sfixed32": FIXED32, "sfixed64": FIXED64, "sint32": VARINT, "sint64": VARINT, "enum": VARINT,
}


@dataclass
class Records:
    """data: the bytes of all records; start, end: of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Fields:
    """Of each field that was met, in the order of records and of fields in them: its record, number, wire type, and the place
    of its value (of BYTES without the length). broken: of each record."""

    record: np.ndarray
    number: np.ndarray
    wire: np.ndarray
    start: np.ndarray
    end: np.ndarray
    broken: np.ndarray


def records_of(column: pa.Array) -> Records:
    """A null is an empty record."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.fill_null(b"").buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return Records(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[:-1], offsets[1:])


def varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of varints at the places, the places behind them, and whether they are whole (ten bytes at most, before end)."""
    value, more, done = np.zeros(len(at), np.uint64), np.ones(len(at), bool), np.zeros(len(at), np.int64)
    top = max(len(data) - 1, 0)
    for k in range(10):
        if not more.any():
            break
        inside = more & (at + k < end)
        byte = np.where(inside, data[np.minimum(at + k, top)] if len(data) else 0, 0).astype(np.uint64)
        value |= np.where(inside, (byte & np.uint64(127)) << np.uint64(7 * k), np.uint64(0))
        done = np.where(inside & (byte < 128), k + 1, done)
        more = inside & (byte >= 128)
    return value, at + done, done > 0


def _one(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """The varint at a place and the place behind it."""
    value = 0
    for k in range(10):
        if at + k >= end:
            return None
        byte = data[at + k]
        value |= (byte & 127) << 7 * k
        if byte < 128:
            return value & (1 << 64) - 1, at + k + 1
    return None


def _alone(data: bytes, at: int, end: int, record: int, out: list[tuple]) -> bool:
    """Walks the rest of one record; whether it is whole."""
    depth = 0
    while at < end:
        tag = _one(data, at, end)
        if tag is None or tag[0] >> 3 == 0 or tag[0] >> 32:
            return False
        number, wire, at = tag[0] >> 3, tag[0] & 7, tag[1]
        start = at
        if wire == VARINT:
            got = _one(data, at, end)
            if got is None:
                return False
            at = got[1]
        elif wire == BYTES:
            got = _one(data, at, end)
            if got is None or got[0] > end - got[1]:
                return False
            start, at = got[1], got[1] + got[0]
        elif wire in WIDTH:
            at += WIDTH[wire]
        elif wire == GROUP:
            depth += 1
        elif wire == GROUP_END and depth:
            depth -= 1
        else:
            return False
        if at > end:
            return False
        if not depth and wire not in (GROUP, GROUP_END):
            out.append((record, number, wire, start, at))
    return not depth


def walk(r: Records) -> Fields:
    broken = np.zeros(len(r.start), bool)
    row = np.flatnonzero(r.start < r.end)
    at, end = r.start[row], r.end[row]
    rounds: list[list[np.ndarray]] = []
    alone: list[tuple] = []
    while len(row) >= FEW:
        tag, behind, whole = varints(r.data, at, end)
        number, wire = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
        whole &= (number > 0) & (tag >> np.uint64(32) == 0)
        group = whole & (wire == GROUP)
        for i in np.flatnonzero(group):
            part: list[tuple] = []
            broken[row[i]] = not _alone(r.data[at[i] : end[i]].tobytes(), 0, int(end[i] - at[i]), int(row[i]), part)
            alone += [(a, n, w, s + int(at[i]), e + int(at[i])) for a, n, w, s, e in part]
        value, after, read = varints(r.data, behind, end)
        is_varint, is_bytes = wire == VARINT, wire == BYTES
        room = (end - after).clip(0).astype(np.uint64)
        start = np.where(is_bytes, after, behind)
        stop = np.select([is_varint, is_bytes, wire == FIXED64, wire == FIXED32], [after, after + np.minimum(value, room).astype(np.int64), behind + 8, behind + 4], behind)
        whole &= np.select([is_varint, is_bytes, (wire == FIXED64) | (wire == FIXED32)], [read, read & (value <= room), stop <= end], group)
        broken[row[~whole]] = True
        good = whole & ~group
        rounds.append([row[good], number[good], wire[good], start[good], stop[good]])
        left = good & (stop < end)
        row, at, end = row[left], stop[left], end[left]
    for i, a, e in zip(row.tolist(), at.tolist(), end.tolist(), strict=True):
        part = []
        broken[i] = not _alone(r.data[a:e].tobytes(), 0, e - a, i, part)
        alone += [(x, n, w, s + a, t + a) for x, n, w, s, t in part]
    if alone:
        rounds.append([np.array(x, np.int64) for x in zip(*alone, strict=True)])
    columns = [np.concatenate(x) for x in zip(*rounds, strict=True)] if rounds else [np.zeros(0, np.int64)] * 5
    order = np.argsort(columns[0], kind="stable")  # rounds follow a record's fields
    return Fields(*[c[order] for c in columns], broken)


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the places one after the other, and offsets."""
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    place = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
    return data[place], offsets


def numbers(kind: str, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of a kind at places: 64- or 32-bit integers, floats, or booleans."""
    wire = WIRE[kind]
    if wire != VARINT:
        width = WIDTH[wire]
        raw = data[start[:, None] + np.arange(width)].tobytes()
        return np.frombuffer(raw, {"double": "<f8", "float": "<f4"}.get(kind, f"<i{width}"))
    value = varints(data, start, end)[0]
    if kind == "bool":
        return value != 0
    if kind.startswith("sint"):
        value = value & np.uint64(0xFFFFFFFF) if kind == "sint32" else value
        value = (value >> np.uint64(1)) ^ (np.uint64(0) - (value & np.uint64(1)))
    return value.view(np.int64) if kind.endswith("64") else value.astype(np.uint32).view(np.int32)


def zeros(kind: str, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which numbers have no bit set, so that a negative zero is none."""
    values = numbers(kind, data, start, end)
    return (values.view(f"i{values.itemsize}") if values.dtype.kind == "f" else values) == 0


def elements(kind: str, data: np.ndarray, f: Fields, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the numbers of a repeated field, packed or not: record, start and end in the order of the record, and the records
    whose packed bytes do not come out even."""
    record, wire, start, end = f.record[pick], f.wire[pick], f.start[pick], f.end[pick]
    packed = wire == BYTES
    if not packed.any():
        return record, start, end, np.zeros(0, np.int64)
    width = WIDTH[WIRE[kind]]
    at = np.flatnonzero(packed)
    if width:
        odd = (end[at] - start[at]) % width != 0
        n = (end[at] - start[at]) // width
        of = np.repeat(at, n)
        inner = np.repeat(start[at] - width * (np.cumsum(n) - n), n) + width * np.arange(n.sum())
        stop = inner + width
    else:
        raw, offsets = gather(data, start[at], end[at])
        last = np.flatnonzero(raw < 128)
        ends = offsets[1:][np.diff(offsets) > 0]
        odd = np.zeros(len(at), bool)
        odd[np.diff(offsets) > 0] = raw[ends - 1] >= 128 if len(ends) else False
        of_at = np.searchsorted(offsets, last, "right") - 1
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        first = np.maximum(first, offsets[of_at])
        of, shift = at[of_at], start[at][of_at] - offsets[of_at]
        inner, stop = first + shift, last + 1 + shift
        odd[of_at[last + 1 - first > 10]] = True
    rest = np.flatnonzero(~packed)
    order = np.argsort(np.concatenate([of, rest]), kind="stable")
    both = [np.concatenate([a, b])[order] for a, b in ((of, rest), (inner, start[rest]), (stop, end[rest]))]
    return record[both[0]], both[1], both[2], record[at[odd]]
