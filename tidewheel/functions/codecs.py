"""Binary codecs: variable-length and fixed-width whole numbers as expressions, MessagePack for small maps."""

from __future__ import annotations

import struct
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    """Signed numbers to ones whose small values are near 0."""
    n = n.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1).cast("long"))))


def product(a: str | Column, b: str | Column) -> Column:
    """The low 64 bits of the product of two whole numbers, signed: what does not fit wraps round, as in 64-bit arithmetic."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long").cast("decimal(19,0)")
    low = F.pmod(wide(a) * wide(b), F.lit(Decimal(1 << 64)))
    return F.when(low >= F.lit(Decimal(1 << 63)), low - F.lit(Decimal(1 << 64))).otherwise(low).cast("long")


def varint(n: Column) -> Column:
    """Seven bits to a byte, the low ones first; all bytes but the last have the high bit set. 64 bits, unsigned."""
    n = n.cast("long")
    group = lambda i: F.call_function("shiftrightunsigned", n, i * 7)
    digit = lambda i: group(i).bitwiseAND(F.lit(127).cast("long")) + F.when((i < 9) & (group(i + 1) != 0), 128).otherwise(0)
    there = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == 0) | (group(i) != 0))
    return F.unhex(F.array_join(F.transform(there, lambda i: F.lpad(F.hex(digit(i)), 2, "0")), ""))


def from_varint(raw: Column) -> Column:
    """The number that the bytes stand for; null if there are more than ten."""
    low = lambda i: F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long"))
    add = lambda a, i: a.bitwiseOR(F.call_function("shiftleft", low(i), i * 7))
    n = F.octet_length(raw)
    return F.when(n.between(1, 10), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), add))


def fixed(n: Column, size: int, big_endian: bool = True) -> Column:
    """The low size bytes of a whole number."""
    text = F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * size))
    if not big_endian:
        text = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.unhex(text)


def from_fixed(raw: Column, size: int, big_endian: bool = True) -> Column:
    """Unsigned; for eight bytes the bits of a signed number."""
    text = F.hex(raw)
    if not big_endian:
        text = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])
    high, low = F.conv(F.left(F.lpad(text, 16, "0"), F.lit(8)), 16, 10).cast("long"), F.conv(F.right(text, F.lit(8)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low) if size > 4 else low


def msgpack(value: Any) -> bytes:
    """MessagePack of None, booleans, whole numbers, floats, strings, bytes, lists and maps."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        if -32 <= value < 0:
            return struct.pack("b", value)
        for code, form, low, high in ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD0, ">b", -(1 << 7), 0), (0xD1, ">h", -(1 << 15), 0), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0)):
            if low <= value < high:
                return bytes([code]) + struct.pack(form, value)
        raise ValueError("a number of more than 64 bits")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        return _sized(value.encode(), (0xA0, 32), (0xD9, 0xDA, 0xDB))
    if isinstance(value, bytes):
        return _sized(value, None, (0xC4, 0xC5, 0xC6))
    if isinstance(value, dict):
        return _count(len(value), 0x80, 0xDE) + b"".join(msgpack(k) + msgpack(v) for k, v in value.items())
    return _count(len(value), 0x90, 0xDC) + b"".join(map(msgpack, value))


def _sized(raw: bytes, short: tuple[int, int] | None, codes: tuple[int, int, int]) -> bytes:
    n = len(raw)
    if short and n < short[1]:
        return bytes([short[0] | n]) + raw
    size = 0 if n < 1 << 8 else 1 if n < 1 << 16 else 2
    return bytes([codes[size]]) + n.to_bytes(1 << size, "big") + raw


def _count(n: int, short: int, code: int) -> bytes:
    return bytes([short | n]) if n < 16 else bytes([code]) + n.to_bytes(2, "big") if n < 1 << 16 else bytes([code + 1]) + n.to_bytes(4, "big")


def unmsgpack(raw: bytes) -> Any:
    value, end = _read(raw, 0)
    if end != len(raw):
        raise ValueError("bytes left over")
    return value


def _read(raw: bytes, at: int) -> tuple[Any, int]:
    code = raw[at]
    at += 1
    if code < 0x80:
        return code, at
    if code >= 0xE0:
        return code - 256, at
    if code < 0x90:
        return _map(raw, at, code & 15)
    if code < 0xA0:
        return _list(raw, at, code & 15)
    if code < 0xC0:
        return raw[at : at + (code & 31)].decode(), at + (code & 31)
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if code in numbers:
        size = struct.calcsize(numbers[code])
        return struct.unpack(numbers[code], raw[at : at + size])[0], at + size
    if code in (0xC4, 0xC5, 0xC6, 0xD9, 0xDA, 0xDB):
        size = 1 << ((code - 0xC4) if code < 0xD0 else (code - 0xD9))
        n = int.from_bytes(raw[at : at + size], "big")
        part = raw[at + size : at + size + n]
        return part if code < 0xD0 else part.decode(), at + size + n
    size = 2 if code in (0xDC, 0xDE) else 4
    n = int.from_bytes(raw[at : at + size], "big")
    return (_list if code < 0xDE else _map)(raw, at + size, n)


def _list(raw: bytes, at: int, n: int) -> tuple[list, int]:
    out = []
    for _ in range(n):
        value, at = _read(raw, at)
        out.append(value)
    return out, at


def _map(raw: bytes, at: int, n: int) -> tuple[dict, int]:
    out = {}
    for _ in range(n):
        key, at = _read(raw, at)
        out[key], at = _read(raw, at)
    return out, at


def _packed(ids: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([msgpack({"id": None if pd.isna(i) else int(i), "name": n}) for i, n in zip(ids, names, strict=True)])


def _unpacked(raw: pd.Series) -> pd.DataFrame:
    rows = [unmsgpack(bytes(x)) if x is not None else {} for x in raw]
    return pd.DataFrame({"id": pd.array([r.get("id") for r in rows], "Int64"), "name": [r.get("name") for r in rows]})


def pack_pair(ids: Column | str, names: Column | str) -> Column:
    """{id, name} as MessagePack."""
    return F.pandas_udf(_packed, "binary")(ids, names)


def unpack_pair(raw: Column | str) -> Column:
    """A struct of id and name."""
    return F.pandas_udf(_unpacked, "id long, name string")(raw)
