"""The columnar Protobuf reader against the library, message by message."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest

from tidewheel.functions import protobuf, wire

LEAF = [("n", 1, "sint32", "singular"), ("at", 2, "sfixed64", "optional"), ("s", 3, "string", "repeated")]
INNER = [("id", 1, "uint32", "singular"), ("tags", 2, "string", "repeated"), ("leaf", 3, LEAF, "singular"), ("leaves", 4, LEAF, "repeated")]
SCHEMA = [
    ("a", 1, "int32", "singular"), ("b", 2, "int64", "optional"), ("c", 3, "uint64", "repeated"), ("d", 4, "double", "singular"), ("e", 5, "float", "repeated"),
    ("f", 16, "bool", "singular"), ("g", 17, "string", "optional"), ("h", 18, "bytes", "singular"), ("i", 2000, "fixed32", "repeated"), ("j", 20, "sint64", "repeated"),
    ("k", 21, {"NONE": 0, "ONE": 1, "FAR": 300, "LOW": -5}, "singular"), ("l", 22, {"NONE": 0, "ONE": 1}, "repeated"), ("m", 23, INNER, "singular"), ("o", 24, INNER, "repeated"), ("p", 25, "fixed64", "singular"),
]
UNSIGNED = {"uint32": 32, "fixed32": 32, "uint64": 64, "fixed64": 64}


def by_library(m, schema, defaults):
    held, out = {f.name for f, _ in m.ListFields()}, {}

    def plain(value, kind):
        if isinstance(kind, list):
            return by_library(value, kind, defaults)
        if isinstance(kind, dict):
            return next((n for n, at in kind.items() if at == value), str(value))
        bits = UNSIGNED.get(kind, 0)
        return value - (1 << bits) if bits and value >= 1 << (bits - 1) else value

    for name, _, kind, label in schema:
        there = name in held
        if label == "repeated":
            out[name] = [plain(v, kind) for v in getattr(m, name)] if there or defaults else None
        else:
            there |= defaults and label != "optional" and not isinstance(kind, list)
            out[name] = plain(getattr(m, name), kind) if there else None
    return out


def number(rng, kind):
    if kind in ("double", "float"):
        return rng.choice([0.0, -0.0, 1.5, -2.25, 1e10])
    if kind == "bool":
        return rng.random() < 0.5
    top = 1 << (31 if kind.endswith("32") else 63)
    value = rng.choice([0, 1, 127, 128, 300, 1 << 20, top - 1])
    return value if kind in UNSIGNED else rng.choice([value, -value, -top])


def filled(rng, schema):
    row = {}
    for name, _, kind, label in schema:
        if rng.random() < 0.35:
            continue

        def one(kind=kind):
            if isinstance(kind, list):
                return filled(rng, kind)
            if isinstance(kind, dict):
                return rng.choice([0, 1, 300, 77])
            if kind in ("string", "bytes"):
                text = rng.choice(["", "a", "é\U0001f600", "x" * 200])
                return text if kind == "string" else text.encode() + b"\xff"
            return number(rng, kind)

        row[name] = [one() for _ in range(rng.randint(0, 4))] if label == "repeated" else one()
    return row


def same(raws, schema, **options):
    cls = protobuf.message_class(schema)
    got = protobuf.read_column(pa.array(raws, pa.binary()), schema, **options).to_pylist()
    for raw, row in zip(raws, got, strict=True):
        try:
            want = by_library(cls.FromString(raw or b""), schema, options.get("defaults", False) and raw is not None)
        except Exception:
            want = None
        if want is None or raw is None:
            assert all(v is None for v in row.values()), raw
        else:
            assert repr(row) == repr(want), raw


@pytest.mark.parametrize("defaults", [False, True])
def test_random_messages(defaults):
    rng = random.Random(11)
    cls = protobuf.message_class(SCHEMA)
    raws = [protobuf.write(cls, SCHEMA, filled(rng, SCHEMA)) for _ in range(300)]
    same([*raws, b"", None], SCHEMA, defaults=defaults)
    same(raws[:5], SCHEMA, defaults=defaults)  # few records are walked alone
    fewer = [f for f in SCHEMA if f[0] in ("c", "m", "k")]
    assert protobuf.read_column(pa.array(raws), fewer, defaults=defaults).to_pylist() == [{k: r[k] for k in ("c", "k", "m")} for r in protobuf.read_column(pa.array(raws), fewer, defaults=defaults).to_pylist()]
    sliced = pa.array([b"x", *raws]).slice(1)
    assert repr(protobuf.read_column(sliced, SCHEMA, defaults=defaults).to_pylist()) == repr(protobuf.read_column(pa.array(raws), SCHEMA, defaults=defaults).to_pylist())


@pytest.mark.parametrize("n", [3, 200])
def test_broken_and_odd_records(n):
    rng = random.Random(n)
    cls = protobuf.message_class(SCHEMA)
    raws = []
    for _ in range(n):
        raw = bytearray(protobuf.write(cls, SCHEMA, filled(rng, SCHEMA)))
        for _ in range(rng.randint(0, 2)):
            if raw:
                raw[rng.randrange(len(raw))] = rng.randrange(256)
        if rng.random() < 0.3:
            raw = raw[: rng.randint(0, len(raw))]
        raws.append(bytes(raw))
    odd = [b"\x08" + b"\xff" * 9 + b"\x01", b"\x08" + b"\xff" * 10 + b"\x01", b"\x08\x80\x80\x00", b"\x00\x01", b"\x0e\x01", b"\x0f", b"\x1a\x02\x01", b"\x1a\x02\x81\x01\x18\x05\x1a\x00", b"\x1a\x01\x81"]
    odd += [b"\xa3\x06\x08\x01\xa4\x06\x08\x05", b"\x0a\x01\x01\x08\x02", b"\x08\x01\x08\x02", b"\x8a\x01\x02\xff\xfe", b"\xba\x01\x02\x08\x01\xba\x01\x03\x12\x01z", b"\x2a\x05\x00\x00\x80\x3f\x00"]
    same([*raws, *odd * (1 if n < 10 else 9)], SCHEMA)


def test_numbers_are_read_as_other_types():
    schema = [("a", 1, "uint32", "singular"), ("b", 2, "int64", "singular"), ("c", 3, "double", "singular"), ("d", 4, "bool", "singular"), ("e", 5, [("x", 1, "float", "repeated")], "singular")]
    cls = protobuf.message_class(schema)
    raw = cls(a=(1 << 32) - 2, b=(5 << 32) + 7, c=-1e300, d=True, e={"x": [1.75, -2.5]}).SerializeToString()
    read_as = {"a": "bigint", "b": "int", "c": "int", "d": "int", "e.x": "bigint"}
    got = protobuf.read_column(pa.array([raw]), schema, read_as=read_as)
    assert got.to_pylist() == [{"a": -2, "b": 7, "c": -(1 << 31), "d": 1, "e": {"x": [1, -2]}}]
    assert protobuf._ddl(schema, read_as) == "struct<`a`: bigint, `b`: int, `c`: int, `d`: int, `e`: struct<`x`: array<bigint>>>"
    assert protobuf.read_column(pa.array([raw]), schema, read_as={"b": "double", "a": "float"}).to_pylist()[0]["b"] == float((5 << 32) + 7)
    with pytest.raises(ValueError):
        protobuf.read_column(pa.array([raw]), schema, read_as={"d": "string"})
    with pytest.raises(ValueError):
        protobuf.read_column(pa.array([b"\xff"]), schema, fail=True)


def test_a_record_of_many_fields_and_a_large_batch():
    schema = [("n", 1, "int64", "repeated"), ("s", 2, "string", "singular"), ("v", 3, "double", "singular")]
    cls = protobuf.message_class(schema)
    long = b"".join(b"\x08" + wire_varint(i) for i in range(100_000))
    assert protobuf.read_column(pa.array([long]), schema)[0].as_py()["n"] == list(range(100_000))
    raws = [*[cls(n=[i, 300 + i], s=f"row {i}", v=i / 7).SerializeToString() for i in range(20_000)]]
    began = time.perf_counter()
    got = protobuf.read_column(pa.array(raws), schema)
    mine = time.perf_counter() - began
    assert got[19_999].as_py() == {"n": [19_999, 20_299], "s": "row 19999", "v": 19_999 / 7}
    began = time.perf_counter()
    by_hand = pa.array([by_library(cls.FromString(x), schema, False) for x in raws])
    assert len(by_hand) == len(got) and 2 * mine < time.perf_counter() - began


def wire_varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_walk_finds_every_field():
    raws = [b"\x08\x01\x12\x02ab", b"", b"\x1d\x00\x00\x00\x00"] * 20
    f = wire.walk(wire.records_of(pa.array(raws)))
    assert f.number[:3].tolist() == [1, 2, 3] and f.record[:3].tolist() == [0, 0, 2] and (f.end - f.start)[:3].tolist() == [1, 2, 4] and not f.broken.any()
