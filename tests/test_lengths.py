"""Length-delimited files by ranges of any size against a read from the start."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidewheel.sources import lengths


def record(payload):
    return len(payload).to_bytes(4, "big") + payload


def from_start(raw):
    at, out = 0, []
    while (end := lengths._end(raw, at, len(raw))) is not None:
        out.append(raw[at + 4 : end])
        at = end
    return out


def made(seed):
    """Payloads of text, of zeros, of records in records, and of small numbers that look like lengths."""
    rng = random.Random(seed)
    kinds = [
        lambda: bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 40))),
        lambda: bytes(rng.randint(0, 60)),
        lambda: b"".join(record(bytes(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))),
        lambda: b"".join(rng.randrange(0, 30).to_bytes(4, "big") for _ in range(rng.randint(0, 12))),
        lambda: bytes(rng.randrange(256) for _ in range(rng.choice([3, 300]))),
    ]
    return b"".join(record(rng.choice(kinds)()) for _ in range(120)) + rng.choice([b"", b"\0\0", b"\0\0\0\x09cut", b"\xff\xff\xff\xff1234", record(b"")])


@pytest.mark.parametrize("seed", range(4))
def test_chains_against_walks(seed):
    raw = made(seed)
    rng = random.Random(seed)
    for _ in range(20):
        first = rng.randrange(len(raw))
        last = min(len(raw), first + rng.choice([1, 5, 40, 700]))
        got = list(zip(*(x.tolist() for x in lengths.chains(np.frombuffer(raw[first : last + 3], np.uint8), first, last, len(raw))), strict=True))
        want = []
        for s in range(first, last):
            at, n = s, 0
            while at < last and (end := lengths._end(raw, at, len(raw))) is not None:
                at, n = end, n + 1
            if at >= last:
                want.append((s, at, n))
        assert got == want


@pytest.mark.parametrize(("size", "most"), [(37, 64), (37, 1), (1000, 2), (1 << 20, 1)])
def test_records_by_ranges(spark, tmp_path, size, most):
    files = {f"f{seed}": made(seed) for seed in range(3)} | {"none": b"", "short": b"\0\0", "cut": b"\0\0\0\x02hi\0\0\0\0\0\0\0\x09cut", "long": record(b"x" * 5000) + record(b"y")}
    for name, raw in files.items():
        (tmp_path / f"{name}.bin").write_bytes(raw)
    rows = lengths.length_delimited(spark, str(tmp_path), size, most).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.number):
        got.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append((r.number, bytes(r.payload)))
    assert got == {n: list(enumerate(from_start(raw))) for n, raw in files.items() if from_start(raw)}
