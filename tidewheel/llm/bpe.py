"""Byte-level byte-pair encoding and decoding (operator 4).

A text is cut by the tokenizer's pattern; each piece is encoded by itself. Pieces that a task has not met yet are laid
out as rows of byte ids, padded to a few widths, and whole matrices are merged together: in each round every row merges
its leftmost pair of least rank, the pairs' ranks come from a hash table held in two arrays, and rows without a pair
left go out. Pieces wider than the widest matrix (1,024 bytes without a break) are merged one by one, all places of the
least rank in a round, so that their time grows with their length and not with its square.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each for itself; the
table's other columns pass through unchanged; one with the name of a new column is replaced. Pairs of equal rank do not
exist in a rank file; of a pair's places the leftmost is merged first. A text of any length is encoded in parts of 200,000
pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .io import give_back, small_batches
from .words import U64, slices

#: Widths of matrices, and bytes of one; a longer piece takes merge_long, as its rounds would cost the square of its length.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024)
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)
CACHE = 100_000
TEXT_BYTES = 1 << 20
#: What \s stands for in the rank files' library: Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pieces_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode has it, inside and outside of brackets."""
    pattern = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")
    return regex.compile(pattern)


class PairTable:
    """Ranks of pairs of ids by open addressing; a lookup takes arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(len(pairs) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = np.array([(a << 32) | b for a, b in pairs], np.int64)
        rank = np.array(list(pairs.values()), np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            key, rank, slot = key[~put], rank[~put], (slot[~put] + ~free[~put]) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair's id after the merge, which is its rank; NONE where there is no such pair. Negative ids have none."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        had = self.keys[slot]
        out = np.where(had == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((had != key) & (had != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            had = self.keys[slot[open_]]
            hit = had == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (had != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class BytePairs:
    """A tokenizer: ranks in the text form of rank files (base64 of the bytes and the id in each line), and a pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines() if rank_file else ())}
        self.find = pieces_pattern(pattern)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = PairTable(pairs)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        n = max(self.ranks.values()) + 1
        self.length = np.zeros(n, np.int64)
        self.token_bytes: list[bytes] = [b""] * n
        for token, rank in self.ranks.items():
            self.length[rank], self.token_bytes[rank] = len(token), token
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.place = np.cumsum(self.length) - self.length
        self.cache: dict[str, bytes] = {}

    def merge_matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of each row; rows have width bytes at most."""
        n = len(rows)
        ids = np.full((n, width), -1, np.int32)
        lengths = np.array([len(r) for r in rows])
        filled = np.arange(width) < lengths[:, None]
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        at, column = np.arange(n), np.arange(width)
        while len(at):
            place = ranks.argmin(1)
            row = np.arange(len(at))
            best = ranks[row, place]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[at[i]] = ids[i, : lengths[i]]
                keep = ~done
                at, ids, ranks, lengths, place, best = at[keep], ids[keep], ranks[keep], lengths[keep], place[keep], best[keep]
                row = np.arange(len(at))
                if not len(at):
                    break
            ids[row, place] = best
            take = np.minimum(column + (column > place[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            lengths = lengths - 1
            ids[row, lengths], ranks[:, -1] = -1, NONE
            last = np.minimum(place + 1, width - 1)
            ranks[row, place] = np.where(place + 1 < lengths, self.pairs(best, ids[row, last]), NONE)
            inner = np.flatnonzero(place > 0)
            ranks[inner, place[inner] - 1] = self.pairs(ids[inner, place[inner] - 1], best[inner])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """As one row of merge_matrix, for a piece of any length."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            ranks = self.pairs(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NONE:
                break
            places = np.flatnonzero(ranks == best)
            run = np.arange(len(places)) - np.maximum.accumulate(np.where(np.diff(places, prepend=-2) > 1, np.arange(len(places)), 0))
            places = places[run % 2 == 0]  # of places that overlap, each second
            if len(places) > 1:  # a pair with the new id that goes first would have to be merged between these
                merged = np.full(len(places), best, np.int32)
                after = np.minimum(places + 2, len(ids) - 1)
                before = np.maximum(places - 1, 0)
                near = [self.pairs(merged, ids[after]), self.pairs(ids[before], merged), self.pairs(merged, merged)]
                if min(x.min() for x in near) < best:
                    places = places[:1]
            ids = ids.copy()
            ids[places] = best
            ids = np.delete(ids, places + 1)
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Puts the pieces into the cache."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            else:
                width = next((w for w in WIDTHS if len(raw) <= w), 0)
                by_width.setdefault(width, []).append((piece, raw))
        for width, found in by_width.items():
            step = max(1, CELLS // max(width, 1))
            for at in range(0, len(found), step):
                part = found[at : at + step]
                got = self.merge_matrix([raw for _, raw in part], width) if width else [self.merge_long(raw) for _, raw in part]
                for (piece, _), ids in zip(part, got, strict=True):
                    self.cache[piece] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        found = [self.find.findall(t) if len(t) < TEXT_BYTES else None for t in texts]
        self._prepare(set(chain.from_iterable(x for x in found if x is not None)))
        get = self.cache.__getitem__
        out = [b"".join(map(get, x)) if x is not None else None for x in found]
        return [self._long(t) if x is None else x for t, x in zip(texts, out, strict=True)]

    def _prepare(self, pieces: set[str]) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.learn(pieces - self.cache.keys())

    def _long(self, text: str) -> bytes:
        every, parts = (m[0] for m in self.find.finditer(text)), []
        while part := list(islice(every, 200_000)):
            self._prepare(set(part))
            parts.append(b"".join(map(self.cache.__getitem__, part)))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        out = []
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20)].astype(np.int64)
            n = self.length[part]
            out.append(self.flat[np.repeat(self.place[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return b"".join(out)


_MADE: dict[tuple, BytePairs] = {}


def tokenizer(rank_file: bytes, pattern: str) -> BytePairs:
    """One for each Python worker."""
    key = (hash(rank_file), pattern)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = BytePairs(rank_file, pattern)
    return _MADE[key]


def with_codes(df: DataFrame, fields: str, made: Callable, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and the fields that made(tokenizer, list of packed ids, texts) returns as arrays.

    The rank file goes to the workers as a broadcast value; it has the size of a vocabulary, whatever the data."""
    small_batches(df.sparkSession)
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    new = StructType.fromDDL(fields).fields
    added = [f.name for f in new]
    names = [c for c in df.columns if (keep is None or c in keep) and c not in added]
    schema = StructType([*(df.schema[c] for c in names), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value, pattern)
        for batch in slices(batches, text, TEXT_BYTES):
            texts = batch.column(text).fill_null("").to_pylist()
            columns = made(t, t.encode(texts), texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, *added])
        give_back()

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]).mapInArrow(run, schema)


DIGEST_FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(t: BytePairs, codes: list[bytes], texts: list[str]) -> list[pa.Array]:
    """The number of ids, and digests of the ids and of the bytes that they decode to."""
    back = [t.decode(np.frombuffer(c, "<u4")) for c in codes]
    return [
        pa.array([len(c) // 4 for c in codes], pa.int64()),
        pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
        pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
    ]


def id_lists(t: BytePairs, codes: list[bytes], texts: list[str]) -> list[pa.Array]:
    """The ids as an array for each text."""
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
    flat = np.frombuffer(b"".join(codes), "<i4")
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]


def digests_and_ids(t: BytePairs, codes: list[bytes], texts: list[str]) -> list[pa.Array]:
    return digests(t, codes, texts) + id_lists(t, codes, texts)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the ids of its texts as an array of integers."""
    return with_codes(df, f"{ids} array<int>", id_lists, path, pattern, text)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids give no bytes."""
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value, pattern)
        for batch in batches:
            got = [t.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got, pa.binary())], names=[*names, out])

    names = [c for c in df.columns if c != out]
    return df.mapInArrow(run, StructType([*(df.schema[c] for c in names), StructField(out, BinaryType())]))
