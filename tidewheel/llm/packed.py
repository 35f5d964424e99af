"""Finding equal keys among many: keys and their places travel as packed arrays, dealt into buckets by key.

A key is a 64-bit hash, a place a pair of numbers (doc, spot). Rows of one array for each bucket and flush take a
fraction of the room and time of a row for each key. Of a key that a flush has more than once, one place goes to the
key's bucket, marked, and the others pass by any bucket: so a key that a large part of the corpus has brings its bucket
no more than a place for each flush. Where a chance match would do harm, keys come with a second hash of 64 bits (checks)
and are told apart by both; without it a chance match among n different keys has the probability n * n / 2**65.

Marks, the wanted places, meet their texts in a stream: both are dealt by document and sorted, a bucket's marks before its
texts, so that a task holds the marks of one bucket and a slice of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .io import give_back
from .words import U64

#: Places that a task gathers before it deals them out.
FLUSH = 1 << 18
DEALT = "bucket int, kind int, keys binary, docs binary, spots binary, checks binary"
DEALT_NAMES = ["bucket", "kind", "keys", "docs", "spots", "checks"]
MARKS = "docbucket int, docs binary, spots binary"

#: Bits of the tables that tell which texts may be needed: 2**25 of them, 4 MB.
TABLE_BITS = 1 << 25
#: Kinds of rows: places to be compared, and places that are known to be wanted.
COMPARE, KNOWN = 0, 1


@dataclass(frozen=True)
class Buckets:
    """Numbers of buckets of keys and of documents. A task writes a row for each bucket that it has something for."""

    keys: int
    docs: int


def bucket_count(df: DataFrame) -> Buckets:
    """Made from the number of shuffle partitions: what a cluster sets for its data also sets the size of a bucket."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Buckets(n, 2 * n)


def pack(values: np.ndarray, size: int = 8) -> bytes:
    """The low size bytes of 64-bit values, all first bytes, then all second ones: bytes that are often 0 lie together,
    and the shuffle's compression takes them away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unpack(raw: bytes, size: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view(U64)


def key_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(40)) % U64(n)).astype(np.int64)


PRIME, FACTOR = 2147483647, 48271


def doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document: a multiplicative hash, the same in doc_bucket_column."""
    return np.mod(np.mod(docs, PRIME) * FACTOR, PRIME) % n


def doc_bucket_column(key: Column, n: int) -> Column:
    return (F.pmod(F.pmod(key, F.lit(PRIME).cast("long")) * FACTOR, F.lit(PRIME).cast("long")) % n).cast("int")


def split_by(groups: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' values by group; within a group the order stays."""
    if not len(groups):
        return
    order = np.argsort(groups, kind="stable")
    sorted_, columns = groups[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(groups)]]), strict=True):
        yield int(sorted_[a]), [c[a:b] for c in columns]


def _rows(kind: int, groups: np.ndarray, places: Places, key_bytes: int) -> Iterator[tuple]:
    checks = places.keys[:0] if places.checks is None else places.checks
    for bucket, (at,) in split_by(groups, np.arange(len(groups))):
        yield bucket, kind, pack(places.keys[at], key_bytes), pack(places.docs[at]), pack(places.spots[at]), pack(checks[at] if len(checks) else checks)


def batch_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def dealt_batch(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(rows, [pa.int32(), pa.int32(), *[pa.binary()] * 4], DEALT_NAMES)


def _changes(*columns: np.ndarray | None) -> np.ndarray:
    """Of rows, whether one of the columns differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        if c is not None:
            new[1:] |= c[1:] != c[:-1]
    return new


@dataclass
class Places:
    """Keys, their documents and spots, and second hashes of the keys or None."""

    keys: np.ndarray
    docs: np.ndarray
    spots: np.ndarray
    checks: np.ndarray | None = None

    def take(self, at: np.ndarray) -> Places:
        return Places(self.keys[at], self.docs[at], self.spots[at], None if self.checks is None else self.checks[at])

    def order(self, ordered: bool) -> np.ndarray:
        """By key; ordered: and by doc and spot."""
        columns = [*([self.spots, self.docs] if ordered else []), *([] if self.checks is None else [self.checks]), self.keys]
        return np.lexsort(columns) if len(columns) > 1 else np.argsort(self.keys, kind="stable")

    @staticmethod
    def joined(parts: list[Places]) -> Places:
        one = [np.concatenate([getattr(p, x) for p in parts]) for x in ("keys", "docs", "spots")]
        return Places(*one, None if parts[0].checks is None else np.concatenate([p.checks for p in parts]))


@dataclass(frozen=True)
class Wish:
    """Which places of equal keys are wanted: those of keys with at least least places (by_doc: documents); earliest: all
    of them but the first by doc and spot. hot: a flush with so many places of a key (least at least) sends one of them to
    the key's bucket."""

    least: int = 2
    by_doc: bool = False
    earliest: bool = False
    hot: int = 0
    #: A key whose spots have the bit flag is wanted from flagged places or documents on.
    flag: int = 0
    flagged: int = 0

    def measure(self, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted places: the group of each, and each group's number of places or documents, and how many it takes."""
        first = _changes(places.keys, places.checks)
        group = np.cumsum(first) - 1
        counted = first | _changes(places.docs) if self.by_doc else np.ones(len(group), bool)
        least = np.where(places.spots[first] & self.flag, self.flagged, self.least) if self.flag else np.full(int(first.sum()), self.least)
        return group, np.bincount(group, counted).astype(np.int64), least

    def at_first(self, group: np.ndarray, places: Places) -> np.ndarray:
        """Of sorted places, whether each is the first of its group, or the same place again."""
        lead = np.flatnonzero(_changes(group))[group]
        return (places.docs == places.docs[lead]) & (places.spots == places.spots[lead]) if self.earliest else np.arange(len(group)) == lead

    @property
    def ordered(self) -> bool:
        return self.by_doc or self.earliest


def short_keys(keys: np.ndarray, buckets: int, key_bytes: int, bucket: int | None = None) -> np.ndarray:
    """What tells short keys apart: their bucket above their bytes."""
    above = key_bucket(keys, buckets).astype(U64) if bucket is None else U64(bucket)
    return (keys & U64((1 << 8 * key_bytes) - 1)) | (above << U64(8 * key_bytes))


class Dealer:
    """Gathers a task's places and deals them out. Of a key that one flush alone shows to be wanted, the first place is
    marked (by its spot's complement) and goes to the key's bucket; the others are known to be wanted. Where a chance match
    does no harm, key_bytes keeps fewer bytes of the keys; what tells keys apart is then these and their bucket."""

    def __init__(self, buckets: Buckets, wish: Wish, key_bytes: int = 8):
        self.buckets, self.wish, self.key_bytes = buckets, wish, key_bytes
        self.held: list[Places] = []
        self.size = 0

    def add(self, keys: np.ndarray, docs: np.ndarray, spots: np.ndarray, checks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.held.append(Places(keys, docs.astype(np.int64), spots.astype(np.int64), checks))
            self.size += len(keys)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        places = Places.joined(self.held)
        places = places.take(places.order(self.wish.ordered))
        self.held, self.size = [], 0
        group, n, least = self.wish.measure(places)
        enough = (n >= np.maximum(least, self.wish.hot))[group]
        first = _changes(group)
        same = self.wish.at_first(group, places)
        if (same & ~first).any():
            once = first | ~same
            places, enough, first = places.take(once), enough[once], first[once]
        known = enough & ~first
        places.spots = np.where(enough & first, ~places.spots, places.spots)
        n = self.buckets.keys
        met, apart = places.take(~known), places.take(known)
        rows = list(_rows(COMPARE, key_bucket(met.keys, n), met, self.key_bytes))
        if self.key_bytes < 8:
            apart.keys = short_keys(apart.keys, n, self.key_bytes)
        apart.checks = None
        rows += _rows(KNOWN, doc_bucket(apart.docs, n), apart, 8)
        for at in range(0, len(rows), 512):
            yield dealt_batch(rows[at : at + 512])


def deal(df: DataFrame, places: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], buckets: Buckets, wish: Wish) -> DataFrame:
    """Rows of DEALT for the keys, docs, spots and perhaps checks that places finds in df's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets, wish)
        for batch in batches:
            for found in places(batch):
                yield from dealer.add(*found)
        yield from dealer.flush()

    return df.mapInArrow(run, DEALT)


def by_bucket(batches: Iterator[pa.RecordBatch], name: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket, from batches sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[name] != now and rows:
                yield now, rows
                rows = []
            now = row[name]
            rows.append(row)
    if rows:
        yield now, rows


def arrays(rows: list[dict], key_bytes: int = 8) -> Places:
    if not rows:
        return Places(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    wide = any(r["checks"] for r in rows)
    parts = [(unpack(r["keys"], key_bytes), unpack(r["docs"]).view(np.int64), unpack(r["spots"]).view(np.int64), unpack(r["checks"]) if wide else None) for r in rows]
    return Places.joined([Places(*p) for p in parts])


PLACES = "key long, doc long, spot long, n long"
#: The number of documents of a key that some flush had too often for its places to meet in one bucket.
MANY = 1 << 31


def wanted(dealt: DataFrame, buckets: Buckets, wish: Wish, each: bool = False, key_bytes: int = 8) -> DataFrame:
    """Rows of MARKS: the wanted places, dealt by doc. each: rows of PLACES instead, one for each place, with the number of
    places or documents of its key, or MANY; it is the same for all places of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            compare = [r for r in rows if r["kind"] == COMPARE]
            known = arrays([r for r in rows if r["kind"] == KNOWN])
            found, many = [(known.keys, known.docs, known.spots)], [np.full(len(known.keys), MANY)]
            if compare:
                places = arrays(compare, key_bytes)
                if key_bytes < 8:
                    places.keys = short_keys(places.keys, buckets.keys, key_bytes, bucket)
                marked = places.spots < 0
                places.spots = np.where(marked, ~places.spots, places.spots)
                order = places.order(wish.ordered)
                places, marked = places.take(order), marked[order]
                group, n, least = wish.measure(places)
                n = np.where(np.bincount(group, marked) > 0, MANY, n)
                take = (n >= least)[group]
                if wish.earliest:
                    take &= ~wish.at_first(group, places)
                many.append(n[group][take])
                found.append((places.keys[take], places.docs[take], places.spots[take]))
            keys, docs, spots = (np.concatenate(x) for x in zip(*found, strict=True))
            if each:
                n = np.concatenate(many)
                for at in range(0, len(keys), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (keys.view(np.int64), docs, spots, n)], names=["key", "doc", "spot", "n"])
                continue
            out = [(b, pack(d), pack(s)) for b, (d, s) in split_by(doc_bucket(docs, buckets.docs), docs, spots)]
            yield batch_of(out, [pa.int32(), pa.binary(), pa.binary()], ["docbucket", "docs", "spots"])
        give_back()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PLACES if each else MARKS)


def beside(texts: DataFrame, marks: DataFrame, bucket: Column, key: str, text: str, helpers: list[str]) -> DataFrame:
    """texts, each bucket's after its marks, in order of id and text; helpers: names for the bucket, whether a row is of
    texts, and the docs and spots of marks. One exchange, and what a task holds does not grow with its bucket's texts."""
    b, is_text, docs, spots = helpers
    rows = texts.withColumn(b, bucket).withColumn(is_text, F.lit(True))
    of_marks = marks.select(F.col("docbucket").alias(b), F.lit(False).alias(is_text), F.col("docs").alias(docs), F.col("spots").alias(spots))
    both = rows.unionByName(of_marks, allowMissingColumns=True)
    return both.repartition(F.col(b)).sortWithinPartitions(b, is_text, F.col(f"`{key}`"), F.col(f"`{text}`"))


def marked_texts(batches: Iterator[pa.RecordBatch], helpers: list[str]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], pa.RecordBatch]]:
    """Bucket, docs and spots of its marks sorted by doc, and texts, from batches of beside."""
    b, is_text, docs, spots = helpers
    now, held, marks = None, [], None
    for batch in batches:
        bucket, kind = batch.column(b).to_numpy(), batch.column(is_text).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(_changes(bucket, kind)).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:], strict=False):
            if bucket[at] != now:
                now, held, marks = bucket[at], [], None
            part = batch.slice(at, end - at)
            if not kind[at]:
                held += zip(part.column(docs).to_pylist(), part.column(spots).to_pylist(), strict=True)
                continue
            if marks is None:
                marks, held = mark_arrays(held), []
            yield int(now), marks, part


def mark_arrays(marks: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Docs and spots of marks, sorted by doc."""
    docs, spots = (np.concatenate([unpack(m[k]).view(np.int64) for m in marks]) if marks else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(docs, kind="stable")
    return docs[order], spots[order]


def own(docs: np.ndarray, spots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of marks sorted by doc, those of ids from the first to the last of rows, which are sorted."""
    if not len(rows):
        return docs[:0], spots[:0]
    a, b = np.searchsorted(docs, rows[0], "left"), np.searchsorted(docs, rows[-1], "right")
    return docs[a:b], spots[a:b]


def bit_table(values: DataFrame, column: str) -> np.ndarray:
    """A table of TABLE_BITS bits in which those of the column's values are set. Its size does not depend on the data.
    Bucket 1 of Spark's bitmaps starts at the value 1, so places go in one higher."""
    at = F.pmod(F.col(column), F.lit(TABLE_BITS).cast("long")) + 1
    rows = values.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(TABLE_BITS // 8, np.uint8)
    for r in rows:
        raw = np.frombuffer(r["bits"], np.uint8)
        at_ = (r["b"] - 1) * 4096
        out[at_ : at_ + len(raw)] |= raw[: len(out) - at_]
    return out


def in_table(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the values' bits are set."""
    at = np.mod(values, TABLE_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def marked_docs(marks: DataFrame) -> np.ndarray:
    """A bit table of the documents of marks; dealt by bucket, each of them makes one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.int64)], 0
        for batch in batches:
            for raw in batch.column("docs").to_pylist():
                held.append(unpack(raw).view(np.int64))
                size += len(held[-1])
            if size > 1 << 20:
                held, size = [np.unique(np.concatenate(held))], 0
        docs = np.unique(np.concatenate(held))
        for at in range(0, len(docs), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + (1 << 17)])], names=["doc"])

    return bit_table(marks.select("docbucket", "docs").repartition("docbucket").mapInArrow(run, "doc long"), "doc")
