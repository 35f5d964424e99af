"""Self-join of documents on the Jaccard similarity of their shingle sets (operator 6), by universe partition.

Two sets of sizes a and b with a similarity of four fifths or more differ in H = (a + b) / 9 shingles at most. For each
band of sizes the universe of shingles is dealt into more segments than H by hash. Then some segment holds the same
shingles of both sets, and a key made of a segment's subset finds the pair. Some segments may instead be indexed with
their one-deletion neighbourhood: the subset and each subset less one shingle; such a segment stands one difference, so
fewer and fuller segments do. How many are, is set for each band by a cost: keys to write, and keys so thin that chance
finds them. A band's keys serve pairs whose smaller set is in the band; a set takes part in its own band and in the one
or two below that its partners may be in.

A band has a few segments more than pigeons: a pair shares g of them at least. A segment that is empty in both sets makes
no key; only a set with g empty segments or more writes keys for these too. Of the others a pair shares as many as the
larger of the two sets' credits, g less the empty ones; so each set leaves out its most frequent keys, one fewer than its
credit: the rarest key that the two share is still there for both.

All sets of a key are compared to one of them first, its pivot, and then components decide: sets of one component need
no further look. Where a key still holds several components, more pivots follow, in rounds that make them 64 times as
many and link each member to the likeliest pivot of each other component; of these keys one in FEW takes part. In a last
round all sets of what is still not settled are compared to all that are in other components. So a group of near copies of
any size costs about a comparison for each member, and no link between different components is lost.

Keys travel with 40 bits and their bucket. Where two keys of one set fall together, its credit is less by one: of the
keys that a pair shares there are still as many as each set's credit says.

Equal sets are one node from the start: a node is a 64-bit hash of its set. A second hash tells whether different sets
have one node; the few that do (n * n / 2**65 are expected of n) take the second hash as their node, and their numbers are
known to all tasks. So different sets are told apart by 128 bits. Candidates are verified on the 64-bit hashes of their
shingles. Fixed-size bit tables, sent to all tasks, let most texts that no candidate needs stay where they are.

Defined results: a null or empty text has no shingles, links to nothing, and is its own component. Rows with one id are
nodes of their own; with a null id they are no one's component id while another id is there. Repeated rows fall in
one component, and so do texts that differ in case or space alone. A text of any length is taken whole. Of the rows that
could stay in drop_near_duplicates ties go by id, then by the set's number. Columns besides id and text play no part,
whatever their names; names for helper columns are chosen so that they meet none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from . import packed
from .io import fresh_names, give_back, shared_dir, small_batches
from .packed import bit_table, in_table
from .words import U64, Words, mix, slices, windows, words_of

SLICE = 2 << 20
#: Pairs of sets that go to Python at once; a set takes eight bytes for each shingle.
VERIFY_ROWS = 100
#: Sets of a key that are compared with as many at once, and such rows that go to Python at once.
BLOCK_SETS, BLOCK_ROWS = 256, 10

SIZE = 5
NODE_BITS = 40
MASK = (1 << NODE_BITS) - 1


#: A key takes a copy of its pivot for each so many of its sets, and at most so many copies; sets are dealt among them.
SALT_SETS, SALTS = 256, 64
#: Sets of keys with so many or fewer meet as pairs in rows, those of others in blocks.
PAIR_SETS = 16
#: Of larger keys, one in so many is looked at before the last round.
FEW = 8


@dataclass(frozen=True)
class Plan:
    """ratio: of a band's sizes. spare: segments beyond those that differences can spoil, as a share of these. thin_cost:
    what a key that chance may find costs, in keys. node_bits: fewer than 64 only in tests."""

    ratio: float = 1.4
    spare: float = 0.25
    thin_cost: float = 6.0
    node_bits: int = 64


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    differ: int
    segments: int
    deleting: int
    spare: int


def expected_cost(size: float, segments: int, deleting: int, spare: int, thin_cost: float) -> float:
    """Keys that a set of a size is expected to write, and thin_cost for each that has one shingle only and that the set's
    credit does not let it leave out."""
    p = 1 / segments
    none, one = (1 - p) ** size, size * p * (1 - p) ** (size - 1) if segments > 1 else float(size == 1)
    two = size * (size - 1) / 2 * p**2 * (1 - p) ** (size - 2) if segments > 1 else float(size == 2)
    plain = segments - deleting
    keys = segments * (1 - none) + deleting * size * p
    thin = plain * one + deleting * (one + 2 * two)
    credit = (spare - plain * none - 2 * deleting * (none + one)) / (2 if deleting else 1)
    return keys + thin_cost * max(thin - max(credit - 1, 0), 0)


@cache
def bands(plan: Plan, most: int) -> list[Band]:
    """Bands of sizes up to most; high is exclusive. deleting: so many segments, the first ones, have neighbourhoods."""
    out, low = [], 1
    while low <= most:
        high = max(low + 1, int(low * plan.ratio))
        top = high - 1
        differ = (top + top * 5 // 4) // 9
        spares = 3 + int(plan.spare * differ)
        size, best = (low + top) / 2, None
        for deleting in range(min(differ, 64) + 1):
            # plain segments take all the spare ones, since a set leaves frequent keys out; a few are tried with neighbourhoods
            for spare in range(1, min(spares, 8) + 1) if deleting else (spares,):
                segments = differ + spare - deleting
                if segments < max(1, deleting):
                    continue
                cost = expected_cost(size, segments, deleting, spare, plan.thin_cost)
                if best is None or cost < best[0]:
                    best = (cost, Band(low, high, differ, segments, deleting, spare))
        out.append(best[1])
        low = high
    return out


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds."""
    hashes, left, row, n = words.hashes(), words.left(), words.doc(), words.counts
    names = windows(hashes, SIZE)
    at = np.flatnonzero(left[: len(names)] >= SIZE)
    values, rows = [names[at]], [row[at]]
    for k in range(1, SIZE):
        short = np.flatnonzero(n == k)
        if len(short):
            values.append(windows(hashes, k)[words.bounds[short]] + U64(k))
            rows.append(short)
    value, rows_ = np.concatenate(values), np.concatenate(rows)
    if len(values) > 1:
        order = np.argsort(rows_, kind="stable")
        value, rows_ = value[order], rows_[order]
    bounds = np.searchsorted(rows_, np.arange(len(n) + 1)).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        value[a:b].sort()
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (rows_[1:] != rows_[:-1])])
        value, rows_ = value[new], rows_[new]
    return value, np.searchsorted(rows_, np.arange(len(n) + 1))


def set_sums(values: np.ndarray, bounds: np.ndarray, salt: int = 0x6A09E667F3BCC909) -> np.ndarray:
    """A hash of each set; those of two salts are independent."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values ^ U64(salt)), dtype=U64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U64))


def keys_of(values: np.ndarray, bounds: np.ndarray, plan: Plan, short: Callable[[np.ndarray], np.ndarray] = lambda keys: keys) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, rows of the sets they are of, and notes: four times the set's credit, and which of its bands the key is of.
    short: what is left of the keys when they are compared."""
    n = np.diff(bounds)
    if not len(n) or not n.max():
        return
    table = bands(plan, int(n.max()))
    lows = np.array([b.low for b in table])
    segments, deleting, spare, differ = (np.array([getattr(b, x) for b in table], np.int64) for x in ("segments", "deleting", "spare", "differ"))
    row = np.repeat(np.arange(len(n)), n)
    own = np.searchsorted(lows, np.maximum(n, 1), "right") - 1
    least = np.searchsorted(lows, np.maximum(-(-4 * n // 5), 1), "right") - 1
    token = mix(values + U64(0x510E527F))
    for below in range(4):
        band = own - below
        takes = (n > 0) & (band >= least) & (band >= 0)
        takes &= differ[np.maximum(band, 0)] > 0
        if not takes.any():
            continue
        mine = takes[row]
        r, v, t = row[mine], values[mine], token[mine]
        size = np.where(takes, segments[np.maximum(band, 0)], 0)
        offset = np.concatenate([[0], np.cumsum(size)])
        b = band[r]
        segment = (mix(v ^ mix(b.astype(U64) + U64(77))) % segments[b].astype(U64)).astype(np.int64)
        place = offset[r] + segment
        sums = np.zeros(offset[-1], U64)
        np.add.at(sums, place, t)
        count = np.bincount(place, minlength=offset[-1])
        owner = np.repeat(np.arange(len(n)), size)
        number = np.arange(offset[-1]) - offset[owner]
        salt = mix(band[owner].astype(U64) * U64(1 << 24) + number.astype(U64))
        open_ = number < deleting[band[owner]]
        thin = np.where(open_, 2 * (count <= 1), count == 0)
        weak = np.bincount(owner, thin, len(n)).astype(np.int64)
        spares = spare[np.maximum(band, 0)]
        share = spares - weak
        credit = np.where(share > 0, -(-share // np.where(deleting[np.maximum(band, 0)] > 0, 2, 1)), 0)
        note = credit * 4 + below
        emit = (count > 0) | (weak >= spares)[owner]
        keys, rows = [mix(sums[emit] + salt[emit])], [owner[emit]]
        less = open_[place] & ((count[place] > 1) | (weak >= spares)[r])
        if less.any():
            keys.append(mix(sums[place[less]] - t[less] + salt[place[less]]))
            rows.append(r[less])
        key, of = np.concatenate(keys), np.concatenate(rows)
        yield key, of, note[of] - 4 * np.minimum(fallen_together(short(key), of, len(n)), credit)[of]


def fallen_together(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of each row, how many of its keys are equal to another one of it."""
    hashed = np.sort(mix(keys ^ mix(rows.astype(U64))))
    if not (hashed[1:] == hashed[:-1]).any():
        return np.zeros(n, np.int64)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    return np.bincount(rows[1:][(keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])], minlength=n)


@dataclass(frozen=True)
class Names:
    """How sets are numbered: by bits of their hash, those with a number in shared by their second hash."""

    bits: int = 64
    shared: tuple[int, ...] = ()

    def __call__(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        node = set_sums(values, bounds) >> U64(64 - self.bits)
        again = np.isin(node.view(np.int64), np.array(self.shared, np.int64)) if self.shared else np.zeros(len(node), bool)
        return np.where(again, self.second(values, bounds), node.view(np.int64))

    def second(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return set_sums(values, bounds, 0xBB67AE8584CAA73B).view(np.int64)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of the texts, their bounds, and the texts' nodes."""
        values, bounds = shingle_sets(words_of(column, lower=True))
        return values, bounds, self(values, bounds)


def _sets(batches: Iterator[pa.RecordBatch], names: Names) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for part in slices(batches, "_text", SLICE):
        yield part, *names.of(part.column("_text"))


def sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set, whether an even or an odd number of its hashes fall on each of a power of two of bits, no fewer than
    twice its hashes and 256; with fewer, sets a little too different would pass in numbers. Two sets differ in no fewer hashes than their sketches in bits, also when the longer one is folded."""
    n = np.diff(bounds)
    bits = np.maximum(256, 2 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    offset = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(offset[:-1], n) + (mix(values ^ U64(0x3C6EF372)).astype(np.int64) & (np.repeat(bits, n) - 1))
    packed_ = np.packbits((np.bincount(at, minlength=offset[-1]) & 1).astype(bool)).tobytes()
    return [packed_[a // 8 : b // 8] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]


def profiles(texts: DataFrame, names: Names) -> DataFrame:
    """doc_id, node, second, n_shingles, sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, bounds, node in _sets(batches, names):
            columns = [part.column("_key"), pa.array(node), pa.array(names.second(values, bounds)), pa.array(np.diff(bounds)), pa.array(sketches(values, bounds), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "second", "n_shingles", "sketch"])

    return texts.mapInArrow(run, "doc_id long, node long, second long, n_shingles long, sketch binary")


def numbered(texts: DataFrame, work: Workspace, bits: int) -> tuple[DataFrame, DataFrame, Names]:
    """Rows (doc_id, node, n_shingles), nodes (node, n_shingles, sketch), and the numbering that tells all sets apart."""
    names = Names(bits)
    while True:
        rows = work.keep(profiles(texts, names))
        first = F.first(F.struct("n_shingles", "sketch")).alias("x")
        nodes = work.keep(rows.where("n_shingles > 0").groupBy("node").agg(first, F.min("second").alias("low"), F.max("second").alias("high")).select("node", "x.*", (F.col("low") != F.col("high")).alias("shared")))
        shared = [r.node for r in nodes.where("shared").select("node").toLocalIterator()]
        if not shared:
            return rows.drop("second", "sketch"), nodes.drop("shared"), names
        names = Names(bits, tuple(sorted({*names.shared, *shared})))


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits: bits that fall together are added without carry."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out, each once, smaller node first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sa"), batch.column("sb")
            most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) // 9
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint8), np.frombuffer(right[i].as_buffer(), np.uint8)
                size = min(len(x), len(y))
                ok[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum() <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * 80
    once = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return once.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def across(now: DataFrame, level: int, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a member of a key and one of the key's pivots of a level that have different labels and are not
    ruled out: up to a key's depth, of each member and label of pivots the pair that sketches tell least apart, and beyond
    it, where all members are pivots, every pair. Members and pivots meet as packed blocks of about BLOCK_SETS sets, so a
    row is a pair of blocks; only what is left of the pairs becomes rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (_block(batch.column(c), i) for c in ("members", "pivots"))
                size = min(min(map(len, x[3])), min(map(len, y[3])))
                left = np.stack([folded(s, size) for s in x[3]]).view(U64)
                at, which, far = [], [], []
                for k, (n, label, sketch) in enumerate(zip(*y[1:], strict=True)):
                    apart = np.bitwise_count(left ^ folded(sketch, size).view(U64)).sum(1, dtype=np.int64)
                    ok = np.flatnonzero((apart <= (x[1] + n) // 9) & (x[2] != label) & (100 * np.minimum(x[1], n) >= 80 * np.maximum(x[1], n)))
                    at.append(ok)
                    which.append(np.full(len(ok), k))
                    far.append(apart[ok])
                at_, which_, far_ = (np.concatenate(c) for c in (at, which, far))
                if not batch.column("every")[i].as_py():
                    order = np.lexsort((which_, far_, y[2][which_], at_))
                    at_, which_ = at_[order], which_[order]
                    first = np.ones(len(at_), bool)
                    first[1:] = (at_[1:] != at_[:-1]) | (y[2][which_[1:]] != y[2][which_[:-1]])
                    at_, which_ = at_[first], which_[first]
                a_, b_ = x[0][at_], y[0][which_]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a_, b_)), pa.array(np.maximum(a_, b_))], names=["a", "b"])

    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n_left") / BLOCK_SETS)).alias("block")
    every = (F.col("depth") < level).alias("every")
    rows = now.select("key", "node", "level", "label", "n_left", "depth").join(nodes, "node").select("key", block, every, "level", F.struct("node", "n_shingles", "label", "sketch").alias("x"))
    members = rows.groupBy("key", "block", "every").agg(F.collect_list("x").alias("members")).drop("block")
    pivots = rows.where(F.col("every") | (F.col("level") == level)).groupBy("key", "block").agg(F.collect_list("x").alias("pivots")).drop("block")
    return members.join(pivots, "key").select("members", "pivots", "every").mapInArrow(run, "a long, b long").distinct()


def _block(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, sizes, labels and sketches of a row's list."""
    values = column[i].values
    node, n, label = (values.field(k).to_numpy() for k in range(3))
    return node, n, label, [np.frombuffer(s.as_buffer(), np.uint8) for s in values.field(3)]


def shared_keys(texts: DataFrame, plan: Plan, buckets: packed.Buckets, names: Names) -> DataFrame:
    """key, short (a node's low bits), note, n_sets: of the keys that two nodes or more have, in rows of a key and node."""
    wish = packed.Wish(2, by_doc=True, hot=4)
    size = NODE_BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = packed.Dealer(buckets, wish, key_bytes=size), set()
        for _, values, bounds, node in _sets(batches, names):
            # of equal sets that a task meets, one is enough
            new = np.zeros(len(node), bool)
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            if len(seen) > 1 << 20:
                seen.clear()
            for keys, row, note in keys_of(values, bounds, plan, lambda keys: packed.short_keys(keys, buckets.keys, size)):
                take = new[row]
                yield from dealer.add(keys[take], node[row[take]] & MASK, note[take])
        yield from dealer.flush()
        give_back()

    dealt = texts.mapInArrow(run, packed.DEALT)
    places = packed.wanted(dealt, buckets, wish, each=True, key_bytes=size)
    return places.select("key", F.col("doc").alias("short"), F.col("spot").cast("int").alias("note"), F.col("n").alias("n_sets"))


def having(nodes: DataFrame, wanted: DataFrame, work: Workspace) -> DataFrame:
    """The rows of nodes that wanted may name, by a bit table, kept: what is joined with few nodes then shuffles these, where
    it would shuffle the sketches of all."""
    bits = nodes.sparkSession.sparkContext.broadcast(bit_table(wanted, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_table(bits.value, batch.column("node").to_numpy())))

    kept = work.keep(nodes.mapInArrow(run, nodes.schema))
    bits.destroy()
    return kept


def sets_of(texts: DataFrame, nodes: DataFrame, names: Names, work: Workspace) -> DataFrame:
    """node, shingles (packed hashes) of the nodes, kept."""
    bits = texts.sparkSession.sparkContext.broadcast(bit_table(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, values, bounds, node in _sets(batches, names):
            rows = []
            for i in np.flatnonzero(in_table(bits.value, node)).tolist():
                if int(node[i]) not in seen:
                    seen.add(int(node[i]))
                    rows.append((int(node[i]), values[bounds[i] : bounds[i + 1]].tobytes()))
            if len(seen) > 1 << 20:
                seen.clear()
            if rows:
                yield packed.batch_of(rows, [pa.int64(), pa.binary()], ["node", "shingles"])

    kept = work.keep(texts.mapInArrow(run, "node long, shingles binary").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))
    bits.destroy()
    return kept


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, one = None, None
            ok = np.zeros(batch.num_rows, bool)
            left, right = batch.column("left"), batch.column("right")
            keys = batch.column("b").to_pylist()
            for i in range(batch.num_rows):
                if last is None or keys[i] != last:
                    last, one = keys[i], np.frombuffer(right[i].as_buffer(), U64)
                other = np.frombuffer(left[i].as_buffer(), U64)
                small, large = (other, one) if len(other) <= len(one) else (one, other)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                ok[i] = 100 * both >= 80 * (len(one) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


class Workspace:
    """Tables in the shared folder; each cuts the lineage of what comes after it."""

    def __init__(self, spark, name: str):  # noqa: ANN001
        self.spark, self.top, self.n = spark, shared_dir(spark, name), 0

    def keep(self, df: DataFrame, batch_rows: int = 2000) -> DataFrame:
        """batch_rows: rows that go to Python at once while the table is written."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(batch_rows))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(name, before)
        return self.spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, label: the least node that each node of the edges reaches. Labels take the least of their neighbours' and
    then of their labels' labels, until nothing changes."""
    both = work.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        named = labels.select(F.col("node").alias("b"), "label")
        near = both.join(named, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = work.keep(moved.join(top, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def key_members(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, n, copies of what shared_keys found: of a set's keys in one band the most frequent are left out, as many
    as its credit less one. One exchange, by short, does for the join, the repetitions and the ranks."""
    named = nodes.select(F.col("node").bitwiseAND(F.lit(MASK)).alias("short"), "node", F.col("n_shingles").alias("n"))
    below, credit = F.col("note").bitwiseAND(F.lit(3)).alias("below"), F.shiftright("note", 2).alias("credit")
    keyed = found.repartition("short").join(named, "short").select("short", "node", "key", "n", below, credit, "n_sets").distinct()
    frequent = F.row_number().over(Window.partitionBy("short", "node", "below").orderBy(F.desc("n_sets"), "key"))
    copies = F.least(F.lit(SALTS), F.ceil(F.col("n_sets") / SALT_SETS)).cast("int").alias("copies")
    return keyed.withColumn("rank", frequent).where(F.col("rank") >= F.col("credit")).select("key", "node", "n", copies)


def salt() -> Column:
    """Which copy of what belongs to its key a member meets."""
    return F.pmod(F.xxhash64("node"), F.col("copies")).alias("salt")


def salted(by_key: DataFrame) -> DataFrame:
    """A row for each copy of a key."""
    return by_key.select(*[c for c in by_key.columns if c != "copies"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("salt"))


def levelled(members: DataFrame) -> DataFrame:
    """Members of keys of three sets or more, with the number of sets (n_left), the depth of the key and the member's level:
    0 for few, each next one for 64 times as many, up to the depth for the last."""
    sizes = members.groupBy("key", "copies").agg(F.count("*").alias("n_left")).where("n_left > 2")
    draw = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    depth = F.ceil(F.log2(F.col("n_left").cast("double")) / 6).cast("int")
    level = F.greatest(F.lit(0), F.col("depth") + F.ceil(F.log2(draw + F.lit(2.0**-31)) / 6).cast("int"))
    return members.withColumn("salt", salt()).join(salted(sizes), ["key", "salt"]).select("key", "node", "n", "copies", "n_left", depth.alias("depth")).withColumn("level", level)


def labelled(members: DataFrame, labels: DataFrame, name: str = "label") -> DataFrame:
    """Members with the label of their node; without one a node is its own."""
    named = labels.select("node", F.col("label").alias("_label"))
    return members.drop(name).join(named, "node", "left").withColumn(name, F.coalesce("_label", "node")).drop("_label")


def unsettled(members: DataFrame, *within: str) -> DataFrame:
    """Labelled members of the keys (and what else is in within) that hold different labels."""
    by = ["key", *within]
    keys = members.groupBy(*by, "copies").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(*by, "copies")
    left, right = members.withColumn("salt", salt()).alias("l"), salted(keys).alias("r")
    return left.join(right, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "salt")], "left_semi").drop("salt")


def pairs_within(members: DataFrame, *within: str) -> DataFrame:
    """Pairs (a, na, b, nb) of members of a key that have different labels; only for keys of few sets."""
    side = lambda x: members.select("key", *within, *(F.col(c).alias(f"{c}{x}") for c in ("node", "n", "label")))
    same = [F.col("x.key") == F.col("y.key"), *(F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in within)]
    both = side("1").alias("x").join(side("2").alias("y"), same).where("node1 < node2 AND label1 <> label2")
    return both.select(F.col("node1").alias("a"), F.col("n1").alias("na"), F.col("node2").alias("b"), F.col("n2").alias("nb"))


class Verifier:
    """Verifies candidate pairs, and holds the sets that it has fetched for that."""

    def __init__(self, texts: DataFrame, names: Names, work: Workspace):
        self.texts, self.names, self.work, self.sets = texts, names, work, None

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The edges among pairs, which is a kept table."""
        if pairs.isEmpty():
            return pairs
        nodes = self.work.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        if self.sets is None:
            mine = self.sets = sets_of(self.texts, nodes, self.names, self.work)
        else:
            missing = self.work.keep(nodes.join(self.sets.select("node"), "node", "left_anti"))
            if not missing.isEmpty():
                self.sets = self.sets.unionByName(sets_of(self.texts, missing, self.names, self.work))
            mine = self.sets.join(nodes, "node", "left_semi")
        return self.work.keep(verified(pairs, mine), VERIFY_ROWS)


def linked(texts: DataFrame, plan: Plan, key_buckets: int, work: Workspace) -> tuple[DataFrame, DataFrame, Names]:
    """Rows (doc_id, node, n_shingles), labels of the nodes that have links (node, label), and the nodes' numbering."""
    rows, nodes, names = numbered(texts, work, plan.node_bits)
    members = work.keep(key_members(shared_keys(texts, plan, packed.Buckets(key_buckets, 1), names), nodes))
    pivots = members.groupBy("key", "copies").agg(F.min(F.struct("node", "n")).alias("p"))
    stars = members.withColumn("salt", salt()).join(salted(pivots), ["key", "salt"])
    stars = stars.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("p.node").alias("b"), F.col("p.n").alias("nb"))
    stars = work.keep(plausible(stars, nodes))

    # sets with one pivot before all others are likely to be in one component; of small keys, the pairs of the other sets
    # are looked at now, so that all can be verified at once
    both = stars.select(F.col("a").alias("node"), F.col("b").alias("to")).union(stars.select("b", "a"))
    likely = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label"))
    members = work.keep(labelled(levelled(members), likely, "part"))
    small = F.col("n_left") <= PAIR_SETS
    apart = work.keep(unsettled(members.where(small).withColumn("label", F.col("part"))))
    verify = Verifier(texts, names, work)
    edges = verify(work.keep(stars.unionByName(plausible(pairs_within(apart), having(nodes, apart, work))).distinct()))
    labels = components(edges, work)
    # sets of a part, that were only likely to be in one component, have not met; a larger key is one part
    members, level = members.withColumn("part", F.when(small, F.col("part"))), 0
    while True:
        members = work.keep(unsettled(labelled(members.where(F.col("depth") >= level - 1), labels), "part"))
        if members.isEmpty():
            return rows, labels, names
        nodes = having(nodes, members, work)
        # a pair of near copies shares many keys, so few of these bring most of a group together; in the end all are looked at
        few = (F.col("depth") < level) | (F.pmod(F.xxhash64("key"), F.lit(FEW)) == 0)
        found = across(members.where(~small & few), level, nodes)
        if level == 0:
            found = found.unionByName(plausible(pairs_within(members.where(small), "part"), nodes))
            members = members.where(~small)
        more = verify(work.keep(found, BLOCK_ROWS))
        if not more.isEmpty():
            labels = joined_labels(labels, more, work)
        level += 1


def joined_labels(labels: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """The labels after more edges: components of the labels that these join, which are few, are put in their place."""
    named = labels.select("node", "label")
    ends = edges.join(named.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(named.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    ends = work.keep(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    tops = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b"), work)
    every = named.union(ends.select("a", "la")).union(ends.select("b", "lb")).distinct()
    top = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return work.keep(every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, node, label of each row; node stands for its set of shingles, label for its component."""
    return _near_duplicates(docs, plan, key, text)[0]


def _near_duplicates(docs: DataFrame, plan: Plan, key: str, text: str) -> tuple[DataFrame, Names]:
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "ngram-join")
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows, labels, names = linked(texts, plan, 2 * packed.bucket_count(docs).keys, work)
    label = F.when(F.col("n_shingles") > 0, F.coalesce("label", "node"))
    grouped = work.keep(rows.join(labels, "node", "left").select("doc_id", "n_shingles", "node", label.alias("label")))
    least = grouped.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "label"), names


def drop_near_duplicates(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the smallest id (then of the least shingle set, then any of rows
    that are equal in both). Rows without shingles all stay. Texts that no other links to are not shuffled."""
    work = Workspace(docs.sparkSession, "near-copies")
    rows, names = _near_duplicates(docs, plan, key, text)
    rows = rows.where("n_shingles > 0")
    # equal sets are put together first; of each component one set and one id of it stay
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    sets = work.keep(rows.groupBy("label", "node").agg(least.alias("first"), F.count("*").alias("n")))
    kept = sets.groupBy("label").agg(F.min(F.struct("first", "node")).alias("x"), F.sum("n").alias("total")).where("total > 1")
    node, of, stays = fresh_names(docs.columns, "node", "of", "stays")
    chosen = F.when(F.col("node") == F.col("x.node"), F.struct(F.lit(True).alias("stays"), F.col("first.doc_id").alias("id")))
    grouped = work.keep(sets.join(kept, "label").select(F.col("node").alias(of), chosen.alias(stays)))
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(grouped, of))
    columns = docs.columns

    def tagged(some: bool) -> DataFrame:
        """Rows whose node may be in a group (or is in none), with the node."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text, SLICE):
                _, bounds, nodes = names.of(part.column(text))
                take = pa.array((in_table(bits.value, nodes) & (np.diff(bounds) > 0)) == some)
                yield pa.RecordBatch.from_arrays([*part.columns, *([pa.array(nodes)] if some else [])], names=[*columns, *[node] * some]).filter(take)

        return docs.mapInArrow(run, StructType([*docs.schema.fields, *([StructField(node, LongType())] if some else [])]))

    own = [F.col(f"`{c}`") for c in columns]
    maybe = tagged(True).join(grouped, F.col(node) == F.col(of), "left")
    alone = maybe.where(F.col(of).isNull())
    first = maybe.where(F.col(f"{stays}.stays") & F.col(key).cast("long").eqNullSafe(F.col(f"{stays}.id"))).dropDuplicates([node])
    return tagged(False).unionByName(alone.select(own)).unionByName(first.select(own))
