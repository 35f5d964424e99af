"""Removal of repeated passages by level-wise doubling (operator 2).

A window of W words can only be repeated if each shorter window inside it is. The search starts with windows of a base
length and doubles it until W. On a level shorter than W each W-window is stood for by its window of that length with
the least hash; the places of these are compared across the corpus, and only W-windows whose window is repeated stay
candidates for the next level, where the names of twice the length are made from two of the level before. On level W
the surviving candidates themselves are compared, by hash, and every occurrence but the first is marked; words under
marked windows go. A level without candidates deals nothing, so the levels above it have nothing to do.

On each level the texts of documents with marks are dealt by document with the marks of the level before, sorted, and
streamed: a task holds the marks of a bucket of documents and a slice of its texts. Which documents have marks a bit table
of fixed size tells all tasks; the others' texts stay where they are. Windows travel as packed hashes, never as text. On level W they
have 128 bits, two independent hashes; on lower levels, where a chance match costs a needless candidate only, 64.

Defined results: a null or empty text has no words and the digest of no bytes; a null id comes before all others; rows
with the same id count as documents one after the other, in order of their texts (of equal rows the first one keeps its
words); a text shorter than W loses nothing; a text of any length is taken whole. Columns besides id and text play no
part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .io import give_back, shared_dir, small_batches
from .words import U64, Words, doubled, slices, windows, words_of

NULL_DOC = -(1 << 63)
#: What is asked of the levels: on the last, all occurrences but the first.
ANY, LATER = packed.Wish(), packed.Wish(earliest=True)
#: A spot is a word's number, and above that which of the rows with one id it is in.
COPY = 1 << 40


def sliding(values: np.ndarray, k: int, pick: np.ufunc) -> np.ndarray:
    """Of each place, pick over the k values from there on; the last k - 1 places are left out."""
    have, out = 1, values
    while have < k:
        step = min(have, k - have)
        out = pick(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def names_of(words: Words, size: int, base: int, second: bool = False) -> np.ndarray:
    """Names of the windows of size words: base doubled as often as it takes. second: made from second hashes."""
    names, k = windows(words.hashes(second), base), base
    while k < size:
        names, k = doubled(names, k), 2 * k
    return names


def stand_ins(names: np.ndarray, size: int, window: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows that start where start is true: the least name of size words inside each, and where such names are."""
    least = sliding(names, window - size + 1, np.minimum)
    ok = start[: len(least)]
    shown = np.where(ok, least, U64(0))
    pad = np.zeros(window - size, U64)
    reach = sliding(np.concatenate([pad, shown, pad])[: len(names) + window - size], window - size + 1, np.maximum)
    # a place is shown if a window over it has its name as the least
    place = np.flatnonzero((reach[: len(names)] == names) & (names > 0))
    return least, place


class Placed:
    """Texts of a slice with the numbers of their rows, and places (doc, spot) of their words."""

    def __init__(self, docs: np.ndarray, copies: np.ndarray, text: pa.Array, window: int):
        self.words = words_of(text)
        self.docs, self.copies, self.window = docs, copies, window
        self.row = self.words.doc()
        self.start = self.words.left() >= window

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.row[at]
        return self.docs[row], self.copies[row] * COPY + at - self.words.bounds[row]

    def where(self, docs: np.ndarray, spots: np.ndarray, exact: bool) -> np.ndarray:
        """Word numbers of places that lie in these texts. exact: in the row that the spot names, else in any of the id."""
        order = np.argsort(self.docs, kind="stable")
        got = []
        n = self.words.counts
        at = np.searchsorted(self.docs[order], docs, "left")
        while True:
            on = np.flatnonzero((at < len(order)) & (docs == self.docs[order[np.minimum(at, len(order) - 1)]])) if len(order) else np.zeros(0, int)
            if not len(on):
                break
            row, spot = order[at[on]], spots[on] % COPY
            fits = spot < n[row]
            if exact:
                fits &= spots[on] // COPY == self.copies[row]
            got.append(self.words.bounds[row[fits]] + spot[fits])
            docs, spots, at = docs[on], spots[on], at[on] + 1
        return np.concatenate(got) if got else np.zeros(0, np.int64)


def _docs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


HELPERS = ["docbucket", "is_text", "docs", "spots"]


def placed_slices(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], pa.RecordBatch, Placed]]:
    """A bucket's marks, and its texts in order of id and text, slice by slice; rows of one id are numbered."""
    last, copy = None, 0
    for _, marks, batch in packed.marked_texts(batches, HELPERS):
        for part in slices(iter([batch]), "_text"):
            docs = _docs(part.column("_key"))
            lead = np.maximum.accumulate(np.where(np.concatenate([[True], docs[1:] != docs[:-1]]), np.arange(len(docs)), 0))
            copies = np.arange(len(docs)) - lead
            if docs[0] == last:  # no id is in two buckets
                copies[lead == 0] += copy + 1
            last, copy = docs[-1], int(copies[-1])
            yield marks, part, Placed(docs, copies, part.column("_text"), window)


def repeated_passages(df: DataFrame, window: int = 20, base: int = 10, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Of each row: key, n_words, n_removed, kept_sha256; with_text adds kept, the words that stay, joined by spaces."""
    levels = [base << i for i in range(64) if base << i <= window]
    if not levels or levels[-1] != window:
        raise ValueError("window must be base times a power of two")
    small_batches(df.sparkSession)
    buckets = packed.bucket_count(df)
    texts = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_DOC)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def with_marks(marks: DataFrame, bits: Any) -> DataFrame:
        """Texts of documents that may have marks, beside these."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(packed.in_table(bits.value, _docs(batch.column("_key")))))

        return beside(texts.mapInArrow(run, texts.schema), marks)

    def beside(some: DataFrame, marks: DataFrame) -> DataFrame:
        return packed.beside(some, marks, packed.doc_bucket_column(F.col("_key"), buckets.docs), "_key", "_text", HELPERS)

    def marked(marks: DataFrame) -> Any:
        return df.sparkSession.sparkContext.broadcast(packed.marked_docs(marks))

    def found(dealt: DataFrame, wish: packed.Wish) -> DataFrame:
        """The marks, kept: they are read for the bit table and again beside the texts."""
        path = shared_dir(df.sparkSession, "passages")
        packed.wanted(dealt, buckets, wish).write.parquet(path)
        return df.sparkSession.read.schema(packed.MARKS).parquet(path)

    def first_level(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part in slices(iter([batch]), "_text"):
            docs = _docs(part.column("_key"))
            placed = Placed(docs, np.zeros(len(docs), np.int64), part.column("_text"), window)
            names = names_of(placed.words, levels[0], base)
            at = np.flatnonzero(placed.start[: len(names)]) if levels[0] == window else stand_ins(names, levels[0], window, placed.start)[1]
            yield names[at], *placed.places(at)

    # on the only level left spots must tell rows of one id apart, so it starts from the dealt texts as the others do
    marks = found(packed.deal(texts, first_level, buckets, ANY), ANY) if len(levels) > 1 else None

    def named(placed: Placed, at: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Keys, places and, on the last level, second hashes of the windows at these places."""
        return names[at], *placed.places(at), *([names_of(placed.words, size, base, True)[at]] if size == window and len(at) else [])

    def next_level(before: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealer = packed.Dealer(buckets, LATER if size == window else ANY)
            for of_bucket, _, placed in placed_slices(batches, window):
                at = placed.where(*packed.own(*of_bucket, placed.docs), exact=False)
                names = names_of(placed.words, before, base)
                repeated = np.unique(names[at[at < len(names)]])
                if not len(repeated):
                    continue
                least = sliding(names, window - before + 1, np.minimum)
                near = np.minimum(np.searchsorted(repeated, least), len(repeated) - 1)
                start = placed.start.copy()
                start[len(least) :] = False
                start[: len(least)] &= repeated[near] == least
                names = doubled(names, before)
                at = np.flatnonzero(start[: len(names)]) if size == window else stand_ins(names, size, window, start)[1]
                yield from dealer.add(*named(placed, at, names, size))
            yield from dealer.flush()

        return compare

    for before, size in zip(levels, levels[1:], strict=False):
        dealt = with_marks(marks, marked(marks)).mapInArrow(next_level(before, size), packed.DEALT)
        marks = found(dealt, LATER if size == window else ANY)

    if marks is None:

        def only_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealer = packed.Dealer(buckets, LATER)
            for _, _, placed in placed_slices(batches, window):
                names = names_of(placed.words, window, base)
                yield from dealer.add(*named(placed, np.flatnonzero(placed.start[: len(names)]), names, window))
            yield from dealer.flush()

        none = df.sparkSession.createDataFrame([], packed.MARKS)
        marks = found(beside(texts, none).mapInArrow(only_level, packed.DEALT), LATER)

    fields = f"{key} long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in fields.split(", ")])

    def rows(placed: Placed, gone: np.ndarray) -> pa.RecordBatch:
        w = placed.words
        raw = w.data.tobytes()
        hashed, kept = [], []
        starts, ends, go = w.start.tolist(), w.end.tolist(), gone.tolist()
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            joined = b" ".join([raw[starts[i] : ends[i]] for i in range(a, b) if not go[i]])
            hashed.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept.append(joined.decode())
        sums = np.concatenate([[0], np.cumsum(gone)])
        columns = [pa.array(placed.docs, mask=placed.docs == NULL_DOC), pa.array(w.counts), pa.array(sums[w.bounds[1:]] - sums[w.bounds[:-1]]), pa.array(hashed, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if with_text else [])], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of_bucket, _, placed in placed_slices(batches, window):
            at = placed.where(*packed.own(*of_bucket, placed.docs), exact=True)
            step = np.zeros(len(placed.words.start) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            yield rows(placed, np.cumsum(step[:-1]) > 0)
        give_back()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            part = part.filter(pa.array(~packed.in_table(bits.value, _docs(part.column("_key")))))
            docs = _docs(part.column("_key"))
            if not len(docs):
                continue
            placed = Placed(docs, np.zeros(len(docs), np.int64), part.column("_text"), window)
            yield rows(placed, np.zeros(len(placed.words.start), bool))
        give_back()

    bits = marked(marks)
    return with_marks(marks, bits).mapInArrow(cut, fields).unionByName(texts.mapInArrow(whole, fields))
