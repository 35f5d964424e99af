"""Benchmark decontamination by spaced seeds (operator 5).

A seed is a fixed mask over a window of words; words at its open positions do not count, so a window still matches if
the words there were changed. Hashes of the masked windows of the benchmark are looked up by those of every window of the
corpus. A hit fixes how a text and an item lie against each other; along that line words are compared one by one, and the
stretch of best score (penalty) is taken. The text holds the item if the agreeing words of the stretch are min_words or
more, or four fifths of a shorter item. The best score may lie in a part of a stretch that is long enough; with
any_stretch, as the queries set it, the text also holds the item if any stretch in which four words in five or more agree
has as many agreeing words, and then the one of most agreeing words is given.

The benchmark goes out in blocks of about block_words words, one after the other, so that what the driver and a task hold
is bounded; a benchmark of more words takes more passes over the corpus. Windows that repeat, in a text and in an item, are
runs of places, and a pair of runs is one range of lines; lines are then compared in matrices of bounded size. So a text
of one word over and over costs its words times the item's, and no more room than others.

Defined results: words are compared in lower case (A to Z). Items with fewer than least_words words, null items and null
or empty texts take part in nothing. Repeated rows of either table give the same pair, once. Null ids are kept as null.
Of lines that agree in as many words the first one is given, and of rows with one id the earliest place. A text of any
length is taken whole. Columns besides id and text play no part, whatever their names. An empty table of documents or of
items gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import shared_dir, small_batches
from .words import U64, Words, mix, slices, words_of

#: Words of lines that are compared at once, and lines that are held beside those found.
CELLS = 1 << 20

FIELDS = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_matched long"


@dataclass(frozen=True)
class Seeds:
    masks: tuple[str, ...] = ("1110010111", "1101101011", "1011110101")
    least_words: int = 8
    min_words: int = 13
    penalty: int = 4
    block_words: int = 500_000
    any_stretch: bool = False

    @property
    def span(self) -> int:
        return max(map(len, self.masks))


def masked(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A hash of each window under a mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, salt, U64)
    for j, sign in enumerate(mask):
        if sign == "1":
            out *= U64(0xA0761D6478BD642F)
            out += hashes[j : j + n]
    return mix(out)


@dataclass
class Block:
    """Items of the benchmark: ids, word hashes and their bounds; seeds: sorted hashes, with item and word of each; the
    masks in use, and a table of bits that most other hashes miss."""

    ids: list
    hashes: np.ndarray
    bounds: np.ndarray
    masks: list[tuple[str, int]]
    seeds: np.ndarray
    item: np.ndarray
    word: np.ndarray
    bits: np.ndarray


def block_of(items: pa.Table, seeds: Seeds) -> Block:
    words = words_of(items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string()), lower=True)
    hashes, left, row = words.hashes(), words.left(), words.doc()
    n = words.counts
    short = sorted(set(n[(n >= seeds.least_words) & (n < seeds.span)].tolist()))
    masks = [(m, k + 1) for k, m in enumerate(seeds.masks)] + [("1" * k, 100 + k) for k in short]
    found, item, word = [], [], []
    for mask, salt in masks:
        h = masked(hashes, mask, salt)
        ok = left[: len(h)] >= len(mask)
        if salt > 100:
            ok &= n[row[: len(h)]] == len(mask)
        at = np.flatnonzero(ok)
        found.append(h[at])
        item.append(row[at])
        word.append(at - words.bounds[row[at]])
    keys, items_, words_ = (np.concatenate(x) for x in (found, item, word))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    bits = np.zeros(1 << 22, bool)
    bits[(keys >> U64(42)).astype(np.int64)] = True
    return Block(items.column("item_id").to_pylist(), hashes, words.bounds, masks, keys, items_[order], words_[order], bits)


def best_stretches(same: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a matrix: start and end of the stretch of most words that agree less penalty for each that does not."""
    sums = np.zeros((len(same), same.shape[1] + 1), np.int32)
    np.cumsum(np.where(same, 1, -penalty), axis=1, out=sums[:, 1:])
    least = np.minimum.accumulate(sums, axis=1)
    end = (sums - least).argmax(1)
    row = np.arange(len(same))
    low = (sums == least[row, end][:, None]) & (np.arange(sums.shape[1]) <= end[:, None])
    return sums.shape[1] - 1 - low[:, ::-1].argmax(1), end  # of equal stretches the shortest


def widest_stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a matrix: start and end of the stretch of most agreeing words among those in which four in five or
    more agree, from its first agreeing word to its last."""
    n, size = len(same), same.shape[1] + 1
    sums, count = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64)
    np.cumsum(np.where(same, 1, -4), axis=1, out=sums[:, 1:])
    np.cumsum(same, axis=1, out=count[:, 1:])
    row = np.arange(n)
    # of each end, the first start from which the sum does not fall; rows are told apart by more than sums can differ
    above = row[:, None] * (8 * size)
    least = np.minimum.accumulate(sums, axis=1)
    starts = np.searchsorted((above - least).ravel(), (above - sums).ravel(), "left").reshape(n, size) - row[:, None] * size
    starts = np.maximum(starts, 0)
    end = (count - np.take_along_axis(count, starts, 1)).argmax(1)
    place = np.arange(size - 1)
    inside = same & (place >= starts[row, end][:, None]) & (place < end[:, None])
    some = inside.any(1)
    return np.where(some, inside.argmax(1), 0), np.where(some, size - 1 - inside[:, ::-1].argmax(1), 0)


def widest_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing words of the widest stretch of one line."""
    start, end = (int(x[0]) for x in widest_stretches(same[None, :]))
    return start, end, int(same[start:end].sum())


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs in which the last column goes up by one and the others stay."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], np.diff(columns[-1]) != 1])
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.concatenate([first, [len(new)]]))


def chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of rows whose sizes sum up to most, or of one row."""
    sums, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        yield slice(at, end)
        at = end


def _spread(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts[i] to starts[i] + n[i] - 1 for each i, and the i of each."""
    of = np.repeat(np.arange(len(n)), n)
    return starts[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of


def lines(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and shift of each line on which a seed hits, in this order, each once: the item's word k lies on the
    slice's word shift + k. What is held beside these is bounded by CELLS."""
    hashes, left = words.hashes(), words.left()
    found: list[np.ndarray] = []
    reach = int(np.diff(block.bounds).max(initial=0))
    bits = int(len(hashes) + 2 * reach + 1).bit_length()
    item_bits = int(len(block.ids)).bit_length()
    key = np.cumsum(np.concatenate([[False], block.seeds[1:] != block.seeds[:-1]])) if len(block.seeds) else np.zeros(0, np.int64)
    first, size = runs(key, block.item, block.word)  # runs of seeds of one hash and item
    lead = np.concatenate([key[first], [-1]]) if len(first) else np.array([-1])
    for mask, salt in block.masks:
        h = masked(hashes, mask, salt)
        at = np.flatnonzero(block.bits[(h >> U64(42)).astype(np.int64)])
        at = at[left[at] >= len(mask)]
        near = np.searchsorted(block.seeds, h[at], "left")
        hit = block.seeds[np.minimum(near, len(block.seeds) - 1)] == h[at] if len(block.seeds) else np.zeros(len(at), bool)
        at, near = at[hit], near[hit]
        row = np.searchsorted(words.bounds, at, "right") - 1
        start, length = runs(row, near, at)  # runs of places of one hash and row
        a, b = np.searchsorted(lead[:-1], key[near[start]], "left"), np.searchsorted(lead[:-1], key[near[start]], "right")
        for part in chunks(b - a, CELLS):
            seed, of = _spread(a[part], (b - a)[part])
            place, n = at[start[part]][of], length[part][of]
            low = place - (block.word[first[seed]] + size[seed] - 1)
            many = n + size[seed] - 1
            name = ((row[start[part]][of] << item_bits) | block.item[first[seed]]) << bits
            for some in chunks(many, CELLS):
                shift, x = _spread(low[some], many[some])
                found.append(np.unique(name[some][x] | (shift + reach)))
                if sum(map(len, found)) > 4 * CELLS and len(found) > 8:
                    found = [np.unique(np.concatenate(found))]
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return every >> (bits + item_bits), (every >> bits) & ((1 << item_bits) - 1), (every & ((1 << bits) - 1)) - reach


def overlaps(column: pa.Array, block: Block, seeds: Seeds) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Row, item, word of the text, word of the item, words and agreeing words of each pair that is found."""
    words = words_of(column, lower=True)
    hashes = words.hashes()
    row, item, shift = lines(words, block)
    groups = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])) if len(row) else []
    for g, a in enumerate(groups):
        end = groups[g + 1] if g + 1 < len(groups) else len(row)
        low, high = int(words.bounds[row[a]]), int(words.bounds[row[a] + 1])
        wanted = block.hashes[block.bounds[item[a]] : block.bounds[item[a] + 1]]
        found = best_line(hashes[low:high], wanted, shift[a:end] - low, seeds)
        if found:
            yield (int(row[a]), int(item[a]), *found)


def best_line(text: np.ndarray, item: np.ndarray, shifts: np.ndarray, seeds: Seeds) -> tuple[int, int, int, int] | None:
    """Word of the text, word of the item, words and agreeing words of the first of the lines that agree best, if one does
    well enough. Words outside of the text agree with none."""
    size, best = len(item), None
    enough = min(seeds.min_words, -(-4 * size // 5))
    step = max(1, CELLS // size)
    for at in range(0, len(shifts), step):
        shift = shifts[at : at + step]
        place = shift[:, None] + np.arange(size)
        same = (place >= 0) & (place < len(text))
        same &= text[np.clip(place, 0, len(text) - 1)] == item
        able = np.flatnonzero(same.sum(1) >= enough)
        if not len(able):
            continue
        same, shift = same[able], shift[able]
        start, end = best_stretches(same, seeds.penalty)
        sums = np.zeros((len(same), size + 1), np.int64)
        np.cumsum(same, axis=1, out=sums[:, 1:])
        line = np.arange(len(same))
        agree = sums[line, end] - sums[line, start]
        less = np.flatnonzero(agree < enough)
        if seeds.any_stretch and len(less):
            start[less], end[less] = widest_stretches(same[less])
            agree = sums[line, end] - sums[line, start]
        k = int(agree.argmax())
        if agree[k] >= enough and (best is None or agree[k] > best[3]):
            best = (int(shift[k] + start[k]), int(start[k]), int(end[k] - start[k]), int(agree[k]))
            if agree[k] == size:
                break  # no line does better
    return best


def blocks(benchmark: DataFrame, seeds: Seeds) -> Iterator[tuple[Block, bool]]:
    """The items in blocks of about block_words words, one at a time; whether there are more."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").dropDuplicates()
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    total = items.agg(F.sum(words)).first()[0] or 0
    n = -(-2 * total // seeds.block_words) if total > seeds.block_words else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield block_of(items.where(part == k).orderBy("item_id", "text").toArrow(), seeds), k < n - 1


def kept_table(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = shared_dir(df.sparkSession, "decontaminate")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contaminated(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text and item that it holds: where, over how many words, and how many of them agree."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    def one(shared: Any) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "_text"):
                block, ids = shared.value, part.column("_key").to_pylist()
                rows = [(ids[r], block.ids[i], *found) for r, i, *found in overlaps(part.column("_text"), block, seeds)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        return source.mapInArrow(run, FIELDS)

    names = [x.split()[0] for x in FIELDS.split(", ")]
    parts = []
    for block, more in blocks(benchmark, seeds):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(kept_table(one(shared)) if more else one(shared))
        if more:
            shared.destroy()
    found = reduce(DataFrame.unionAll, parts)
    best = F.max_by(F.struct("doc_word", "item_word", "n_words", "n_matched"), F.struct("n_matched", -F.col("doc_word"), -F.col("item_word"), "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), text: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item; each row is judged in place, so nothing is shuffled. With more than
    one block of items, what a block leaves is written before the next one."""
    small_batches(docs.sparkSession)
    kept = docs
    for block, more in blocks(benchmark, seeds):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for part in slices(batches, text):
                held = np.ones(part.num_rows, bool)
                for row, *_ in overlaps(part.column(text), shared.value, seeds):
                    held[row] = False
                yield part.filter(pa.array(held))

        kept = kept.mapInArrow(run, docs.schema)
        if more:
            kept = kept_table(kept)
            shared.destroy()
    return kept
