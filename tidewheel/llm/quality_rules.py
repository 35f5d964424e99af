"""Rule-based cleaning by lines, then by documents (operator 8).

Each line is judged first: lines without closing punctuation, navigation bars, boilerplate phrases, shouting, symbol
clutter and repetitions of an earlier line of the text fail and are removed. A text is then rejected if the base rules
fail on the whole of it (too few words, too many repeated five-word windows), or if the removed lines held too many of
its words.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Lines without a word are
neither counted nor removed. Each row is judged by itself, so repeated ids and rows give repeated rows; of equal lines of a
text the first one is no repetition. A text of any length is taken whole. Columns besides id and text play no part, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .io import small_batches
from .words import U64, Words, lines_of, mix, per_text, slices, span_hashes, windows, words_of

# Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign in to",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "use of cookies",
)
# Bytes that may end a line of prose: . ! ? : ; " ' ) ] and the last bytes of the signs below.
CLOSING = b".!?:;\"')]"
CLOSING_WIDE = ("…", "”", "’", "»", "。", "！", "？")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules; a share is of the words of the line or text.

    min_words, max_repeat_percent: base rules. max_lost_percent: of a text's words, in removed lines. symbol_share: words
    with a symbol in a line that is clutter. bar_share: words that are only separators in a navigation line.
    upper_share: ASCII capitals among ASCII letters in a line that shouts; such lines have 5 letters or more.
    prose_words: a line of so many words with the end of a sentence inside needs no closing punctuation."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_lost_percent: int = 50
    symbol_share: float = 0.3
    bar_share: float = 0.2
    upper_share: float = 0.7
    prose_words: int = 8


@dataclass
class Judged:
    """Of each text: counts as in the contract, words in removed lines, verdicts; of each line: whether it stays."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lost_words: np.ndarray
    base_failed: np.ndarray
    kept: np.ndarray
    line_start: np.ndarray
    line_end: np.ndarray
    line_bounds: np.ndarray
    line_stays: np.ndarray


def seen_before(key: np.ndarray) -> np.ndarray:
    """Whether the same key stands at an earlier place."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def seen_twice(key: np.ndarray) -> np.ndarray:
    """Whether the same key stands at another place."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def repeated_words(words: Words, size: int = 5) -> np.ndarray:
    """Of each word, whether it lies in a window of size words that its text has twice or more."""
    names = windows(words.hashes(), size)
    whole = np.flatnonzero(words.left()[: len(names)] >= size)
    twice = whole[seen_twice(names[whole] ^ mix(words.doc()[whole].astype(U64) + U64(1)))]
    step = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + size, -1)
    return np.cumsum(step[:-1]) > 0


def _has_phrase(words: Words, line_start: np.ndarray, line_end: np.ndarray) -> np.ndarray:
    low = words.data.tobytes().lower()
    hit = np.zeros(len(line_start), bool)
    for phrase in BOILERPLATE:
        raw, at = phrase.encode(), -1
        while (at := low.find(raw, at + 1)) >= 0:
            i = int(np.searchsorted(line_start, at, "right")) - 1
            hit[i] |= at + len(raw) <= line_end[i]
    return hit


def judge(column: pa.Array, rules: Rules) -> Judged:
    words = words_of(column)
    data, bounds = words.data, words.bounds
    n = words.counts
    starts, ends, line_bounds = lines_of(words)
    first, last = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
    n_line = last - first
    filled = n_line > 0
    line_doc = np.repeat(np.arange(len(n)), np.diff(line_bounds))

    is_symbol = np.zeros(256, bool)
    is_symbol[np.frombuffer(SYMBOLS, np.uint8)] = True
    symbol = is_symbol[data]
    code_point = (data & 0xC0) != 0x80
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)

    def between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[b] - sums[a]

    keys = span_hashes(data, starts, ends) ^ mix(line_doc.astype(U64) + U64(1))
    again = np.zeros(len(starts), bool)
    again[filled] = seen_before(keys[filled])

    in_word = between(symbol, words.start, words.end)
    bare = in_word == words.end - words.start
    size = np.maximum(n_line, 1)
    final = np.where(filled, words.end[np.maximum(last - 1, 0)] - 1 if len(words.end) else 0, 0)
    closed = np.zeros(len(starts), bool)
    if len(data):
        tails = np.zeros(256, bool)
        tails[np.frombuffer(CLOSING, np.uint8)] = True
        closed = tails[data[final]]
        for sign in CLOSING_WIDE:
            raw = sign.encode()
            closed |= np.all([data[np.maximum(final - len(raw) + 1 + i, 0)] == b for i, b in enumerate(raw)], axis=0)
    sentence_end = np.isin(data[words.end - 1], np.frombuffer(b".!?", np.uint8))
    closed |= (n_line >= rules.prose_words) & (between(sentence_end, first, last) > 0)
    capitals = between(upper, starts, ends)
    letters = capitals + between(lower, starts, ends)
    fails = ~closed
    fails |= between(bare, first, last) >= rules.bar_share * size
    fails |= between(in_word > 0, first, last) >= rules.symbol_share * size
    fails |= (letters >= 5) & (capitals >= rules.upper_share * letters)
    fails |= _has_phrase(words, starts, ends)
    fails = (fails | again) & filled

    repeated = per_text(repeated_words(words), bounds)
    lost = per_text(np.where(fails, n_line, 0), line_bounds)
    base_failed = (n < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n)
    kept = ~base_failed & (100 * lost <= rules.max_lost_percent * n)
    return Judged(
        n, between(code_point & words.inside, words.offsets[:-1], words.offsets[1:]), between(symbol, words.offsets[:-1], words.offsets[1:]),
        per_text(again, line_bounds), repeated, lost, base_failed, kept, starts, ends, line_bounds, ~fails,
    )


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, base_failed boolean, kept boolean"


def quality_rules(df: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """The verdict on each row and the counts behind it; with_text adds cleaned, the text without its failed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            j = judge(batch.column(text), rules)
            counts = [j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.lost_words]
            columns = [batch.column(key).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in counts), pa.array(j.base_failed), pa.array(j.kept)]
            if with_text:
                raw = batch.column(text).fill_null("").to_pylist()
                cleaned = []
                for i, t in enumerate(raw):
                    stays = j.line_stays[j.line_bounds[i] : j.line_bounds[i + 1]]
                    cleaned.append(t if stays.all() else "\n".join(x for x, y in zip(t.split("\n"), stays, strict=True) if y))
                columns.append(pa.array(cleaned, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(df.sparkSession)
    fields = FIELDS + ", cleaned string" * with_text
    names = [x.split()[0] for x in fields.split(", ")]
    return df.select(key, text).mapInArrow(run, fields)
