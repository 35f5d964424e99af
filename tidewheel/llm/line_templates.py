"""Line dedup over a tree of log templates (operator 7).

Each line is parsed to a fixed depth: by its number of words, then by its leading words. Words with a digit are variable
and count as one sign, but for a line of one word. What follows the leading words is cut into fields; a template is either
the whole line, or the line with one field left open, so that lines of one shape with another name or phrase in it fall
together. A template recurs if its lines are in min_docs documents or more; whole lines of long_words words or more, which
do not recur by chance, do from long_docs documents on. Lines of recurring templates are dropped, but the first line of a
template, by document and place, stays if keep_first is set.

Templates are told apart by two independent 64-bit hashes, and lines by their id and a 61-bit hash of their row's text and
their number in it. Texts are streamed beside the marks of their bucket of documents.

Defined results: words are compared in lower case (A to Z). Null and empty texts stay as they are, as do lines without a
word. Rows with one id count as one document; a null id is an id before all others. Lines of rows that differ in text are
told apart, whatever their ids; rows equal in id and text are cut alike. If several rows of an id could keep the first line
of a template, one of them does; a line that is the first of one template and a later one of another goes. A text from
which every line goes is empty. Lines keep their order. A text of any length is taken whole, slice by slice only between
texts. Other columns pass through whatever their names, but n_lines and n_dropped are replaced if counts asks for them. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import packed
from .io import fresh_names, give_back, small_batches
from .words import _BASE, _BASE2, _UNBASE, _UNBASE2, U64, Words, _powers, column_bytes, lines_of, mix, per_text, slices, words_of

NULL_DOC = -(1 << 63)
#: In a spot, above the hash of the place: the row has a line of the same template before it; the template is a long line.
AGAIN, LONG = 1 << 62, 1 << 61


@dataclass(frozen=True)
class Tree:
    """leading: depth of the tree below the number of words. fields: of the rest of a line. open_words: lines of so many
    words may leave a field open."""

    leading: int = 3
    fields: int = 3
    open_words: int = 8
    min_docs: int = 10
    long_words: int = 20
    long_docs: int = 3
    keep_first: bool = True

    @property
    def wish(self) -> packed.Wish:
        return packed.Wish(self.min_docs, by_doc=True, earliest=self.keep_first, flag=LONG, flagged=min(self.long_docs, self.min_docs))


def line_keys(words: Words, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of templates, which line of the slice each belongs to, whether it is a long whole line, and second hashes."""
    starts, ends, _ = lines_of(words)
    first, last = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
    line = np.flatnonzero(last > first)
    first, n = first[line], (last - first)[line]
    digit = np.concatenate([[0], np.cumsum((words.data >= 48) & (words.data <= 57))])
    variable = digit[words.end] > digit[words.start]
    variable[first[n == 1]] = False
    wide = np.flatnonzero(n >= tree.open_words)
    found = []
    for second, base, unbase in ((False, _BASE, _UNBASE), (True, _BASE2, _UNBASE2)):
        token = np.where(variable, U64(0x5D1F), words.hashes(second))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(token * _powers(base, len(token)), dtype=U64)])
        back = _powers(unbase, len(token) + 1)

        def span(a: np.ndarray, b: np.ndarray, sums: np.ndarray = sums, back: np.ndarray = back) -> np.ndarray:
            return mix((sums[b] - sums[a]) * back[a])

        lead = np.minimum(tree.leading, n)
        path = mix(span(first, first + lead) + n.astype(U64) * U64(0x9E3779B97F4A7C15))
        cuts = [first + lead + (n - lead) * k // tree.fields for k in range(tree.fields + 1)]
        parts = [mix(span(a, b) + U64(k + 1)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        whole = path + sum(parts[1:], parts[0])
        found.append(np.concatenate([mix(whole), *(mix(whole[wide] - part[wide] + U64(0xA0761D65 + k)) for k, part in enumerate(parts))]))
    long = np.zeros(len(found[0]), bool)
    long[: len(n)] = n >= tree.long_words
    return found[0], np.concatenate([line, *[line[wide]] * tree.fields]), long, found[1]


def _docs(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_DOC).to_numpy(zero_copy_only=False)


def line_places(column: pa.Array, docs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash below LONG for each line of the texts: of the text, its id and the line's number."""
    offsets, data = column_bytes(column)
    texts = [hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    rows = mix(np.frombuffer(b"".join(texts), U64) + docs.view(U64) * U64(0x9E3779B97F4A7C15))
    row = np.repeat(np.arange(len(docs)), np.diff(bounds))
    number = np.arange(len(row)) - bounds[row]
    return (mix(rows[row] + number.astype(U64) * U64(0xA0761D6478BD642F)) >> U64(3)).view(np.int64)


def drop_recurring_lines(df: DataFrame, tree: Tree = Tree(), key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """df with its texts cut; counts adds n_lines (lines with a word) and n_dropped. A column n_chars is brought up to date."""
    small_batches(df.sparkSession)
    buckets = packed.bucket_count(df)
    added = ["n_lines", "n_dropped"] if counts else []
    df = df.drop(*added)

    def places(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for part in slices(iter([batch]), text):
            words = words_of(part.column(text), lower=True)
            keys, line, long, second = line_keys(words, tree)
            bounds = lines_of(words)[2]
            row, docs = np.searchsorted(bounds, line, "right") - 1, _docs(part.column(key))
            # a row's lines of one template lie in their order, the first of them before the others
            again = np.ones(len(keys), bool)
            again[np.unique(mix(keys + row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]] = False
            yield keys, docs[row], line_places(part.column(text), docs, bounds)[line] + again * AGAIN + long * LONG, second

    marks = packed.wanted(packed.deal(df.select(F.col(key).cast("long").alias(key), text), places, buckets, tree.wish), buckets, tree.wish)
    names = df.columns
    helpers = fresh_names(names, "bucket", "is_text", "docs", "spots")
    dealt = packed.beside(df, marks, packed.doc_bucket_column(F.coalesce(F.col(key).cast("long"), F.lit(NULL_DOC)), buckets.docs), key, text, helpers)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (docs, spots), batch in packed.marked_texts(batches, helpers):
            for part in slices(iter([batch]), text):
                words = words_of(part.column(text))
                starts, ends, bounds = lines_of(words)
                filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
                ids = _docs(part.column(key))
                line_ids, hashed = np.repeat(ids, np.diff(bounds)), line_places(part.column(text), ids, bounds)
                gone = among(line_ids, hashed, *packed.own(docs, spots & (LONG - 1), np.sort(ids)))
                texts, dropped = part.column(text).to_pylist(), per_text(gone, bounds)
                for i in np.flatnonzero(dropped):
                    stays = ~gone[bounds[i] : bounds[i + 1]]
                    texts[i] = "\n".join(x for x, y in zip(texts[i].split("\n"), stays, strict=True) if y)
                columns = {n: part.column(n) for n in names}
                columns[text] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    columns["n_chars"] = pa.array([None if x is None else len(x) for x in texts]).cast(kind)
                if counts:
                    columns |= {"n_lines": pa.array(per_text(filled, bounds)), "n_dropped": pa.array(dropped)}
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return dealt.mapInArrow(cut, StructType([*df.schema.fields, *(StructField(n, LongType()) for n in added)]))


def among(docs: np.ndarray, spots: np.ndarray, marked_docs: np.ndarray, marked_spots: np.ndarray) -> np.ndarray:
    """Whether (doc, spot) is one of the marked pairs."""
    order = np.argsort(marked_spots, kind="stable")
    sorted_, docs_of = marked_spots[order], marked_docs[order]
    at, end = np.searchsorted(sorted_, spots, "left"), np.searchsorted(sorted_, spots, "right")
    out = np.zeros(len(spots), bool)
    open_ = np.flatnonzero(end > at)
    while len(open_):
        out[open_] |= docs_of[at[open_]] == docs[open_]
        at[open_] += 1
        open_ = open_[(at[open_] < end[open_]) & ~out[open_]]
    return out
