"""Toxicity by multiple-instance learning (operator 13).

A document is a bag of sentences and its label is known, those of its sentences are not. A sentence gets the probability
p = sigmoid(w . x + b) from the terms that it has; the document gets 1 - product of (1 - p), the noisy-or, so that one
offending sentence is enough and the model learns which one it was. w and b follow the gradient of the documents' log loss,
from a small probability for every sentence; a lasso leaves out what few documents speak for.

A sentence ends after . ! ? or at a newline. Its features are its terms (see terms.py) and their first three to five bytes,
hashed to a fixed number of places, each once; prefixes find forms that no labelled document has. Features of fewer than
min_docs learnt documents are left out.

The fit takes max_train labelled rows at most, half of each class, those first by a hash of their id, and of these the first
that have max_features features together; they come to the driver as integers of four bytes. Scoring covers every row and
reads the text only. Scores are for classes as frequent as in the fit.

Defined results: a null or empty text, or one without terms, has no sentence and gets the score 0.0. Labelled rows whose
label is null are not learnt from. With no row of one class left all documents with a term get 1.0 or 0.0 by the other class,
or 0.0 without any label. Repeated rows are scored each for itself; rows repeated in labels count as often in the fit. Ties
in the order of labelled rows go by id, then label. A text of any length is taken whole. Columns besides id, text and label
play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import shared_dir, small_batches
from .terms import Terms, terms_of
from .words import U64, slices, span_hashes

#: Text of so many bytes is turned into features at once, and the fit looks at so many features at once.
SLICE, STEP = 1 << 19, 1 << 19
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    prefixes: tuple[int, ...] = (3, 4, 5)
    min_docs: int = 3
    max_train: int = 6_000
    max_features: int = 1 << 23
    rounds: int = 100
    rate: float = 1.0
    lasso: float = 0.5
    start: float = -12.0
    threshold: float = 0.5


@dataclass
class Bags:
    """place: feature numbers; sentence i has those from features[i] to features[i+1], document j the sentences from
    sentences[j] to sentences[j+1]; start, end: of sentences, as bytes of the data."""

    place: np.ndarray
    features: np.ndarray
    sentences: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray
    bias: float

    def sentence_scores(self, bags: Bags) -> np.ndarray:
        return _sigmoid(_sums(self.weights[bags.place], bags.features) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(values)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def noisy_or(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return -np.expm1(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), bounds))


def bags_of(column: pa.Array, settings: Settings) -> Bags:
    terms = terms_of(column)
    if not len(terms.start):
        return Bags(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(terms.offsets), np.int64), *[np.zeros(0, np.int64)] * 2)
    ends = np.flatnonzero(_ENDS[terms.data])
    number = np.searchsorted(ends, terms.start)
    doc = terms.doc()
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])])
    sentence = np.cumsum(new) - 1
    n = int(sentence[-1]) + 1
    found = [(sentence, span_hashes(terms.data, terms.start, terms.end))]
    length = terms.end - terms.start
    for size in settings.prefixes:
        long = length >= size
        found.append((sentence[long], _prefix_hashes(terms, long, size)))
    shift = U64(64 - settings.bits)
    both = np.unique(np.concatenate([(s << settings.bits) | (h >> shift).astype(np.int64) for s, h in found]))
    first = np.flatnonzero(new)
    # a sentence reaches from the byte after the last end, or its text's start, to its own end, or its text's
    start = np.maximum(terms.offsets[doc[first]], np.concatenate([[0], ends + 1])[number[first]])
    end = np.minimum(terms.offsets[doc[first] + 1], np.concatenate([ends + 1, [len(terms.data)]])[number[first]])
    return Bags(both & ((1 << settings.bits) - 1), np.searchsorted(both, np.arange(n + 1) << settings.bits), np.searchsorted(doc[first], np.arange(len(terms.offsets))), start, end)


def _prefix_hashes(terms: Terms, which: np.ndarray, size: int) -> np.ndarray:
    """Of the bytes themselves, up to eight of them."""
    start = terms.start[which]
    value = np.full(len(start), size, U64)
    for j in range(size):
        value = value * U64(257) + terms.data[start + j]
    value *= U64(0x9E3779B97F4A7C15)
    value ^= value >> U64(32)
    return value * U64(0xD6E8FEB86659FD93)


def _documents_with(bags: Bags, dims: int) -> np.ndarray:
    """Of each feature the number of documents that have it."""
    out = np.zeros(dims, np.int64)
    ends = bags.features[bags.sentences]
    at = 0
    while at < len(ends) - 1:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
        place = bags.place[ends[at] : ends[end]].astype(np.int64)
        doc = np.repeat(np.arange(end - at), np.diff(ends[at : end + 1]))
        out += np.bincount(np.unique(doc * dims + place) % dims, minlength=dims)
        at = end
    return out


def fit(bags: Bags, labels: np.ndarray, settings: Settings) -> Model:
    """Adaptive gradient steps over all documents at a time, each feature with a rate of its own."""
    dims = 1 << settings.bits
    if len(set(labels.tolist())) < 2:
        return Model(settings, np.zeros(dims), 30.0 if len(labels) and labels[0] else -np.inf)
    doc_of = np.repeat(np.arange(len(labels)), np.diff(bags.sentences))
    row = np.repeat(np.arange(len(bags.features) - 1, dtype=np.int32), np.diff(bags.features))
    common = _documents_with(bags, dims) >= settings.min_docs
    used = (np.cumsum(common) - 1).astype(np.int32)
    keep = common[bags.place]
    place, row = used[bags.place[keep]], row[keep]
    n, m = int(common.sum()), len(bags.features) - 1

    def sums(by: np.ndarray, of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for at in range(0, len(by), STEP):
            out += np.bincount(by[at : at + STEP], values[of[at : at + STEP]], size)
        return out

    weights, bias, seen, seen_bias = np.zeros(n), settings.start, np.full(n, 1e-8), 1e-8
    positive = labels[doc_of] > 0
    for _ in range(settings.rounds):
        p = _sigmoid(sums(row, place, weights, m) + bias)
        whole = noisy_or(p, bags.sentences)[doc_of]
        # log loss by z: p * (1 - P) / P drawn up for toxic documents, p drawn down for others
        g = np.where(positive, -p * (1 - whole) / np.maximum(whole, 1e-9), p) / len(labels)
        slope = sums(place, row, g, n)
        seen += slope**2
        step = settings.rate / np.sqrt(seen)
        weights -= step * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * settings.lasso / len(labels), 0)
        seen_bias += g.sum() ** 2
        bias -= settings.rate * 0.2 * g.sum() / np.sqrt(seen_bias)
    out = np.zeros(dims)
    out[common] = weights
    return Model(settings, out, float(bias))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Fits the model on labelled rows; the caller leaves out what is not to be learnt from."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("_key"), F.col(label).cast("int").alias("_label"))
    half = max(1, settings.max_train // 2)
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(half)
        chosen = part if chosen is None else chosen.unionByName(part)
    joined = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).join(chosen, "_key")
    schema = "_key long, _label int, _sentences array<int>, _features array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            bags = bags_of(batch.column("_text"), settings)
            # a document's sentences by their numbers of features
            sizes = pa.ListArray.from_arrays(pa.array(bags.sentences.astype(np.int32)), pa.array(np.diff(bags.features).astype(np.int32)))
            places = pa.ListArray.from_arrays(pa.array(bags.features[bags.sentences].astype(np.int32)), pa.array(bags.place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), sizes, places], names=["_key", "_label", "_sentences", "_features"])

    path = shared_dir(spark, "toxicity")
    joined.mapInArrow(run, schema).write.parquet(path)
    learnt = spark.read.schema(schema).parquet(path)
    # at most max_train rows, or as many as labelled ids are repeated in docs, are counted here
    order = Window.orderBy(F.xxhash64("_key"), "_key", "_label", F.xxhash64("_features"))
    upto = F.sum(F.size("_features").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    got = learnt.withColumn("_upto", upto).where(F.col("_upto") <= settings.max_features).drop("_upto").toArrow()
    got = got.sort_by([("_key", "ascending"), ("_label", "ascending")]).combine_chunks()
    parts = {c: pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("_sentences", "_features")}
    sentences = np.concatenate([[0], np.cumsum(np.asarray(parts["_sentences"].value_lengths()).astype(np.int64))])
    sizes = parts["_sentences"].flatten().to_numpy().astype(np.int64)
    none = np.zeros(0, np.int64)
    bags = Bags(parts["_features"].flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), sentences, none, none)
    return fit(bags, got.column("_label").to_numpy(), settings)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted, n_sentences and offending: an array of start, end (code points, end exclusive) and score of the
    sentences whose own score reaches the threshold. The weights go out as a broadcast value of 2**bits numbers."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "_text", SLICE):
            column = batch.column("_text")
            bags = bags_of(column, m.settings)
            p = m.sentence_scores(bags)
            got = noisy_or(p, bags.sentences)
            bad = np.flatnonzero(p >= m.settings.threshold)
            starts, ends = _code_points(column, bags, bad)
            spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), pa.array(p[bad])], names=["start", "end", "score"])
            offending = pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, bags.sentences).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(got), pa.array((got >= m.settings.threshold).astype(np.int32)), pa.array(np.diff(bags.sentences)), offending],
                names=[key, "score", "predicted", "n_sentences", "offending"],
            )

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, score double, predicted int, n_sentences long, offending array<struct<start: long, end: long, score: double>>")


def _code_points(column: pa.Array, bags: Bags, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sentences within their texts."""
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = terms_of(column)
    points = np.concatenate([[0], np.cumsum((terms.data & 0xC0) != 0x80)])
    doc = np.searchsorted(bags.sentences, which, "right") - 1
    first = points[terms.offsets[doc]]
    return points[bags.start[which]] - first, points[bags.end[which]] - first
