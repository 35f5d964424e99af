"""A quality classifier: linear support vectors over naive Bayes features (operator 10).

A text's features are the byte n-grams that it has, hashed to a fixed number of places, and word n-grams of one word
over and over, of two to five times, without regard to the word; how often it has them does not count. Each feature is scaled by the log of the ratio of its smoothed counts in the two classes, rows are scaled to unit
length, and a linear model of squared hinge loss is fitted by dual coordinate descent; its weights are drawn towards their mean
size. A logistic curve over margins of rows left out of the fit turns margins into scores.

The fit takes max_train labelled rows at most, those first by a hash of their id, and of these the first that have
max_features features together; features of these rows, as integers of four bytes, come to the driver. Scoring covers every
row and reads the text only. Settings are chosen by cross_validated over rows that may be learnt from.

Defined results: a null or empty text has no features and gets the score of margin 0 shifted by the bias. Labelled rows
whose label is null are not learnt from. With no row of one class left the score is 0.5 for all, or the class's 1.0 or
0.0. Repeated rows are scored each for itself; rows repeated in labels count as often in the fit. Rows of one id with
different texts are all learnt from. Ties in the order of labelled rows go by id, then label. A text of any length is taken
whole. Columns besides id, text and label play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import give_back, shared_dir, small_batches
from .words import U64, column_bytes, slices, words_of

#: Text of so many bytes is turned into features at once.
SLICE = 1 << 19


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    sizes: tuple[int, ...] = (1, 2, 3)
    repeats: int = 4
    alpha: float = 1.0
    cost: float = 5.0
    rounds: int = 20
    blend: float = 0.8
    max_train: int = 10_000
    max_features: int = 1 << 26
    calibration_share: float = 0.2
    threshold: float = 0.3


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -700, 700)))


def features(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the texts, each once for a text, and bounds by text."""
    offsets, data = column_bytes(column)
    n = len(offsets) - 1
    found = []
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    value = np.zeros(len(data), U64)
    for size in range(1, max(settings.sizes) + 1):
        m = len(data) - size + 1
        if m <= 0:
            break
        value = value[:m] * U64(256) + data[size - 1 :]
        if size in settings.sizes:
            whole = left[:m] >= size
            place = (((value[whole] + U64(size)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - settings.bits)).astype(np.int64)
            found.append((doc[:m][whole] << settings.bits) | place)
    words = words_of(column)
    hashes, row = words.hashes(), words.doc()
    run = np.ones(max(len(hashes) - 1, 0), bool)
    for length in range(2, 2 + settings.repeats):
        # n-grams of one word over and over count whatever the word is
        m = len(hashes) - length + 1
        if m <= 0:
            break
        run = run[:m] & (hashes[length - 2 : length - 2 + m] == hashes[length - 1 :]) & (row[:m] == row[length - 1 :])
        found.append((row[:m][run] << settings.bits) | ((1 << settings.bits) - length))
    if not found:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    both = np.sort(np.concatenate(found))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    bounds = np.searchsorted(both, np.arange(n + 1, dtype=np.int64) << settings.bits)
    return both & ((1 << settings.bits) - 1), bounds


def margins(column: pa.Array, model: Model) -> np.ndarray:
    place, bounds = features(column, model.settings)
    scale, weight = model.weights
    n = np.diff(bounds)
    sums = np.concatenate([[0.0], np.cumsum(weight[place])])
    squares = np.concatenate([[0.0], np.cumsum(scale[place])])
    size = np.sqrt(np.maximum(squares[bounds[1:]] - squares[bounds[:-1]], 1e-12))
    return np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) / size, 0.0) + model.bias


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, cost: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model of least squared hinge loss, by dual coordinate descent; the bias is the
    weight of a feature that each row has with value 1."""
    weights, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(y))
    diagonal = 0.5 / cost
    norm = np.array([v @ v for v in values]) + 1.0 + diagonal
    order = np.random.default_rng(17)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (weights[rows[i]] @ values[i] + bias) - 1 + diagonal[i] * alpha[i]
            step = max(alpha[i] - gradient / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                weights[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return weights, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """rows: feature numbers of each text; labels: 0 or 1."""
    dims = 1 << settings.bits
    plain = (np.zeros(dims), np.zeros(dims))
    if len(set(labels.tolist())) < 2:
        sure = 0.0 if not len(labels) else 700.0 if labels[0] else -700.0
        return Model(settings, plain, 0.0, 0.0, sure)
    y = np.where(labels > 0, 1.0, -1.0)

    def one(train: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], float]:
        count = {s: np.full(dims, settings.alpha) for s in (1.0, -1.0)}
        for i in train:
            count[y[i]][rows[i]] += 1
        ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
        values = [ratio[rows[i]] / max(np.sqrt((ratio[rows[i]] ** 2).sum()), 1e-6) for i in train]
        share = np.array([(y[train] == s).mean() for s in y[train]])
        weights, bias = descend([rows[i] for i in train], values, y[train], dims, settings.cost * 0.5 / share, settings.rounds)
        weights = (1 - settings.blend) * np.abs(weights).mean() * np.sign(weights) + settings.blend * weights if settings.blend < 1 else weights
        return (ratio**2, weights * ratio), bias

    aside = np.arange(len(y)) % max(2, round(1 / settings.calibration_share)) == 0
    if len(set(y[~aside])) == 2 and len(set(y[aside])) == 2:
        weights, bias = one(np.flatnonzero(~aside))
        trial = Model(settings, weights, bias, 1.0, 0.0)
        slope, shift = calibrate(np.array([margin_of(rows[i], trial) for i in np.flatnonzero(aside)]), y[aside] > 0)
    else:
        slope, shift = 2.0, 0.0
    weights, bias = one(np.arange(len(y)))
    return Model(settings, weights, bias, slope, shift)


def cross_validated(rows: list[np.ndarray], labels: np.ndarray, settings: Settings, folds: int = 5) -> tuple[float, float]:
    """Mean log loss, and share of right decisions, over rows that were left out of the fit in turn."""
    loss, right = [], []
    for k in range(folds):
        out = np.arange(len(rows)) % folds == k
        model = fit([rows[i] for i in np.flatnonzero(~out)], labels[~out], settings)
        got = np.clip(model.score(np.array([margin_of(rows[i], model) for i in np.flatnonzero(out)])), 1e-9, 1 - 1e-9)
        loss.append(-np.log(np.where(labels[out] > 0, got, 1 - got)).mean())
        right.append(((got >= settings.threshold) == (labels[out] > 0)).mean())
    return float(np.mean(loss)), float(np.mean(right))


def margin_of(row: np.ndarray, model: Model) -> float:
    scale, weight = model.weights
    return (weight[row].sum() / np.sqrt(max(scale[row].sum(), 1e-12)) if len(row) else 0.0) + model.bias


def calibrate(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least loss, by Newton steps, with targets drawn in from 0 and 1."""
    p, n = positive.sum(), (~positive).sum()
    target = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        got = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        curve = np.maximum(got * (1 - got), 1e-9)
        g = np.array([((got - target) * margin).sum() + 1e-3 * slope, (got - target).sum()])
        h = np.array([[(curve * margin**2).sum() + 1e-3, (curve * margin).sum()], [(curve * margin).sum(), curve.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(slope, 1e-3)), float(shift)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Fits the model on labelled rows; the caller leaves out what is not to be learnt from."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key", "_label").limit(settings.max_train)
    joined = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            place, bounds = features(batch.column("_text"), settings)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_key").cast(pa.int64()), batch.column("_label"), lists], names=["_key", "_label", "_features"])

    path = shared_dir(docs.sparkSession, "classifier")
    joined.mapInArrow(run, "_key long, _label int, _features array<int>").write.parquet(path)
    learnt = docs.sparkSession.read.schema("_key long, _label int, _features array<int>").parquet(path)
    # at most max_train rows, or as many as labelled ids are repeated in docs, are counted here
    order = Window.orderBy(F.xxhash64("_key"), "_key", "_label", F.xxhash64("_features"))
    upto = F.sum(F.size("_features").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    got = learnt.withColumn("_upto", upto).where(F.col("_upto") <= settings.max_features).drop("_upto").toArrow()
    order = np.lexsort((got.column("_label").to_numpy(), got.column("_key").to_numpy()))
    lists = got.column("_features").combine_chunks()
    flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
    rows = [flat[ends[i] : ends[i + 1]] for i in order]
    shuffle = np.random.default_rng(5).permutation(len(rows))
    model = fit([rows[i] for i in shuffle], got.column("_label").to_numpy()[order][shuffle], settings)
    # the features lie in the driver, whose memory the next stages need
    del got, lists, flat, rows
    give_back()
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted of each row. The weights go out as a broadcast value of 2**bits numbers, whatever the data."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text, SLICE):
            got = m.score(margins(batch.column(text), m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(pa.int64()), pa.array(got), pa.array((got >= m.settings.threshold).astype(np.int32))], names=[key, "score", "predicted"]
            )

    return df.select(key, text).mapInArrow(run, f"{key} long, score double, predicted int")


def filter_quality(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df's rows that the model does not reject, with df's columns."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text, SLICE):
            yield batch.filter(pa.array(m.score(margins(batch.column(text), m)) >= m.settings.threshold))
        give_back()

    return df.mapInArrow(run, df.schema)
