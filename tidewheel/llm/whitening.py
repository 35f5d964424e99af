"""Whitening of embeddings by the principal components of their covariance (operator 12).

Each entry c of a vector becomes the whole number x = floor(64 * c) + 1000000. The fit list is each distinct x vector once.
Its covariance is one Spark SQL aggregation: an expression for each pair of dimensions of the upper triangle, summing the
products of centred columns. LAPACK decomposes it on the driver, where it takes the square of the number of dimensions,
whatever the number of vectors. A vector's whitened components are its centred x on the unit eigenvectors, over the square
roots of the eigenvalues. The covariance of these over the fit list, by the same aggregation, is compared to the identity.

Defined results: a vector that is null or holds a null, an infinite entry or one that is no number gives no rows, nor does a
vector with an entry beyond 2**55, whose x would not be a whole number of 64 bits. Vectors have the length that most have, the
longer one of two as frequent; others give no rows. Repeated vectors count once in the fit and each gives its rows; null and
repeated ids stay as they are. Components whose eigenvalue is 0, or no more than a rounding error beside the largest, have
no whitened value (null) and play no part in the identity error. The deviation is exact; where it takes over 64 bits it is
null. Eigenvectors have their largest entry positive. An empty table, or one without usable vectors, gives no rows. Columns
besides id and vector play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import shared_dir, small_batches

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no x of 64 bits that sums can be taken of.
LARGEST = 2.0**55
#: Pairs of dimensions summed at once; more dimensions take more passes over the fit list.
PAIRS = 2080
#: Share of the largest eigenvalue below which one counts as 0.
NOTHING = 1e-12


@dataclass
class Whitening:
    """n fitted vectors, their sums by dimension, unit eigenvectors (a column each) and eigenvalues by falling size, and the
    largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of x; NaN for those without variance."""
        full = self.values > NOTHING * max(self.values[0], 0.0)
        size = np.sqrt(np.where(full, self.values, np.nan))
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole).astype(np.float64) - rest) @ self.vectors / size

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n * x - sum) ** 2."""
        top = max(1, int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        if 2 * top < 2**62:
            off = x * self.n - np.array(self.sums, np.int64)
            most = int(np.abs(off).max(initial=0))
            if most * most * x.shape[1] < 2**63:
                return (off * off).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def whole_numbers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x of the usable vectors."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    usable = F.forall("vector", lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))
    return rows.where(F.col("vector").isNotNull() & usable).select("key", F.transform("vector", lambda c: F.floor(SCALE * c.cast("double")) + SHIFT).alias("x"))


def covariance(columns: DataFrame, n: int) -> np.ndarray:
    """Of columns that are centred already, the mean products of each pair: the upper triangle in one aggregation."""
    names = columns.columns
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    out = np.zeros((len(names), len(names)))
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        sums = columns.selectExpr("array(" + ", ".join(f"sum({names[i]} * {names[j]})" for i, j in part) + ") AS sums").first().sums
        for (i, j), v in zip(part, sums, strict=True):
            out[i, j] = out[j, i] = v / n
    return out


def fit(x: DataFrame) -> Whitening | None:
    """x: the fit list, with each vector once; None without vectors. A few numbers for each pair of dimensions come to the
    driver."""
    most = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), most.alias("most"))
    top = sizes.where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    d, n = top.d, top.n
    rows = x.where(F.size("x") == d)
    kind = "bigint" if n * top.most < 2**62 else "decimal(38,0)"
    sums = [int(s) for s in rows.agg(*[F.expr(f"sum(CAST(x[{i}] AS {kind}))").alias(f"s{i}") for i in range(d)]).first()]
    centred = [F.expr(f"CAST(x[{i}] - {s // n}L AS double) - {s % n / n!r}D").alias(f"c{i}") for i, s in enumerate(sums)]
    matrix = covariance(rows.select(*centred), n)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values, float(np.trace(matrix)))


def matrix_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def identity_error(x: DataFrame, model: Whitening, components: int) -> float | None:
    """How far the covariance of the fit list's whitened components is from the identity at most."""
    d = len(model.sums)
    full = np.flatnonzero(model.values[:components] > NOTHING * max(model.values[0], 0.0))
    if not len(full):
        return None
    names = [f"w{k}" for k in full]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.project(matrix_of(batch, d))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in full], names=names)

    rows = x.where(F.size("x") == d).mapInArrow(run, ", ".join(f"{c} double" for c in names))
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    centred = rows.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(names, means, strict=True)])
    return float(np.abs(covariance(centred, model.n) - np.eye(len(full))).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    spark = df.sparkSession
    small_batches(spark)
    rows, path = whole_numbers(df, key, vector), shared_dir(spark, "whitening")
    rows.select("x").distinct().write.parquet(path)
    fitted = spark.read.schema("x array<bigint>").parquet(path)
    model = fit(fitted)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    d = len(model.sums)
    components = min(components, d)
    model.identity_error = identity_error(fitted, model, components)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = matrix_of(batch, d)
            r = len(x)
            w = m.project(x)[:, :components].ravel()
            share = m.values[:components] / m.trace if m.trace > 0 else np.full(components, np.nan)
            each = np.repeat(np.arange(r), components)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), r)),
                    pa.array(np.full(r * components, m.n)),
                    pa.array(m.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(share, r), mask=np.tile(np.isnan(share), r)),
                    pa.array([m.identity_error] * (r * components), pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == d).mapInArrow(run, schema)
