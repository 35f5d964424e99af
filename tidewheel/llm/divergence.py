"""How far sources of one language differ in their terms (operator 11).

A language keeps the terms that stand in at least min_docs of its documents. A source of a language is a vector of counts,
one for each kept term; each count becomes a share p of the source's kept occurrences, in billionths, after five are added
to the count of each term (see share()). Two sources differ by the sum of |p - q| over all kept terms.

Terms with the same counts in every source have the same shares. So terms are grouped by their sparse vector of (source,
count), every pair of sources is evaluated once for a vector, and the result counts as often as the vector has terms.
Vectors are dealt in runs, each led by the parameters of its language's sources, which makes a task hold those parameters, a
slice of its vectors, and sums of BLOCK sources against all: nothing is broadcast by hand or collected. Terms are then
ranked one by one within their source.

What must fit one row: a term's counts, an entry for each source of its language. The result has a row for each ordered
pair of sources, which is the square of that number.

Defined results: a null text, language or source is an empty one. Each row counts as a document, repeated rows and ids
included. A group without a kept term has pairs; of a language with no kept term all pairs have value 0. Ties go by item, in
the order of UTF-8 bytes. A text of any length is taken whole. Columns besides text, lang and source play no part, whatever
their names. An empty table gives no rows. Arithmetic is exact while a source has fewer than 9 * 10**15 occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import shared_dir, small_batches
from .terms import terms_of
from .words import slices

#: Sources whose sums a task holds at once, and vectors of a run at least.
BLOCK, RUN = 512, 4096
#: Entries of a dense matrix of counts.
CELLS = 1 << 18
SMOOTH = 5
COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, term string, vector array<struct<source: string, n: long>>"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, summed for a slice of texts; each group also has a row
    of the empty term, which no text has."""
    for batch in slices(batches):
        lang, source = (batch.column(c).fill_null("").dictionary_encode() for c in ("lang", "source"))
        pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, group = np.unique(pair, return_inverse=True)
        terms = terms_of(batch.column("text"))
        coded = terms.strings().dictionary_encode()
        k = len(coded.dictionary) + 1
        of_doc, n = np.unique(terms.doc() * k + coded.indices.to_numpy(), return_counts=True)
        of_group, row = np.unique(group[of_doc // k] * k + of_doc % k, return_inverse=True)
        occurrences = np.zeros(len(of_group), np.int64)
        np.add.at(occurrences, row, n)
        code = np.concatenate([of_group % k, np.full(len(groups), k - 1)])
        g = np.concatenate([groups[of_group // k], groups])
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(g // len(source.dictionary))).cast(pa.string()),
                source.dictionary.take(pa.array(g % len(source.dictionary))).cast(pa.string()),
                pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())]).take(pa.array(code)).cast(pa.string()),
                pa.array(np.concatenate([occurrences, np.zeros(len(groups), np.int64)])),
                pa.array(np.concatenate([np.bincount(row, minlength=len(of_group)), np.bincount(group)])),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), three digits at a time so that nothing overflows."""
    whole, rest = f"({total} + {SMOOTH} * {kept})", f"({count} + {SMOOTH})"
    out = f"({rest} div {whole})"
    for _ in range(3):
        rest = f"(({rest} % {whole}) * 1000L)"
        out = f"({out} * 1000L + {rest} div {whole})"
    return F.expr(f"1L + {out}")


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """As share(), of a matrix of counts, a column for each source."""
    whole = totals + SMOOTH * kept
    out, rest = np.divmod(counts + SMOOTH, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


class _Run:
    """A run of vectors of one language and the sums of one block of its sources."""

    def __init__(self, key: tuple[str, int, int], kept: int, block: int):
        self.key, self.kept, self.block = key, kept, block
        self.names: list[str] = []
        self.totals: list[int] = []
        self.sums: np.ndarray | None = None

    def sources(self) -> range:
        return range(self.key[1] * self.block, min(len(self.names), (self.key[1] + 1) * self.block))

    def add(self, ends: np.ndarray, names: pa.Array, counts: np.ndarray, times: np.ndarray) -> None:
        size = len(self.names)
        if self.sums is None:
            self.sums = np.zeros((len(self.sources()), size), np.int64)
            self.known, self.whole = pa.array(self.names), np.array(self.totals)
        place = pc.index_in(names, value_set=self.known).to_numpy(zero_copy_only=False)
        step = max(1, CELLS // size)
        for a in range(0, len(times), step):
            part = ends[a : a + step + 1]
            dense = np.zeros((len(part) - 1, size), np.int64)
            inner = slice(part[0], part[-1])
            dense[np.repeat(np.arange(len(part) - 1), np.diff(part)), place[inner]] = counts[inner]
            p, m = shares(dense, self.whole, self.kept), times[a : a + step, None]
            for row, s in enumerate(self.sources()):
                self.sums[row] += (np.abs(p - p[:, s : s + 1]) * m).sum(0)

    def rows(self) -> pa.RecordBatch | None:
        """All pairs of the block with the other sources; the first run of a block has them even if it has no vector."""
        if self.sums is None and self.key[2]:
            return None
        mine, size = self.sources(), len(self.names)
        sums = self.sums if self.sums is not None else np.zeros((len(mine), size), np.int64)
        source, other = np.repeat(np.array(mine, np.int64), size), np.tile(np.arange(size), len(mine))
        rest, names = source != other, pa.array(self.names, pa.string())
        columns = [pa.array([self.key[0]] * int(rest.sum()), pa.string()), names.take(pa.array(source[rest])), names.take(pa.array(other[rest])), pa.array(sums.ravel()[rest])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def compared(block_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums by pair of each run; a run's parameters (kind 0) come before its vectors."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column("lang").to_pylist()
            block, salt, kind, times = (batch.column(c).to_numpy() for c in ("block", "salt", "kind", "times"))
            lists = {c: batch.column(c) for c in ("names", "counts")}
            ends = np.asarray(lists["names"].offsets).astype(np.int64)
            names, counts = lists["names"].flatten(), lists["counts"].flatten().to_numpy()
            ends = ends - ends[0]
            codes = batch.column("lang").dictionary_encode().indices.to_numpy()
            change = np.any([np.diff(x) != 0 for x in (codes, block, salt, kind)], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = (lang[a], int(block[a]), int(salt[a]))
                if run is None or run.key != key:
                    if run is not None and (out := run.rows()) is not None:
                        yield out
                    run = _Run(key, int(times[a]), block_size)
                if kind[a] == 0:
                    run.names += names.slice(ends[a], ends[b] - ends[a]).to_pylist()
                    run.totals += counts[ends[a] : ends[b]].tolist()
                else:
                    part = slice(ends[a], ends[b])
                    run.add(ends[a : b + 1] - ends[a], names.slice(ends[a], ends[b] - ends[a]), counts[part], times[a:b])
        if run is not None and (out := run.rows()) is not None:
            yield out

    return go


def kept_terms(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """lang, term, vector of each kept term, and of the empty term with all groups of the language. Written to the shared
    folder, as all that follows reads it."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    sums = rows.mapInArrow(counted, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    path = shared_dir(spark, "divergence-terms")
    vectors.where((F.col("docs") >= min_docs) | (F.col("term") == "")).select("lang", "term", "vector").write.parquet(path)
    return spark.read.schema(KEPT).parquet(path)


def parameters(kept: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, source, n of each group, with its language's kept terms, distinct vectors, sources and occurrences. Written, so
    that joins know its size."""
    spark = kept.sparkSession
    groups = kept.where("term = ''").selectExpr("lang", "explode(vector.source) AS source")
    counts = vectors.select("lang", "times", F.inline("vector")).groupBy("lang", "source").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    sizes = vectors.groupBy("lang").agg(F.sum("times").alias("kept"), F.count("*").alias("vectors"))
    groups = groups.join(counts, ["lang", "source"], "left").na.fill(0, ["n"])
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("lang_n")).join(sizes, "lang", "left").na.fill(0, ["kept", "vectors"])
    path = shared_dir(spark, "divergence-groups")
    groups.join(langs, "lang").write.parquet(path)
    return spark.read.schema("lang string, source string, n long, sources long, lang_n long, kept long, vectors long").parquet(path)


def pair_sums(vectors: DataFrame, groups: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    runs = F.greatest(F.lit(1), F.ceil(F.col("vectors") / F.greatest(F.lit(run), F.col("sources"))).cast("int"))
    groups = groups.withColumns({"runs": runs, "blocks": F.ceil(F.col("sources") / block).cast("int")})
    langs = groups.groupBy("lang").agg(F.first("runs").alias("runs"), F.first("blocks").alias("blocks"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    lead = groups.select("lang", F.explode(upto("blocks")).alias("block"), "runs", "source", "n", "kept")
    lead = lead.select("lang", "block", F.explode(upto("runs")).alias("salt"), F.lit(0).alias("kind"), F.col("kept").alias("times"), F.array("source").alias("names"), F.array("n").alias("counts"))
    rows = vectors.join(langs, "lang").withColumn("salt", F.pmod(F.xxhash64("vector"), F.col("runs")).cast("int"))
    rows = rows.select("lang", F.explode(upto("blocks")).alias("block"), "salt", F.lit(1).alias("kind"), "times", F.col("vector.source").alias("names"), F.col("vector.n").alias("counts"))
    dealt = lead.unionByName(rows).repartition("lang", "block", "salt").sortWithinPartitions("lang", "block", "salt", "kind", "names")
    sums = dealt.mapInArrow(compared(block), "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_excess(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each kept term that a source has, if it has more of it than its language."""
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda upto, x: upto + x["n"])
    entries = kept.where("term <> ''").select("lang", F.col("term").alias("item"), total.alias("total"), F.inline("vector"))
    own = groups.select("lang", "source", F.col("n").alias("whole"), "lang_n", "kept")
    rows = entries.join(own, ["lang", "source"]).withColumn("value", share("n", "whole", "kept") - share("total", "lang_n", "kept"))
    return rows.where("value > 0").select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all other sources by their distance, and the most_terms terms
    that the source has most in excess of its language."""
    kept = kept_terms(docs, min_docs)
    path = shared_dir(docs.sparkSession, "divergence-vectors")
    kept.where("term <> ''").groupBy("lang", "vector").agg(F.count("*").alias("times")).write.parquet(path)
    vectors = docs.sparkSession.read.schema("lang string, vector array<struct<source: string, n: long>>, times long").parquet(path)
    groups = parameters(kept, vectors)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_sums(vectors, groups).withColumn("rank", rank)
    terms = term_excess(kept, groups).withColumn("rank", rank).where(F.col("rank") <= most_terms)
    fields = ["item", "value", "rank"]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *fields).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), *fields))
