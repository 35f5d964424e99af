"""A corpus pipeline: what the quality classifier rejects goes, recurring lines go, one document of each group of near
copies stays, documents that hold benchmark items go, and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the caller writes and rereads Parquet; run() does so in the shared folder.

Defined results: rows with a null text are judged as empty texts and keep their null; an empty table passes through; of
rows with one id and equal shingles one stays. Extra columns pass through until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import bpe, classifier, decontaminate, line_templates, ngram_join
from tidewheel.llm.io import shared_dir
from tidewheel.llm.queries import quality_model, table, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier does not reject; it learns from the labels that op10 learns from."""
    return classifier.filter_quality(docs, quality_model(spark, docs, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates; the first line of each stays, and so do all documents. Long lines recur from
    as many documents on as others do: what stands in a few near copies is left for the next stage, which drops copies whole."""
    return line_templates.drop_recurring_lines(docs, line_templates.Tree(long_docs=10))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of the n-gram Jaccard join."""
    return ngram_join.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), decontaminate.Seeds(any_stretch=True))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids, with digests of the ids and of what they decode to."""
    path, pattern = tokenizer_file()
    return bpe.with_codes(docs, bpe.DIGEST_FIELDS + ", token_ids array<int>", bpe.digests_and_ids, path, pattern, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: The classifier and the templates are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and reread for the next."""
    top = shared_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{n}-{name}")
            docs = spark.read.parquet(f"{top}/{n}-{name}")
    return docs
