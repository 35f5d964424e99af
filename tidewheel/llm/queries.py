"""The queries opN_<name>: each applies its operator to the whole of its table and derives the digests asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, decontaminate, divergence, line_templates, ngram_join, pii, quality_rules, substrings, toxicity, warc, whitening
from .io import shared_dir
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> tuple[str, str]:
    """Path of the rank file and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_warc(warc.with_originals(table(spark, sf_dir, "pages")), path)
    read = warc.read_warc(spark, path).where("warc_type <> 'warcinfo'")
    header = F.col("headers")
    stored = F.regexp_replace(header["WARC-Payload-Digest"], "^sha1:", "")
    response = F.col("warc_type") == "response"
    return read.select(
        F.expr("try_cast(headers['X-Page-ID'] AS BIGINT)").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(header["X-Payload-Length"].cast("long")).alias("payload_bytes"),
        F.when(response, warc.base32_sha1(F.col("payload"))).otherwise(stored).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        header["X-Refers-To-Page"].cast("long").alias("refers_to"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_file()
    return bpe.with_codes(table(spark, sf_dir, "documents"), bpe.DIGEST_FIELDS, bpe.digests, path, pattern, keep=["doc_id"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), decontaminate.Seeds(any_stretch=True))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("node", "label")


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_templates.drop_recurring_lines(docs, counts=True)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> classifier.Model:
    return classifier.train(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = classifier.score(docs, quality_model(spark, docs, sf_dir))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    rendered = chat.render(chat.rows_as_events(turns), dealt=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, n, turn_hash, loss_chars, loss_hash, chars = None, False, 0, None, 0, None, 0
        rows: list[tuple] = []
        for batch in batches:
            for c, part, formatted, start, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "formatted", "start", "loss_start", "loss_end")), strict=True):
                if part == 0:
                    if held:
                        rows.append((conv, n, turn_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
                    conv, held, n, turn_hash, loss_chars, loss_hash, chars = c, True, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text in chat.read_turns(formatted):
                    n += 1
                    turn_hash.update(f"{role}\n{text}\n".encode())
                if a is not None:
                    text = chat.unescape(formatted[a - start : b - start])
                    loss_chars += len(text)
                    loss_hash.update(text.encode())
                chars += len(formatted)
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)
                rows = []
        if held:
            rows.append((conv, n, turn_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in fields.split(", ")]
    return rendered.mapInArrow(run, fields)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_line_templates": op7_line_templates,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_format": op9_chat_format,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_toxicity": op13_toxicity,
}
