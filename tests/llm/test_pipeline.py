"""The pipeline's stages, each against a plain version over its own input."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidewheel.llm import classifier  # noqa: E402
from tidewheel.llm.io import shared_dir  # noqa: E402
from tidewheel.llm.queries import quality_model  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, name)
        stage(spark, kept[-1], SMALL).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert [df.columns for df in kept[:-1]] == [COLUMNS] * 5

    scores = classifier.score(docs, quality_model(spark, docs, SMALL))
    assert {d for d, _ in pairs(kept[1])} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    assert pairs(kept[2]) == sorted(brute.drop_lines(pairs(kept[1]), long_docs=10), key=str)
    components = {c for _, n, c in brute.jaccard(pairs(kept[2]))}
    assert {d for d, _ in pairs(kept[3])} == components
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d for d, t in pairs(kept[3]) for _, b in items if " ".join(brute.words(brute.lower(b))) in " ".join(brute.words(brute.lower(t)))}
    assert {d for d, _ in pairs(kept[4])} == {d for d, _ in pairs(kept[3])} - held
    final = {r.doc_id: r for r in kept[5].collect()}
    for d, t in pairs(kept[4]):
        assert final[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and final[d].n_tokens == len(final[d].token_ids)
    assert sorted(final) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect())


@pytest.mark.parametrize("rows", [[], [(None, None, "en", "s", None), (1, "", None, "s", 0), (1, "twice", "en", "s", 5), (1, "twice", "en", "s", 5)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit(1)).withColumn("score", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert name == "byte_bpe" or out.columns == docs.columns
        assert out.count() <= len(rows)


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_works_without_the_subpackage(tmp_path, gone):
    import shutil
    import subprocess

    root = Path(__file__).resolve().parents[2]
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'window_all_topn' in q and 'pipeline' not in q and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"})
