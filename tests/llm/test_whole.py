"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import classifier, decontaminate, line_templates, ngram_join, packed, pii, quality_rules, queries, substrings

# 5


def most_agreeing(same):
    """Over all intervals in which four in five or more agree."""
    n = len(same)
    return max((sum(same[i:j]) for i in range(n) for j in range(i + 1, n + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)), default=0)


def test_widest_stretch_against_all_intervals():
    rng = random.Random(21)
    for _ in range(2000):
        share = rng.choice([0.5, 0.8, 0.9])
        same = [rng.random() < share for _ in range(rng.randint(1, 24))]
        a, b, n = decontaminate.widest_stretch(np.array(same))
        assert n == most_agreeing(same) == sum(same[a:b]) and 5 * n >= 4 * (b - a)


def test_items_with_one_changed_word_are_found(spark, tmp_path):
    items = [(n, [f"w{n}x{k}" for k in range(n)]) for n in range(14, 19)]
    docs = [(100 * n + at, " ".join(["before", *w[:at], "other", *w[at + 1 :], "after"])) for n, w in items for at in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seeds = decontaminate.Seeds()
    block = decontaminate.block_of(pa.table({"item_id": [n for n, _ in items], "text": [" ".join(w) for _, w in items]}), seeds)
    hit = {d for d, t in docs for w in [decontaminate.words_of(pa.array([t]), lower=True).hashes()] if any(np.isin(decontaminate.masked(w, m, s), block.seeds).any() for m, s in block.masks)}
    found = {r.doc_id: r for r in queries.op5_decontaminate(spark, str(tmp_path)).collect()}
    assert set(found) == hit and {1503, 1504, 1510, 1511, 1603, 1612, 1704, 1712} <= hit
    assert all(r.n_matched >= min(13, -(-4 * r.item_id // 5)) and 5 * r.n_matched >= 4 * r.n_words for r in found.values())


# 6


def test_bit_table_takes_multiples_of_its_size(spark):
    size = packed.TABLE_BITS
    values = [size, -size, 3 * size + 1, size - 1, 5 * size + 32768, 32767]
    bits = packed.bit_table(spark.createDataFrame([(v,) for v in values], "node long"), "node")
    places = sorted({v % size for v in values})
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == places
    assert packed.in_table(bits, np.array([0, 1, 2, size - 1, size - 2, 32767, 32768, 32769])).tolist() == [True, True, False, True, False, True, True, False]


# 7


def test_lines_of_rows_that_share_an_id(spark):
    menu = "All rights are reserved by us"
    docs = [(i, f"{menu}\nown line {'abcdefghijkl'[i]} here") for i in range(12)]
    shared = [(None, f"clean {w} alone\n{menu}\nlast {w} word") for w in ("red", "green", "blue")] + [(None, f"{menu}\nclean again"), (None, "one\ntwo words\nthree words here"), (5, "another clean text\nof two lines")]
    cut = line_templates.drop_recurring_lines(spark.createDataFrame(docs + shared, "doc_id long, text string"), counts=True).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in cut)
    kept = [t for *_, t in got]
    assert sum(t.count(menu) for t in kept) == 1 and any(menu in t for none, _, t in got if not none)
    assert sorted("\n".join(x for x in t.split("\n") if x != menu) for t in kept) == sorted("\n".join(x for x in t.split("\n") if x != menu) for _, t in docs + shared)
    assert sum(r.n_dropped for r in cut) == 15


def test_pipeline_drops_recurring_lines_of_one_word(spark):
    letters = "abcdefghijkl"
    docs = [(i, f"Menu\nown line {c} here\n2024\n{100 + i}\n{c * 3}") for i, c in enumerate(letters)] + [(50, "rare\n\n7"), (51, "rare\n\n8")]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert got == {i: t if i in (0, 50, 51) else t.replace("Menu\n", "").replace("2024\n", "") for i, t in docs}


def held_items(texts, items, seeds=decontaminate.Seeds(any_stretch=True)):
    """Rows, items and what overlaps says of them, without Spark."""
    block = decontaminate.block_of(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), seeds)
    return list(decontaminate.overlaps(pa.array(texts, pa.string()), block, seeds))


def test_repeated_words_cost_no_more_room():
    import resource
    import time

    start, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert held_items(["same " * 1_000_000], ["same " * 100]) == [(0, 0, 0, 0, 100, 100)]
    assert held_items(["same " * 300_000], ["same " * 60 + "other " + "same " * 39]) == [(0, 0, 0, 0, 100, 99)]
    got = held_items(["one two " * 100_000 + "three"], ["two one " * 30])
    assert got == [(0, 0, 1, 0, 60, 60)]
    assert time.time() - start < 60 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 500_000  # in kB


def test_lines_against_all_places():
    rng = random.Random(23)
    for _ in range(150):
        items = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(3)]
        texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        seeds = decontaminate.Seeds(any_stretch=True)
        got = {(r, i): n for r, i, *_, n in held_items(texts, items, seeds)}
        want = {}
        for r, t in enumerate(texts):
            for i, x in enumerate(items):
                w, b = t.split(), x.split()
                masks = list(seeds.masks) if len(b) >= 10 else ["1" * len(b)] if len(b) >= 8 else []
                for shift in range(-len(b), len(w)):
                    same = [0 <= k + shift < len(w) and b[k] == w[k + shift] for k in range(len(b))]
                    if not any(all(same[s + o] for o, c in enumerate(m) if c == "1") and all(0 <= s + o + shift < len(w) for o in range(len(m))) for m in masks for s in range(len(b) - len(m) + 1)):
                        continue
                    best = plain_best(same)
                    enough = min(13, -(-4 * len(b) // 5))
                    n = best if best >= enough else most_agreeing(same)
                    if n >= enough:
                        want[r, i] = max(want.get((r, i), 0), n)
        assert got == want


def plain_best(same):
    """Agreeing words of the best-scoring stretch; of equal ones the first end, then the shortest."""
    best, out = 0, 0
    for j in range(len(same) + 1):
        for i in range(j, -1, -1):
            score = sum(1 if x else -4 for x in same[i:j])
            if score > best:
                best, out = score, sum(same[i:j])
    return out


# all of documents


def test_texts_longer_than_a_slice(spark):
    """Texts of 5 MB: words in a cycle of 100,003, twice as copies and once again."""
    words = [f"w{i * 7919 % 100_003}" for i in range(700_000)]
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long), (2, long), (3, "a short text"), (4, long)], "doc_id long, text string").repartition(2)
    rows = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    assert rows(substrings.repeated_passages(docs), "doc_id", "n_words", "n_removed") == [(1, 700_000, 599_997), (2, 700_000, 700_000), (3, 3, 0), (4, 700_000, 700_000)]
    assert rows(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == [(1, 100_003, 1), (2, 100_003, 1), (3, 1, 3), (4, 100_003, 1)]
    assert rows(line_templates.drop_recurring_lines(docs, counts=True), "doc_id", "n_dropped") == [(1, 0), (2, 1), (3, 0), (4, 1)]
    items = spark.createDataFrame([(9, " ".join(words[500_000:500_030]))], "item_id long, text string")
    assert rows(decontaminate.contaminated(docs, items), "doc_id", "item_id", "n_matched") == [(1, 9, 30), (2, 9, 30), (4, 9, 30)]
    assert rows(quality_rules.quality_rules(docs), "doc_id", "n_words") == [(1, 700_000), (2, 700_000), (3, 3), (4, 700_000)]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in classifier.score(docs, classifier.train(docs, labels)).collect()}
    assert scores[1] == scores[2] == scores[4] > scores[3]
    texts = spark.createDataFrame([(1, "x " * 2_500_000 + "a@b.cc end")], "doc_id long, text string")
    found = pii.personal_data(texts).select(pii.span_text(F.col("spans")).alias("s")).first().s
    assert found == "email:5000000:5000006"


def test_blocks_of_a_large_benchmark_come_one_at_a_time(spark):
    """Twelve items in blocks of one or two: the same pairs, and never two blocks at once in the driver."""
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(12)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items] + [(100, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    seeds = decontaminate.Seeds(block_words=60)
    held = [len(block.ids) for block, _ in decontaminate.blocks(bench, seeds)]
    assert sum(held) == 12 and len(held) >= 4
    found = decontaminate.contaminated(docs, bench, seeds)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(12)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench, seeds).collect()] == [100]


def test_clashing_names(spark):
    """Columns with the names of helper columns pass through."""
    helpers = ["node", "_node", "_of", "_stays", "__node", "label", "_bucket", "_is_text", "_docs", "_spots", "docbucket", "_upto"]
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "other words of its own here")], "doc_id long, text string")
    for n, name in enumerate(helpers):
        docs = docs.withColumn(name, F.lit(n))
    bench = spark.createDataFrame([(1, "no such item in any of these texts here")], "item_id long, text string")
    for kept, n in ((ngram_join.drop_near_duplicates(docs), 2), (line_templates.drop_recurring_lines(docs), 3), (decontaminate.drop_contaminated(docs, bench), 3)):
        got = kept.collect()
        assert kept.columns == docs.columns and len(got) == n and all([r[c] for c in helpers] == list(range(len(helpers))) for r in got)


def test_keys_that_fall_together_lower_the_credit():
    """However few bits are left of the keys, a pair of similar sets shares as many as the larger of its credits."""
    u = np.uint64
    assert ngram_join.fallen_together(np.array([5, 5, 7, 5], u), np.array([0, 0, 0, 1]), 2).tolist() == [1, 0]
    rng = np.random.default_rng(3)
    for plan in (ngram_join.Plan(), ngram_join.Plan(thin_cost=200)):
        for n in (4, 5, 8, 12, 40, 100):
            a = np.unique(rng.integers(0, 1 << 62, n)).astype(u)
            b = np.unique(np.concatenate([a[: n - n // 9], rng.integers(0, 1 << 62, n // 9).astype(u)]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 80 * (len(a) + len(b) - both)
            for short in (lambda k: k, lambda k: k & u(63), lambda k: k & u(7)):
                seen = [{}, {}]
                for which, x in enumerate((a, b)):
                    for keys, _, note in ngram_join.keys_of(x, np.array([0, len(x)]), plan, short):
                        for key, m in zip(short(keys).tolist(), note.tolist(), strict=True):
                            band = len(x), m & 3
                            seen[which].setdefault(key, (m >> 2, band))
                if all(seen):
                    shared = seen[0].keys() & seen[1].keys()
                    assert shared
                    if len(a) == len(b):  # then all keys are of the same bands
                        for below in {band[1] for _, band in seen[0].values()}:
                            mine = [{k: c for k, (c, band) in s.items() if band[1] == below} for s in seen]
                            credit = max(c for m in mine for c in m.values())
                            assert len(mine[0].keys() & mine[1].keys()) >= credit or short(u(255)) != u(255)
