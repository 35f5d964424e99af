"""Source divergence, whitening and toxicity against plain versions, and on odd tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidewheel.llm import divergence, queries, toxicity, whitening
from tidewheel.llm.terms import terms_of

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ODD = [None, "", " ", "\n\n", "1 2 3", "one", "É\x85x ñandú", "日本 語", "\U0001f600" * 40, "x " * 30_000, "w" * 50_000]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(lowered(text))


def test_terms_are_what_the_pattern_takes():
    texts = [*ODD, "aB-c_d[E]", "ab", "ab"]
    t = terms_of(pa.array(texts))
    strings = t.strings().to_pylist()
    assert [strings[t.bounds[i] : t.bounds[i + 1]] for i in range(len(texts))] == [terms(x) for x in texts]


# 11


def audit(docs, min_docs=30, most=50):
    """docs: (text, lang, source). Rows (lang, source, part, item, value, rank), by the definition."""
    docs = [tuple(x or "" for x in d) for d in docs]
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = terms(text)
        count[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang in {d[1] for d in docs}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        sources = sorted({d[2] for d in docs if d[1] == lang}, key=str.encode)

        def shares(counts, kept=kept):
            whole = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + math.floor(Fraction(10**9 * (counts[t] + 5), whole)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            excess = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", excess, most)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(df, **options):
    return sorted((r.lang, r.source, r.part, r.item, r["value"], r["rank"]) for r in divergence.audit(df, **options).collect())


def test_divergence_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang", "source").collect()]
    got = sorted((r.lang, r.source, r.part, r.item, r["value"], r["rank"]) for r in queries.op11_source_divergence(spark, SMALL).collect())
    assert got == audit(docs) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_of_odd_tables(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "日本", "z"]
    docs = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["a", "b", None]), rng.choice(["s", "t", "u", "", None])) for _ in range(120)]
    docs += [(t, "a", "odd") for t in ODD] + [docs[0]] * 3 + [("only one", "lone", "x"), (None, "none", "x"), ("", "none", "y"), ("q", "none", None)]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit(1), "vector": F.lit("v"), "n": F.lit(2), "docs": F.lit(3)})
    for least in (1, 4, 1000):
        assert audited(df, min_docs=least, most_terms=3) == audit(docs, least, 3)
    assert audited(df.limit(0)) == []


def test_divergence_in_runs_and_blocks(spark):
    """Blocks of two sources and runs of a few vectors give the same sums."""
    rng = random.Random(5)
    docs = [(" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(5))}" for _ in range(20)), "a", f"s{rng.randrange(5)}") for _ in range(60)]
    kept = divergence.kept_terms(spark.createDataFrame(docs, "text string, lang string, source string"), 2)
    vectors = kept.where("term <> ''").groupBy("lang", "vector").agg(F.count("*").alias("times"))
    groups = divergence.parameters(kept, vectors)
    take = lambda df: sorted(tuple(r) for r in df.select("lang", "source", "item", "value").collect())
    whole = take(divergence.pair_sums(vectors, groups))
    assert len(whole) == 20 and take(divergence.pair_sums(vectors, groups, 2, 3)) == whole
    assert whole == sorted((r[0], r[1], r[3], r[4]) for r in audit(docs, 2) if r[2] == "pair")


def test_terms_of_one_vector_are_evaluated_once(spark):
    docs = [("x y z" if i % 2 else "x y z v", "a", f"s{i % 3}") for i in range(60)]
    kept = divergence.kept_terms(spark.createDataFrame(docs, "text string, lang string, source string"))
    vectors = kept.where("term <> ''").groupBy("vector").agg(F.count("*").alias("times"))
    assert sorted(r.times for r in vectors.collect()) == [1, 3]


def test_shares_are_exact(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(t), t, rng.randrange(1, 10**6)) for t in (7, 10**6, 10**12, 8 * 10**15) for _ in range(20)]
    want = [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in rows]
    assert [int(divergence.shares(np.array([c]), np.array([t]), v)[0]) for c, t, v in rows] == want
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c long, t long, v long")
    assert [r.p for r in df.select("i", divergence.share("c", "t", "v").alias("p")).orderBy("i").collect()] == want


# 12


def whitened(rows, components=16):
    """rows: (id, vector). By the definition, with exact deviations; up to the sign of a component."""
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in usable}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in usable:
        w = (np.array(x) - mean) @ vectors
        for k in range(min(components, len(mean))):
            full = values[k] > 1e-12 * values[0]
            out.setdefault((i, k + 1), []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), abs(w[k]) / math.sqrt(values[k]) if full else None, values[k] / values.sum() if values.sum() > 0 else None))
    return out


def same_whitening(got, rows):
    want, seen = whitened(rows), defaultdict(list)
    for r in got:
        seen[r.vec_id, r.component].append((r.n, r.deviation, r.whitened, r.explained))
    assert seen.keys() == want.keys()
    close = lambda a, b: (a is None and b is None) or abs(abs(a) - b) <= 1e-6 * max(1, b)
    for key, rows_of in want.items():
        order = lambda x: (x[1], abs(x[2] or 0))
        for a, b in zip(sorted(seen[key], key=order), sorted(rows_of, key=order), strict=True):
            assert a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3])


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op12_embedding_whitening(spark, SMALL).collect()
    same_whitening(got, rows)
    assert len(got) == 16 * len(rows) and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error <= 1e-9
    scores = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 16)
    assert np.abs(np.cov(scores.T, bias=True) - np.eye(16)).max() < 1e-6  # one sign of a component for all rows


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({"x": F.lit("x"), "key": F.lit(1), "vector": F.lit(2), "component": F.lit(3)})


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    rows = [*good, (None, good[0][1]), (3, good[3][1]), (50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [math.nan] * 5), (53, [math.inf, 0.0, 0.0, 0.0, 0.0]), (54, [1e30, 0.0, 0.0, 0.0, 0.0])]
    got = whitening.whiten(vectors_of(spark, [*rows, (55, []), (56, [1.0] * 3)])).collect()
    same_whitening(got, rows[:-1])
    assert len(got) == 42 * 5 and {r.n for r in got} == {40}
    assert whitening.whiten(vectors_of(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0


def test_whitening_without_variance(spark):
    flat = [(i, [float(i), 2.0, float(-i)]) for i in range(6)]
    got = whitening.whiten(vectors_of(spark, flat)).collect()
    same_whitening(got, flat)
    assert all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-9
    one = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2


def test_deviations_are_exact():
    x = np.array([[1 << 40, 5], [3, -(1 << 50)]])
    m = whitening.Whitening(3, [7, 1 << 20], np.eye(2), np.ones(2), 2.0)
    exact = [sum((3 * a - s) ** 2 for a, s in zip(r, m.sums, strict=True)) for r in x.tolist()]
    assert m.deviation(x) == [e if e < 2**63 else None for e in exact] == [None, None]
    small = np.array([[1_000_003, 999_990]])
    assert whitening.Whitening(50_000, [5 * 10**10, 49 * 10**9], np.eye(2), np.ones(2), 2.0).deviation(small) == [(50_000 * 1_000_003 - 5 * 10**10) ** 2 + (50_000 * 999_990 - 49 * 10**9) ** 2]


def test_covariance_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS", 4)
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (-1.0, 0.5, 4.0)], "a double, b double, c double")
    m = np.array([[1.0, 2.0, 3.0], [-1.0, 0.5, 4.0]])
    assert np.allclose(whitening.covariance(df, 2), m.T @ m / 2)


# 13


def sentences(text):
    """Starts and ends of the sentences that have a term, and their terms."""
    return [(m.start(), m.end(), terms(m[0])) for m in re.finditer(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text or "") if terms(m[0])]


def test_bags_of_sentences():
    rng = random.Random(8)
    parts = ["ab", "Abcdefgh", "é", "日本語です", ".", "!", "?", "\n", " ", "1", "...", "x-y", "\U0001f600"]
    texts = [*ODD, *["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)]]
    settings = toxicity.Settings(bits=40)
    bags = toxicity.bags_of(pa.array(texts), settings)
    for i, text in enumerate(texts):
        mine = range(bags.sentences[i], bags.sentences[i + 1])
        want = sentences(text)
        assert len(mine) == len(want)
        for s, (_, _, found) in zip(mine, want, strict=True):
            features = {t for t in found} | {(n, t.encode()[:n]) for t in found for n in settings.prefixes if len(t.encode()) >= n}
            assert bags.features[s + 1] - bags.features[s] == len(features)
    starts, ends = toxicity._code_points(pa.array(texts), bags, np.arange(len(bags.start)))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(a, b) for t in texts for a, b, _ in sentences(t)]


def test_noisy_or_and_its_slope():
    """The gradient of the fit is that of the log loss: a small step of it lowers the loss as fast as it says."""
    p = np.array([0.1, 0.5, 0.0, 0.9, 0.2])
    bounds = np.array([0, 2, 2, 5])
    assert np.allclose(toxicity.noisy_or(p, bounds), [1 - 0.9 * 0.5, 0, 1 - 1.0 * 0.1 * 0.8])
    z = np.array([-2.0, 0.3, -1.0, 1.5, -0.5])
    y, doc = np.array([1, 0, 1]), np.array([0, 0, 2, 2, 2])

    def loss(z):
        whole = toxicity.noisy_or(toxicity._sigmoid(z), bounds)[[0, 2]]
        return -np.log(np.where(y[[0, 2]] > 0, whole, 1 - whole)).sum()

    s, whole = toxicity._sigmoid(z), toxicity.noisy_or(toxicity._sigmoid(z), bounds)[doc]
    slope = -s * (1 - whole) / whole
    numeric = [(loss(z + d) - loss(z - d)) / 2e-6 for d in np.eye(5) * 1e-6]
    assert np.allclose(slope, numeric, atol=1e-5)


def scored(spark, docs, labels, **settings):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_key": F.lit("k"), "_text": F.lit("t"), "score": F.lit(1)})
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, known, toxicity.Settings(**settings))
    return {(r.doc_id, i): r for i, r in enumerate(sorted(toxicity.score(df, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id)))}


def test_toxicity_finds_the_sentences(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs = []
    for i in range(300):
        lines = [[word() for _ in range(6)] for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            rng.choice(lines).insert(2, "zorrk" + rng.choice(["", "ish", "el", "ung"]))
        docs.append((i, ". ".join(map(" ".join, lines)) + "."))
    labels = [(i, int(i % 3 == 0)) for i in range(240)]
    rows = scored(spark, docs, labels)
    texts = dict(docs)
    for r in rows.values():
        assert r.predicted == int(r.doc_id % 3 == 0) and 0 <= r.score <= 1
        assert all("zorrk" in texts[r.doc_id][s.start : s.end] for s in r.offending) and bool(r.offending) == bool(r.predicted)


def test_toxicity_of_odd_tables(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "bad"), (5, "bad"), (5, "good"), (20, "bad thing"), (21, "good thing")]
    labels = [(20, 1), (21, 0), (20, 1), (5, None), (None, 1), (99, 1)]
    rows = list(scored(spark, docs, labels, min_docs=1).values())
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id in (0, 1, 2, 3, 4)] == [0.0] * 5
    assert all(r.score < 1e-9 for r in scored(spark, docs, []).values())
    only = scored(spark, docs, [(20, 1)])
    assert {round(r.score) for r in only.values() if r.n_sentences} == {1} and {r.score for r in only.values() if not r.n_sentences} == {0.0}
    assert all(r.score < 1e-9 for r in scored(spark, docs, [(21, 0)]).values())
    assert scored(spark, docs, labels, max_train=1, max_features=2) and scored(spark, [], []) == {}


def test_toxicity_query_on_held_out_labels(spark):
    """No label of a row with remainder 0 is learnt from; of these rows the model tells most."""
    sf = SMALL.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, sf).collect()}
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(r.predicted, known[d]) for d, r in got.items() if r.held_out and known.get(d) is not None]
    right = sum(p == y for p, y in held) / len(held)
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    assert right > 0.95 and caught > 0.7 and len(got) == 10_000
