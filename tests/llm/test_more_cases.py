"""Clashing names and long texts for operators 1, 2, 3, 8, 9 and 10, and the classifier's fit against its definition."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import chat, classifier, decontaminate, oracles, pii, quality_rules, queries, substrings, warc
from tidewheel.llm.io import shared_dir

HELPERS = "_key _text _label _features _upto _docs _spots _bucket docbucket is_text payload payload_digest original refers_to n kind number before size word left right row_id row_hash run patterns base start end seq message part formatted score predicted kept bucket keys places n_words has_digit url2".split()
TEXTS = ["mail a@b.cc to me. " * 3, "one two three four five six seven eight nine ten eleven twelve. " * 4, None, "", "A line without a sign\nclick here to win\nA full sentence with ten words stands in this line here."]


def crowded(df, *taken):
    return df.withColumns({name: F.lit(n) for n, name in enumerate(HELPERS) if name not in taken})


def same(plain, more):
    columns = plain.columns
    assert more.columns == columns and sorted(map(str, plain.collect())) == sorted(map(str, more.select(columns).collect()))


def test_clashing_names_of_documents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id long, text string")
    full = crowded(docs)
    same(substrings.repeated_passages(docs), substrings.repeated_passages(full))
    same(pii.personal_data(docs), pii.personal_data(full))
    same(quality_rules.quality_rules(docs), quality_rules.quality_rules(full))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    plain, more = classifier.train(docs, labels), classifier.train(full, crowded(labels))
    same(classifier.score(docs, plain), classifier.score(full, more))
    kept = classifier.filter_quality(full, more)
    assert kept.columns == full.columns and kept.count() == classifier.filter_quality(docs, plain).count()


def test_clashing_names_of_pages_and_messages(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, None, None)], "page_id long, url string, html string")
    same(warc.with_originals(pages), warc.with_originals(crowded(pages)))
    turns = spark.createDataFrame([(1, 0, "user", "a <| b"), (1, 1, "assistant", "c"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    same(chat.render(chat.rows_as_events(turns), dealt=True), chat.render(chat.rows_as_events(crowded(turns, "role", "text", "turn")), dealt=True))


def test_long_pages_and_messages(spark):
    """A page and a message of 9 MB, more than a block or a slice."""
    long = "<p>é \U0001f600 [INST] " * 500_000
    path = shared_dir(spark, "long-warc")
    warc.write_warc(warc.with_originals(spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "s")], "page_id long, url string, html string")), path)
    got = {r.headers["X-Page-ID"]: (r.warc_type, hashlib.sha1(bytes(r.payload)).hexdigest()) for r in warc.read_warc(spark, path, 1 << 20).where("warc_type <> 'warcinfo'").collect()}
    assert got["2"] == ("response", hashlib.sha1(long.encode()).hexdigest()) and got["1"][0] == "revisit" and got["3"][0] == "response"
    turns = spark.createDataFrame([(1, 0, "user", long + "<|end|>"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.render(chat.rows_as_events(turns), dealt=True).collect(), key=lambda r: r.part)
    assert [t for r in rows for t in chat.read_turns(r.formatted)] == [("user", long + "<|end|>"), ("assistant", long)]
    assert rows[1].loss_end - rows[1].loss_start == len(chat.escape(long))


# 10


def test_weights_are_where_the_slope_is_nothing():
    """Squared hinge loss with a bias of size one: at its least value the gradient is 0."""
    rng = np.random.default_rng(4)
    dims = 30
    rows = [np.sort(rng.choice(dims, 6, replace=False)) for _ in range(80)]
    values = [rng.normal(size=6) for _ in rows]
    y = np.where(rng.random(80) < 0.4, 1.0, -1.0)
    cost = rng.uniform(0.2, 2.0, 80)
    weights, bias = classifier.descend(rows, values, y, dims, cost, 3000)
    x = np.zeros((80, dims + 1))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r], x[i, dims] = v, 1.0
    w = np.append(weights, bias)
    gradient = w - 2 * ((cost * y * np.maximum(0, 1 - y * (x @ w)))[:, None] * x).sum(0)
    assert np.abs(gradient).max() < 5e-2 * np.abs(w).max()


def test_features_scale_by_ratios_of_class_counts():
    """One text of each class, without blend: weights lie on log-ratios of smoothed counts, scaled to unit length."""
    settings = classifier.Settings(bits=4, blend=1.0)
    rows, labels = [np.array([1, 2]), np.array([2, 3])] * 3, np.array([1, 0] * 3)
    model = classifier.fit(rows, labels, settings)
    good, bad = np.ones(16), np.ones(16)
    for r, label in zip(rows, labels, strict=True):
        (good if label else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    assert np.allclose(model.weights[0], ratio**2)
    score = model.score(np.array([classifier.margin_of(r, model) for r in rows[:2]]))
    assert score[0] > 0.5 > score[1]


def test_calibration_has_no_slope_left():
    rng = np.random.default_rng(6)
    margin = rng.normal(size=300)
    positive = rng.random(300) < 1 / (1 + np.exp(-(1.7 * margin - 0.4)))
    slope, shift = classifier.calibrate(margin, positive)
    p, n = positive.sum(), (~positive).sum()
    target = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    got = 1 / (1 + np.exp(-(slope * margin + shift)))
    assert abs(((got - target) * margin).sum() + 1e-3 * slope) < 1e-3 and abs((got - target).sum()) < 1e-3 and 1.2 < slope < 2.2


# 5


def test_sql_and_query_agree_on_wide_stretches(spark, tmp_path):
    """Items with changed words, where the best-scoring part is too short and a wider stretch is not."""
    rng = np.random.default_rng(7)
    items = [(n, [f"w{n}x{k}" for k in range(n)]) for n in range(12, 22)]
    docs = []
    for n, w in items:
        for at in range(40):
            changed = set(rng.choice(n, rng.integers(1, 5), replace=False).tolist())
            docs.append((100 * n + at, " ".join(["before", *["other" if k in changed else x for k, x in enumerate(w)], "after"])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matched"]
    got = sorted(tuple(r[c] for c in columns) for r in queries.op5_decontaminate(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES['op5_decontaminate']})").fetchall())
    narrow = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string"), decontaminate.Seeds())
    assert len(got) > narrow.count() > 0
