"""The operators against plain Python versions, and on nulls, empty and long texts, repeated rows and other columns."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewheel.llm import bpe, chat, classifier, decontaminate, line_templates, ngram_join, pii, quality_rules, queries, substrings, warc  # noqa: E402
from tidewheel.llm.io import shared_dir  # noqa: E402
from tidewheel.llm.words import words_of  # noqa: E402

DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n\n", "one", "a b", "é x\x85y \x1c z", "\U0001f600" * 30, "x " * 3000, "w" * 20_000]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


def small_docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def changed(rng, text, share):
    return " ".join(w if rng.random() > share else rng.choice("abcdefgh") * rng.randint(1, 3) for w in text.split())


def made_docs(seed, n=250):
    """Copies and near copies of texts of many sizes, with odd texts, repeated rows and null ids."""
    rng = random.Random(seed)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(k)) for k in (3, 5, 6, 8, 10, 15, 40, 90, 250)]
    docs = [(i if i % 40 else None, changed(rng, rng.choice(base), rng.choice([0, 0, 0.005, 0.01, 0.02, 0.04]))) for i in range(n)]
    return docs + [(1000 + i, t) for i, t in enumerate(ODD)] + [docs[3], docs[4], docs[4], (5, "another text")]


def test_words_are_what_the_pattern_takes():
    texts = [*ODD, "a\tb\x0bc\x0cd\re f ", "ab\n", "\nab"]
    w = words_of(pa.array(texts))
    got = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.bounds[i], w.bounds[i + 1])] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    h = w.hashes()
    flat = [x for t in texts for x in brute.words(t)]
    assert len({x: v for x, v in zip(flat, h.tolist(), strict=True)}) == len(set(h.tolist()))


# 1


def test_warc_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()]
    got = rows_of(queries.op1_warc(spark, SMALL), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.warc(pages)


@pytest.mark.parametrize("split", [7, 1000, 1 << 20])
def test_warc_odd_pages_and_splits(spark, split):
    noise = bytes(random.Random(3).randrange(256) for _ in range(3000)).decode("latin-1")
    pages = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "bad\r\nurl", ""), (None, "u", "alone"), (None, "u", "same"), (5, "u", "x" * (17 << 20) if split > 10_000 else "long"), (6, "u", "same"), (6, "u", "same"), (7, "u", noise), (8, "u", "\x1f\x8b\x08" * 5)]
    df = frame(spark, pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = shared_dir(spark, "warc-test")
    warc.write_warc(warc.with_originals(df), path)
    read = warc.read_warc(spark, path, split).where("warc_type <> 'warcinfo'").collect()
    got = []
    for r in read:
        h = dict(r.headers)
        got.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], r.warc_type, int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None))
        if r.warc_type == "response":
            assert hashlib.sha1(bytes(r.payload)).digest() == __import__("base64").b32decode(got[-1][2])
    assert sorted(got, key=str) == brute.warc([(p, t) for p, _, t in pages])


def test_warc_skips_what_is_no_record(spark, tmp_path):
    wide = warc.member(warc.record_bytes("response", {"WARC-Target-URI": "".join(map(str, range(400_000)))}, b"wide"))
    good = warc.member(warc.record_bytes("response", {"WARC-Record-ID": "<a>"}, b"body"))
    (tmp_path / "a.warc.gz").write_bytes(b"\x1f\x8b\x08junk" + good + zlib.compress(b"x") + warc.member(b"no record") + good + wide + good[:-9])
    assert [bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()] == [b"body", b"body", b"wide"]
    (tmp_path / "a.warc.gz").write_bytes(b"")
    assert warc.read_warc(spark, f"file://{tmp_path}").count() == 0


# 2


@pytest.mark.parametrize(("window", "base"), [(4, 1), (4, 2), (4, 4), (20, 5), (20, 10)])
def test_substrings(spark, window, base):
    docs = made_docs(window, 60) + [(9, " ".join(random.Random(2).choice("abc") for _ in range(200)))]
    got = rows_of(substrings.repeated_passages(frame(spark, docs).withColumn("_key", F.lit(1)), window, base), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substrings(docs, window)


def test_substrings_query_and_text(spark):
    assert rows_of(queries.op2_substring_dedup(spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substrings(small_docs(spark))
    kept = substrings.repeated_passages(frame(spark, [(1, "a  b c d"), (2, "x a b c d y")]), 4, 2, with_text=True)
    assert rows_of(kept, "doc_id", "kept") == [(1, "a b c d"), (2, "x y")]
    assert substrings.repeated_passages(frame(spark, [])).count() == 0


# 3


def test_pii(spark):
    rng = random.Random(2)
    parts = ["a", "b", "@", ".", "-", "+", "1", "29", " ", "(", ")", "0", "é", "\U0001f600", "\n", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (269) 555-3296", "%", "_", "256"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(600)] + [(1, None), (None, "x a@b.cc"), (None, "x a@b.cc"), (3, "9" * 30_000), (4, "a" * 40_000 + "@"), (5, "1-" * 20_000)]
    found = pii.personal_data(frame(spark, docs).withColumn("kind", F.lit("x")))
    base = found.select("doc_id", pii.span_text(F.filter("spans", lambda x: x["base"])).alias("s"))
    assert rows_of(base, "doc_id", "s") == sorted([(d, brute.pii(t)) for d, t in docs], key=str)


def test_pii_learns_contexts(spark):
    docs = [(i, f"please call tel: +1 (269) 555-{1000 + i} now") for i in range(20)] + [(100, "so call tel: 0171-555-1234, now"), (101, "the 20240101 build"), (102, "tel: none")]
    got = {r.doc_id: r.s for r in pii.personal_data(frame(spark, docs)).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert got[100] == "phone:13:26" and got[101] == "" and got[102] == "" and got[3].startswith("phone:17:")
    assert pii.personal_data(frame(spark, [])).count() == 0
    more = docs + [(200, "they tel: (555) 123-4567, so"), (201, "please call tel: 0176 1234567"), (202, "an 0176 1234567 alone")]
    got = {r.doc_id: r.s for r in pii.personal_data(frame(spark, more)).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert got[200] == "phone:10:24" and got[201] == "phone:17:29" and got[202] == ""
    starts = [(i, f"+1 (269) 555-{1000 + i} is mine") for i in range(20)] + [(30, "0171-555-1234 is yours"), (31, "not 0171-555-1234 at all")]
    got = {r.doc_id: r.s for r in pii.personal_data(frame(spark, starts)).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert got[30] == "phone:0:13" and got[31] == "" and got[4] == "phone:0:17"
    odd = [(300 + i, t) for i, t in enumerate([" 12 a", "1", "\n\n77 x", "a 1 2 3", "x@", "ab 5", "5 ab 6 cd"])]
    assert pii.personal_data(frame(spark, docs + odd)).count() == len(docs + odd)


@pytest.mark.parametrize("text", ["1 a 22 b", " 12 a", "1", "\n\n77 x 8", "a 1 2 3", "x@ y 5", "ab 5", "5 ab 6 cd (7) 8", "é1 ü 2 \U0001f600 3 4", "a1 b2 c3", "+1 (2) 3-4 5x 6"])
def test_pii_candidates_are_where_they_say(spark, text):
    docs = frame(spark, [(1, text)]).select(F.col("doc_id").alias("row_id"), "text", F.lit(0).cast("long").alias("row_hash"))
    got = sorted((r.start, r.word) for r in pii.found_items(docs).where("not base").collect())
    assert got and all(text[a : a + len(w)] == w for a, w in got)
    number, want = r"[+(]*[0-9][0-9().+-]*", []
    for m in __import__("re").finditer(rf"(?<!\S)(?:{number}(?: {number})*(?!\S)|[^\s0-9@]*[0-9@]\S*)", text):
        bare = __import__("re").sub(r"^[(\[{<\"']+(?![0-9]+\))", "", m[0])
        want.append((m.end() - len(bare), bare.rstrip(".,;:!?)]}>\"'")))
    assert sorted(set(want)) == got


def test_pii_runs_of_numbers_and_long_words(spark):
    """A run of numbers is one candidate whatever its length; words of a context are compared whole."""
    docs = [(1, "1 " * 1_000_000), (2, "7\n" * 200_000)]
    got = {(r.row_id, r.n) for r in pii.found_items(frame(spark, docs).select(F.col("doc_id").alias("row_id"), "text", F.lit(0).cast("long").alias("row_hash"))).where("not base").groupBy("row_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 1), (2, 200_000)}
    known = [(i, "q" * 60 + f" id a{i}@b.cc") for i in range(20)]
    others = [(30, "z" * 20 + "q" * 40 + " id ab12345"), (31, "q" * 60 + " id ab12345"), (32, "\t" * 60 + "id ab12345"), (33, "id x1 id ab12345")]
    mixed = [(50 + i, f"other{i} id w{i}") for i in range(40)]
    found = pii.candidates(pii.found_items(frame(spark, known + others + mixed).select(F.col("doc_id").alias("row_id"), "text", F.lit(0).cast("long").alias("row_hash"))))
    second = {(r.row_id, r.word): r.patterns[1] for r in found.collect()}
    assert second[30, "ab12345"] == "z" * 20 + "q" * 40 + " id" and second[31, "ab12345"] == "q" * 60 + " id"
    assert second[32, "ab12345"] == "^ id" and second[33, "ab12345"] == "x1 id" and second[33, "x1"] == "^ id"
    got = {r.doc_id: r.s for r in pii.personal_data(frame(spark, known + others + mixed)).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert got[31] == "email:64:71" and got[30] == got[32] == got[33] == ""


def test_pii_query(spark):
    rows = queries.op3_pii(spark, SMALL).collect()
    for r, text in ((r, dict(small_docs(spark))[r.doc_id]) for r in rows):
        s = brute.pii(text)
        assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(s.count(f"{k}:") for k in pii.KINDS)


# 4


def coder():
    import base64

    import tiktoken

    path, pattern = queries.tokenizer_file()
    raw = Path(path).read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.BytePairs(raw, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library():
    ours, theirs = coder()
    rng = random.Random(4)
    parts = ["a", "b", "aa", "  ", "\n", "\x1c", "\x85", "　", "é", "日本", "1", "²", " the", "tion", "'s", "'ll", "​", "\U0001f600", "<|endoftext|>", "%%%", "\t", "ñ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(800)] + ["a" * 3000, "ab" * 2000, " " * 2000, "the" * 900] + [t or "" for t in ODD]
    for text, code in zip(texts, ours.encode(texts), strict=True):
        ids = np.frombuffer(code, "<u4")
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()
    long = "word " * 300_000
    assert ours.decode(np.frombuffer(ours.encode([long])[0], "<u4")) == long.encode()


def test_bpe_columns(spark):
    path, pattern = queries.tokenizer_file()
    df = frame(spark, [(i, t) for i, t in enumerate(ODD)] + [(0, "twice"), (0, "twice")]).withColumn("token_ids", F.lit("old")).withColumn("n_tokens", F.lit(1))
    back = bpe.decode(bpe.encode(df, path, pattern), path, pattern)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect()) and back.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    _, theirs = coder()
    want = {d: theirs.encode_ordinary(t) for d, t in small_docs(spark)}
    for r in queries.op4_byte_bpe(spark, SMALL).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(dict(small_docs(spark))[r.doc_id].encode()).hexdigest()
    assert bpe.encode(frame(spark, []), path, pattern).count() == 0


# 5


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = [rng.choice("abcdefgh") * k for k in range(1, 4) for _ in range(4)]
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((4, 8, 9, 10, 15, 30, 60))] + [(7, None), (3, text(20))]
    docs = [(i, " ".join([text(rng.randint(0, 30)), changed(rng, rng.choice(items)[1] or "", rng.choice([0, 0.05, 0.1, 0.3])), text(rng.randint(0, 30))])) for i in range(150)]
    docs += [(500 + i, t) for i, t in enumerate(ODD)] + [docs[0], docs[0], (None, items[5][1].upper())]
    found = decontaminate.contaminated(frame(spark, docs).withColumn("item_id", F.lit(1)), frame(spark, items, "item_id long, text string"))
    want = brute.contaminated(docs, items)
    assert rows_of(found, "doc_id", "item_id") == sorted(want, key=str) and len(want) > 60
    kept = decontaminate.drop_contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    bad = {(d, t) for d, t in docs if brute.contaminated([(d, t)], items)}
    assert rows_of(kept, "doc_id", "text") == sorted([x for x in docs if x not in bad], key=str)
    in_blocks = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"), decontaminate.Seeds(block_words=40))
    assert rows_of(in_blocks, "doc_id", "item_id") == sorted(want, key=str)
    assert decontaminate.contaminated(frame(spark, docs), frame(spark, [], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0


def test_decontamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {(d, i) for d, t in small_docs(spark) for i, b in items if " ".join(brute.words(b)) in " ".join(brute.words(t))}
    assert held and held <= set(rows_of(queries.op5_decontaminate(spark, SMALL), "doc_id", "item_id"))


# 6


@pytest.mark.parametrize("plan", [ngram_join.Plan(), ngram_join.Plan(thin_cost=200, spare=0.1, ratio=1.7), ngram_join.Plan(node_bits=5)])
def test_jaccard(spark, plan):
    docs = made_docs(8)
    assert rows_of(ngram_join.near_duplicates(frame(spark, docs).withColumn("node", F.lit(1)), plan), "doc_id", "n_shingles", "component_id") == brute.jaccard(docs)


def test_jaccard_dense_group(spark):
    rng = random.Random(9)
    base = " ".join(f"{rng.choice('abcdef')}{i}" for i in range(100))
    docs = [(i, changed(rng, base, 0.03)) for i in range(300)]
    assert rows_of(ngram_join.near_duplicates(frame(spark, docs), ngram_join.Plan()), "doc_id", "n_shingles", "component_id") == brute.jaccard(docs)


def test_jaccard_later_rounds_take_their_own_nodes(spark, monkeypatch):
    rng = random.Random(10)
    base = " ".join(f"{rng.choice('abcdef')}{i}" for i in range(100))
    alone = [(i, " ".join(str(rng.random()) for _ in range(20))) for i in range(600)]
    docs = alone + [(1000 + i, changed(rng, base, 0.03)) for i in range(150)]
    given = []
    for name in ("plausible", "across"):
        f = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda *a, f=f: (given.append(a[-1].count()), f(*a))[1])
    assert rows_of(ngram_join.near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == brute.jaccard(docs)
    assert len(given) > 2 and given[0] >= 600 and max(given[1:]) <= 150  # the first join has the sketches of all


def test_jaccard_query_and_filter(spark):
    assert rows_of(queries.op6_ngram_jaccard(spark, SMALL), "doc_id", "n_shingles", "component_id") == brute.jaccard(small_docs(spark))
    docs = made_docs(10, 120)
    df = frame(spark, docs).withColumn("node", F.lit("x")).withColumn("label", F.col("doc_id"))
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = rows_of(kept, "doc_id", "text")
    left = [d for d in docs if brute.shingles(d[1])]
    groups = {c for _, n, c in brute.jaccard(docs) if n}
    assert len([g for g in got if brute.shingles(g[1])]) == len(groups) and {g[0] for g in got if brute.shingles(g[1])} == groups
    assert len([g for g in got if not brute.shingles(g[1])]) == len(docs) - len(left)
    assert ngram_join.drop_near_duplicates(frame(spark, [])).count() == 0


def test_bands_keep_the_pigeonhole():
    for plan in (ngram_join.Plan(), ngram_join.Plan(thin_cost=200), ngram_join.Plan(ratio=2.5, spare=0.0)):
        for b in ngram_join.bands(plan, 5000):
            assert b.differ == max((s + s * 5 // 4) // 9 for s in range(b.low, b.high))
            assert b.segments + b.deleting == b.differ + b.spare and b.spare >= 1 and b.deleting <= b.segments
    for plan, some in ((ngram_join.Plan(), 1), (ngram_join.Plan(thin_cost=200), 5)):  # neighbourhoods where they cost less
        table = ngram_join.bands(plan, 5000)
        assert sum(b.deleting > 0 for b in table) >= some
        for b in table:
            plain = 3 + int(plan.spare * b.differ)
            costs = [ngram_join.expected_cost((b.low + b.high - 1) / 2, *x, plan.thin_cost) for x in ((b.segments, b.deleting, b.spare), (b.differ + plain, 0, plain))]
            assert costs[0] <= costs[1] and (b.deleting == 0 or costs[0] < costs[1])


# 7


def test_line_templates(spark):
    lines = ["Posted by user 17 in forum x today at noon", "short line here", "one", "All pages are kept and all rights are reserved by them"]
    rng = random.Random(11)
    docs = []
    for i in range(40):
        own = [f"own {rng.random()} text of {i} " + " ".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(3)]
        named = f"Posted by user {i} in forum {rng.choice(['a', 'b', 'long name'])} today at noon"
        open_ = f"All pages are kept and all {rng.choice(['things', 'words'])} are reserved by them"
        long = " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz") + (" of one" if i % 8 == 0 else f" of {own[0][:9]}")
        docs.append((i, "\n".join(rng.sample([*own, named, open_, long, *lines[1:3], rng.choice(lines)], 7))))
    docs += [(100 + i, t) for i, t in enumerate(ODD)] + [docs[0], docs[0], (None, docs[1][1])]
    df = frame(spark, docs).withColumn("n_chars", F.length("text")).withColumn("__docbucket", F.lit(77)).withColumn("is_text", F.lit("x"))
    for k in (2, 10, 30):
        cut = line_templates.drop_recurring_lines(df, line_templates.Tree(min_docs=k))
        assert cut.columns == df.columns and {(r.__getitem__("__docbucket"), r.is_text) for r in cut.select("__docbucket", "is_text").collect()} == {(77, "x")}
        assert rows_of(cut, "doc_id", "text") == sorted(brute.drop_lines(docs, k), key=str)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    assert line_templates.drop_recurring_lines(frame(spark, [])).count() == 0


def test_line_templates_query(spark):
    want = [(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in brute.drop_lines(small_docs(spark))]
    assert rows_of(queries.op7_line_templates(spark, SMALL), "doc_id", "kept_sha256") == sorted(want, key=str)


# 8


def test_quality_rules(spark):
    docs = [(i, t) for i, t in enumerate([*ODD, "Line one is here.\nLine one is here.\nhome | news | about\nAll Rights Reserved here now.\nTHIS IS ALL LOUD TEXT.\nof## the** and$$"])] + made_docs(12, 60)
    got = quality_rules.quality_rules(frame(spark, docs).withColumn("kept", F.lit(1)), with_text=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got, "doc_id", *names) == sorted([(d, *brute.quality(t)) for d, t in docs], key=str)
    rows = {r.doc_id: r for r in got.where("doc_id = 10").collect()}
    assert rows_of(got.where("doc_id = 10 AND n_symbols > 0"), "cleaned") == [("Line one is here.",)]
    assert all(not (r.base_failed and r.kept) for r in got.collect()) and rows
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def test_quality_rules_keep_what_is_labelled_good(spark):
    marks = spark.read.parquet(f"{SMALL}/labels.parquet").join(queries.op8_quality_rules(spark, SMALL), "doc_id").collect()
    good = [r for r in marks if r.quality == 1 and not r.base_failed]
    bad = [r for r in marks if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


# 9


def test_chat_folds_events(spark):
    events = [
        ("c", 1, 0, "start", "user", "hi"), ("c", 2, 1, "start", "assistant", "He"), ("c", 2, 2, "delta", None, "llo"), ("c", 2, 3, "regenerate", None, None), ("c", 2, 4, "delta", None, "Good "), ("c", 2, 5, "delta", None, "day"),
        ("c", 1, 9, "edit", None, "hi <|end|> there"), ("c", 3, 1, "start", "user", "gone"), ("c", 3, 2, "delete", None, None), ("c", 4, 1, "delta", "tool", None), ("c", 4, 2, "unknown", "x", "y"), ("c", 5, 1, "start", "user", "a"), ("c", 5, 1, "start", "user", "b"),
        (None, None, None, "start", None, None), ("d", 1, 1, "start", "user", "x"), ("d", 1, 2, "delete", None, None),
    ]
    ids = {"c": 7, "d": 8, None: None}
    df = frame(spark, [(ids[c], m, s, k, r, t, 1) for c, m, s, k, r, t in events], "conv_id long, message long, seq long, kind string, role string, text string, part int")
    out = {}
    for r in chat.render(df).orderBy("conv_id", "part").collect():
        out.setdefault(r.conv_id, []).extend(chat.read_turns(r.formatted))
        if r.loss_start is not None:
            assert r.role == "assistant" and chat.unescape(r.formatted[r.loss_start - r.start : r.loss_end - r.start]) == "Good day"
    assert out == {7: [("user", "hi <|end|> there"), ("assistant", "Good day"), ("tool", ""), ("user", "a"), ("user", "b")], None: [("", "")]}


def test_chat_escapes_are_reversible():
    rng = random.Random(13)
    for _ in range(3000):
        role, text = ("".join(rng.choice(["<", "\\", "|", "<|end|>", "<|turn|>", "\n", "a", "n", "</s>"]) for _ in range(rng.randint(0, 8))) for _ in range(2))
        formatted, a, b = chat.format_turn(role, text)
        assert chat.read_turns(formatted * 2) == [(role, text)] * 2 and chat.unescape(formatted[a:b]) == text


def test_chat_query(spark):
    rows = sorted([tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, _, role, text in rows:
        n, turns, loss = want.get(c, (0, "", ""))
        want[c] = (n + 1, turns + f"{role}\n{text or ''}\n", loss + (text or "") * (role == "assistant"))
    got = queries.op9_chat_format(spark, SMALL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows_of(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted([(c, n, sha(t), len(x), sha(x)) for c, (n, t, x) in want.items()], key=str)
    assert chat.render(chat.rows_as_events(frame(spark, [], "conv_id long, turn long, role string, text string"))).count() == 0


# 10


def test_classifier(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)


def test_fit_gives_memory_back_in_the_driver(spark, monkeypatch):
    given = []
    monkeypatch.setattr(classifier, "give_back", lambda: given.append(1))
    docs = [(i, f"some text {i}") for i in range(10)]
    classifier.train(frame(spark, docs), spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int"))
    assert given


def test_classifier_odd_rows(spark):
    docs = [(i, "plain words in a row. " * 3) for i in range(30)] + [(100 + i, "LOUD!! LOUD!! ***") for i in range(30)]
    labels = frame(spark, [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(3, None), (5, 1), (5, 1)], "doc_id long, quality int")
    model = classifier.train(frame(spark, docs), labels)
    tried = frame(spark, docs + [(200 + i, t) for i, t in enumerate(ODD)] + [(None, "plain words in a row."), (None, None)]).withColumn("score", F.lit(5))
    scored = classifier.score(tried, model)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got[3] > 0.7 and got[105] < 0.3 and got[200] == got[201] and scored.count() == tried.count()
    kept = classifier.filter_quality(tried, model)
    assert kept.columns == tried.columns and {r.doc_id for r in kept.collect()} >= set(range(30)) and not {r.doc_id for r in kept.collect()} & set(range(100, 130))
    alone = classifier.train(frame(spark, docs), labels.where("quality = 1"))
    assert {r.score for r in classifier.score(frame(spark, docs), alone).collect()} == {1.0}
    none = classifier.train(frame(spark, docs), labels.where("false"))
    assert {r.score for r in classifier.score(frame(spark, docs), none).collect()} == {0.5}
    assert classifier.score(frame(spark, []), model).count() == 0


# oracle SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    relation = duck.sql(queries.ORACLES[name])
    places = [relation.columns.index(c) for c in columns]
    assert len(columns) == len(relation.columns)
    assert rows_of(df, *columns) == sorted([tuple(r[i] for i in places) for r in relation.fetchall()], key=str)
