"""Personal data by patterns, and by contexts learnt from what the patterns find (operator 3).

Base entities are found by regular expressions. Then candidates are taken: words that hold a digit or an @, and groups of
digits and the signs of numbers that are joined by single spaces, as one candidate. Each has three lexical patterns: the
word to its left, the two words to its left, and the words to its left and right; where there is no word the edge of the
text stands for it. Patterns and candidate words form a graph whose edges are counts over the whole corpus. Words that base
entities start in are the seeds; in each round a pattern's confidence in a kind is the share of its occurrences whose words
are held to be of that kind, and a word that is no seed takes the confidence of its patterns, weighed by occurrences; one
that reaches the confidence asked for is a seed from the next round on. Patterns that end with high confidence and enough
different seeds mark the other candidates that stand in them, if these look like identifiers and do not overlap a base entity.

Everything is DataFrame functions: positions are sums of the lengths of what regular expressions split off. Patterns are
written so that they neither recurse nor look at a run of characters, or of numbers, again from each of its places.

Defined results: a null text is empty; rows without entities have counts of 0, empty spans and the digest of nothing.
Rows equal in id and text have equal results; rows with one id and different texts are looked at each for itself. Of kinds
of equal confidence the one that is listed first is taken. A text of any length is taken whole; its pieces are rows after
the first step. Columns besides id and text play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import shared_dir

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
SPACE = r"\x20\x09-\x0D"
# The base patterns. Runs are taken whole, from their first character or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NUMBER = r"[+(]*+[0-9][0-9().+-]*+"
_CLOSING = ",;:!?\\]}>\"'"
#: A further group of a run of numbers: signs may close it, then comes a space or the end.
_MORE = rf"\x20{_NUMBER}(?=[{_CLOSING}]*+(?![^{SPACE}]))"
#: A word and the space behind it (or the text's start, for which a space is put there), before a run of numbers or a word with
#: a digit or an @, and the word behind that. A number that another group follows is no left word, so that a run is one match.
CONTEXT = (
    rf"(?:\A\x20[{SPACE}]*+|(?<![^{SPACE}])(?!{_NUMBER}{_MORE})([^{SPACE}]++)[{SPACE}]++)"
    rf"(?=({_NUMBER}(?:{_MORE})*+[{_CLOSING}]*+(?![^{SPACE}])|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)[{SPACE}]*+([^{SPACE}]*+))"
)
EDGE = "^"
PIECE = "struct<kind:int,number:int,before:int,size:int,word:string,further:string,left:string,right:string>"


@dataclass(frozen=True)
class Learning:
    """rounds: of scoring. confidence: from which a pattern counts. seeds: different seed words that a pattern needs.
    digits: that a discovered identifier has at least, unless it has an @."""

    rounds: int = 3
    confidence: float = 0.7
    seeds: int = 3
    digits: int = 4


def _pieces(text: Column, kind: int, pattern: str, context: bool = False) -> Column:
    """An array of PIECE for each match: characters before and of it, and its word. A match of a context is the word to the
    left; its word and the one to the right are looked ahead for, further is the last word before the match, if any."""
    groups = {"match": 0} | ({"left": 1, "word": 2, "right": 3} if context else {})
    parts = [F.split(text, pattern, -1).alias("before"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items())]

    def piece(x: Column, i: Column) -> Column:
        further = F.reverse(F.regexp_extract(F.reverse(x["before"]), rf"\A[{SPACE}]*+([^{SPACE}]*+)", 1)) if context else F.lit(None)
        fields = {"kind": F.lit(kind), "number": i, "before": F.length(x["before"]), "size": F.length(x["match"]), "word": x["word"] if context else x["match"], "further": further}
        fields |= {side: x[side] if context else F.lit(None) for side in ("left", "right")}
        return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(PIECE)

    return F.transform(F.filter(F.arrays_zip(*parts), lambda x: x["match"].isNotNull()), piece)


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string passes the check: from the right, each second digit doubled and its digits summed."""
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    n = F.length(_digits(F.col("word")))
    small = F.forall(F.split("word", r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (
        F.when(F.col("kind") == KINDS.index("ip"), small)
        .when(F.col("kind") == KINDS.index("card"), n.between(16, 19) & luhn(_digits(F.col("word"))))
        .when(F.col("kind") == KINDS.index("phone"), n.between(8, 15))
        .otherwise(True)
    )


def found_items(docs: DataFrame) -> DataFrame:
    """Base entities (base is true) and candidates of the texts (row_id, row_hash, text), with their places."""
    text = F.col("text")
    has_digit = F.col("has_digit")
    none = F.array().cast(f"array<{PIECE}>")
    hint = {"email": F.contains(text, F.lit("@")), "ip": has_digit, "card": has_digit, "phone": F.contains(text, F.lit("+")) & has_digit}
    kinds = [F.when(hint[k], _pieces(text, i, PATTERNS[k])).otherwise(none) for i, k in enumerate(KINDS)]
    kinds.append(F.when(has_digit | hint["email"], _pieces(F.concat(F.lit(" "), text), CANDIDATE, CONTEXT, True)).otherwise(none))
    raw = docs.withColumn("has_digit", text.rlike("[0-9]")).select("row_id", "row_hash", F.explode(F.concat(*kinds)).alias("x")).select("row_id", "row_hash", "x.*").distinct()
    order = Window.partitionBy("row_id", "row_hash", "kind").orderBy("number")
    run = F.sum((F.col("before") + F.col("size")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    base = F.col("kind") < CANDIDATE
    # with nothing but the match before in front of it, a left word has that match's left word before it
    further = F.when(F.col("further") == "", F.lag("left").over(order)).otherwise(F.col("further"))
    further, left, right = (F.lower(F.when(F.coalesce(c, F.lit("")) == "", EDGE).otherwise(c)) for c in (further, F.col("left"), F.col("right")))
    patterns = F.when(~base, F.array(left, F.concat_ws(" ", further, left), F.concat(left, F.lit(" _ "), right)))
    placed = raw.withColumns({"run": run, "patterns": patterns})
    # a candidate is a word behind the match; signs around it do not belong to it
    bare = F.regexp_replace("word", r"^[(\[{<\"']+(?![0-9]+\))", "")  # brackets around a number's first digits belong to it
    lead = F.length("word") - F.length(bare)
    core = F.regexp_replace(bare, r"[.,;:!?)\]}>\"']+$", "")
    start = F.when(base, F.col("run") - F.col("size")).otherwise(F.col("run") + lead - 1)
    word = F.when(base, F.col("word")).otherwise(core)
    return placed.where(_valid()).select("row_id", "row_hash", "kind", base.alias("base"), "patterns", word.alias("word"), start.alias("start"), (start + F.length(word)).alias("end"))


def candidates(items: DataFrame) -> DataFrame:
    """Candidates, with kind and text of the base entity that starts in them, if any (seed, word); those within one are left out."""
    order = Window.partitionBy("row_id", "row_hash").orderBy("start", F.desc("base"), "end", "kind")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    same = F.max(F.when(F.col("base"), F.struct("start", "kind", "word"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.struct("start", "kind", "word"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = items.withColumns({"ends": ends, "same": same, "following": following}).where(~F.col("base"))
    at_start, inside = F.col("same.start") == F.col("start"), F.col("following.start") < F.col("end")
    seed = F.when(at_start, F.col("same.kind")).when(inside, F.col("following.kind"))
    whole = F.when(at_start, F.col("same.word")).when(inside, F.col("following.word")).otherwise(F.col("word"))
    overlaps = F.coalesce(F.col("ends") > F.col("start"), F.lit(False)) & ~F.coalesce(at_start, F.lit(False))
    return seen.where(~overlaps).select("row_id", "row_hash", "patterns", whole.alias("word"), "start", "end", seed.alias("seed"))


def confident_patterns(found: DataFrame, learning: Learning) -> DataFrame:
    """pattern, kind, sure of the patterns that the scoring leaves with confidence."""
    edges = found.withColumn("pattern", F.explode("patterns")).groupBy("pattern", "word").agg(F.count("*").alias("n"), *[F.max((F.col("seed") == k).cast("double")).alias(f"seed{k}") for k in range(len(KINDS))])
    edges = edges.select("pattern", "word", "n", *[F.coalesce(f"seed{k}", F.lit(0.0)).alias(f"s{k}") for k in range(len(KINDS))])
    scores = [f"s{k}" for k in range(len(KINDS))]
    seeds = edges.groupBy("word").agg(*[F.max(s).alias(s) for s in scores])
    graph = edges.select("pattern", "word", "n").join(seeds, "word")
    known = reduce(Column.__or__, [F.col(s) > 0 for s in scores])

    def rated(table: DataFrame, names: list[str]) -> DataFrame:
        return table.groupBy("pattern").agg(*[(F.sum(F.col("n") * F.col(s)) / F.sum("n")).alias(f"c{k}") for k, s in enumerate(names)])

    now = graph.select("*", *[F.col(s).alias(f"v{k}") for k, s in enumerate(scores)])
    for _ in range(learning.rounds - 1):
        patterns = rated(now, [f"v{k}" for k in range(len(KINDS))])
        words = graph.join(patterns, "pattern").groupBy("word").agg(*[(F.sum(F.col("n") * F.col(f"c{k}")) / F.sum("n")).alias(f"w{k}") for k in range(len(KINDS))])
        grown = lambda k: F.when(F.col(f"w{k}") >= learning.confidence, 1.0).otherwise(F.col(f"w{k}"))
        now = graph.join(words, "word").select(*graph.columns, *[F.when(known, F.col(s)).otherwise(grown(k)).alias(f"v{k}") for k, s in enumerate(scores)])
    final = now.groupBy("pattern").agg(
        *[(F.sum(F.col("n") * F.col(f"v{k}")) / F.sum("n")).alias(f"c{k}") for k in range(len(KINDS))],
        *[F.sum((F.col(s) > 0).cast("long")).alias(f"n{k}") for k, s in enumerate(scores)],
    )
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"c{k}").alias("c"), F.col(f"n{k}").alias("n")) for k in range(len(KINDS))])).alias("x")
    sure = final.select("pattern", each).where((F.col("x.c") >= learning.confidence) & (F.col("x.n") >= learning.seeds))
    return sure.groupBy("pattern").agg(F.max_by("x.kind", F.struct("x.c", -F.col("x.kind"))).alias("kind"), F.max("x.c").alias("sure"))


def personal_data(df: DataFrame, learning: Learning = Learning(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: key, spans as an array of (kind, start, end, base) in order of kind and start, code points, end exclusive."""
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("text"))
    top = shared_dir(spark, "pii")
    items = found_items(docs)
    items.write.parquet(f"{top}/items")
    items = spark.read.schema(items.schema).parquet(f"{top}/items")
    found = candidates(items)
    patterns = confident_patterns(found, learning)
    enough = (F.length(_digits(F.col("word"))) >= learning.digits) | F.contains("word", F.lit("@"))
    open_ = found.where(F.col("seed").isNull() & enough).withColumn("pattern", F.explode("patterns")).join(patterns, "pattern")
    place = ["row_id", "row_hash", "start", "end"]
    sure = open_.groupBy(*place).agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("kind"))
    # of those that overlap the first one is taken
    before = F.max("end").over(Window.partitionBy("row_id", "row_hash").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    new = sure.withColumn("before", before).where("before IS NULL OR before <= start").select("row_id", "row_hash", "kind", "start", "end", F.lit(False).alias("base"))
    spans = items.where("base").select("row_id", "row_hash", "kind", "start", "end", "base").unionByName(new)
    rows = spans.groupBy("row_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    joined = docs.select("row_id", "row_hash").alias("d").join(rows.alias("r"), F.col("d.row_id").eqNullSafe(F.col("r.row_id")) & (F.col("d.row_hash") == F.col("r.row_hash")), "left")
    return joined.select(F.col("d.row_id").alias(key), F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
