"""Chat logs to formatted conversations, and back (operator 9).

A log is a table of events. They are dealt by conversation and sorted by message and sequence; one pass folds each
message from its events and renders it, so a task holds one message at a time however long its conversation is.

Events, by kind: "start" opens a message with its text, also where one with the same number is open; "delta" adds text;
"edit" replaces the text; "regenerate" empties it, for the deltas of the new answer; "delete" drops the message. Other
kinds, and nulls, change nothing. A delta, edit or regeneration without a start opens the message.

Defined results: a null text or role is empty; null conversations form one conversation; null message numbers come
first; events that are equal in conversation, message and sequence go by kind (start first), role and text, and repeated
events count as often as they stand there. An empty table gives no rows. A conversation whose messages are all deleted
gives no rows. A text of any length is taken whole, in one task. Columns besides those named play no part. Of finished messages with one number the first is that of the
least role, then text; equal ones are all kept.

A formatted turn is TURN, the role, a newline, the text, END and a newline. Inside roles and texts each "<", any number
of backslashes and "|" get one backslash more, so that no control string stands there; reading takes it away again. In a
role backslashes and newlines are written as \\\\ and \\n before that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import small_batches

TURN, END = "<|turn|>", "<|end|>"
KINDS = ("start", "regenerate", "edit", "delta", "delete")
RENDERED = "conv_id long, part long, role string, formatted string, start long, loss_start long, loss_end long"

_ADD, _TAKE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PARTS = re.compile(rf"{re.escape(TURN)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    return _ADD.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _TAKE.sub(r"<\1|", text) if "<" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where the escaped text lies in it."""
    head = f"{TURN}{escape(role.replace('\\', '\\\\').replace(chr(10), '\\n'))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(r)), unescape(t)) for r, t in _PARTS.findall(formatted)]


def rows_as_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The log that would have led to a table with a finished message in each row: a message starts with the first half of
    its text, a draft is streamed and thrown away by a regeneration, and both halves are streamed again; a message of
    another role than the assistant's is edited to its text at last. Messages are numbered anew in each conversation, so
    rows with one number stay apart. The log is dealt by conversation already: give render dealt=True."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role.alias("role"), text.alias("text")).repartition("conv_id")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    said = [("start", first), ("delta", F.lit("(draft)")), ("regenerate", F.lit(None)), ("delta", first), ("delta", rest)]
    steps = [F.struct(F.lit(n).cast("long").alias("seq"), F.lit(kind).alias("kind"), what.cast("string").alias("text")) for n, (kind, what) in enumerate(said)]
    edit = F.struct(F.lit(len(said)).cast("long").alias("seq"), F.lit("edit").alias("kind"), F.col("text").alias("text"))
    every = F.when(F.col("role") == "assistant", F.array(*steps)).otherwise(F.array(*steps[:2], edit))
    numbered = rows.withColumn("message", number)  # before the events are made from it
    return numbered.select("conv_id", "message", "role", F.explode(every).alias("x")).select("conv_id", "message", "x.seq", "x.kind", "role", "x.text")


def render(events: DataFrame, loss_role: str = "assistant", dealt: bool = False) -> DataFrame:
    """dealt: the events are partitioned by conversation already. One row for each final message: its formatted turn, where it starts in the conversation's formatted text, and
    which part of that text (in code points, end exclusive) the loss covers; nulls where it covers none. The rows of a
    conversation are together and in order."""
    small_batches(events.sparkSession)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    rows = events if dealt else events.repartition("conv_id")
    sorted_ = (
        rows.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), F.col("seq").cast("long"), order.cast("int").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .where("kind > 0")
        .sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, conv, message, role, texts, part, at = False, None, None, "", [], 0, 0
        size, first = 0, True

        def close() -> None:
            nonlocal held, part, at, size
            if held:
                formatted, a, b = format_turn(role, "".join(texts))
                covered = role == loss_role
                rows.append((conv, part, role, formatted, at, at + a if covered else None, at + b if covered else None))
                part, at, size, held = part + 1, at + len(formatted), size + len(formatted), False

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for c, m, k, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "message", "kind", "role", "text")), strict=True):
                kind = KINDS[k - 1]
                if first or c != conv:
                    close()
                    first, conv, message, part, at = False, c, m, 0, 0
                elif m != message:
                    close()
                    message = m
                if kind == "start":
                    close()
                    held, role, texts = True, r, [t]
                elif kind == "delete":
                    held, texts = False, []
                else:
                    if not held:
                        held, role, texts = True, r, []
                    if kind != "delta":
                        texts = []
                    if kind != "regenerate":
                        texts.append(t)
                if size > 1 << 20:
                    yield packed()
                    rows.clear()
                    size = 0
        close()
        if rows:
            yield packed()

    names = [x.split()[0] for x in RENDERED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return sorted_.mapInArrow(run, RENDERED)
