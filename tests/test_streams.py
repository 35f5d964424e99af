"""Late windows, the union join, and the committing sink against plain replays."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewheel.session import shared_dir
from tidewheel.sinks import committed, trial
from tidewheel.streaming import drain
from tidewheel.streaming.lateness import LateWindows
from tidewheel.streaming.state import Reminders, UnionJoin

# late windows


def replay(rows, size, lateness):
    """rows: (arrival, seconds, key). Results (key, start, kind, count), and arrivals of late rows."""
    mark, held, fired, out, late = None, {}, set(), [], []
    for arrival, t, key in rows:
        start = t // size * size
        if mark is not None and mark >= start + size + lateness:
            late.append(arrival)
        else:
            held[key, start] = held.get((key, start), 0) + 1
            if mark is not None and mark >= start + size:
                out.append((key, start, "refire", held[key, start]))
        mark = t if mark is None else max(mark, t)
        for (k, s), n in held.items():
            if (k, s) not in fired and s + size <= mark:
                fired.add((k, s))
                out.append((k, s, "main", n))
    return sorted(out), late, sorted(out + [(k, s, "main", n) for (k, s), n in held.items() if (k, s) not in fired])


def replayed(rows, size, lateness):
    """As replay, where a window whose first row is late has no main result."""
    out, late, whole = replay(rows, size, lateness)
    first = {}
    mark = None
    for _, t, key in rows:
        start = t // size * size
        first.setdefault((key, start), mark is None or mark < start + size)
        mark = t if mark is None else max(mark, t)
    keep = lambda found: [x for x in found if x[2] != "main" or first[x[0], x[1]]]
    return keep(out), late, keep(whole)


def stream_of(spark, rows, cuts, size, lateness, again=()):
    windows = LateWindows(shared_dir(spark, "late-test"), f"{size} seconds", f"{lateness} seconds", ["key"], "arrival")
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = spark.createDataFrame(rows[a:b], "arrival long, s long, key string").select("arrival", "key", F.timestamp_seconds("s").alias("ts"))
        for _ in range(2 if n in again else 1):
            windows(part, n)
    take = lambda df: sorted((r.key, int(r.win_start.timestamp()), r.kind, r.cnt) for r in df.collect())
    return take(windows.results(spark)), sorted(r.arrival for r in windows.late(spark).collect()), take(windows.results(spark, ended=True))


def test_allowed_lateness_worked_example(spark):
    """Windows of ten seconds that stay for two: each late row fires its key's window again, until the watermark is at 12."""
    times = [(1, "a"), (2, "a"), (9, "a"), (10, "a"), (9, "a"), (9, "b"), (9, "a"), (11, "a"), (1, "a"), (11, "a"), (1, "a"), (12, "a"), (1, "a"), (9, "a")]
    rows = [(n, t, k) for n, (t, k) in enumerate(times)]
    fired, late, _ = stream_of(spark, rows, [4, 9], 10, 2)
    assert fired == sorted([("a", 0, "main", 3), ("a", 0, "refire", 4), ("b", 0, "refire", 1), ("a", 0, "refire", 5), ("a", 0, "refire", 6), ("a", 0, "refire", 7)])
    assert late == [12, 13]


@pytest.mark.parametrize("seed", range(3))
def test_late_windows_against_a_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(n, max(0, n // 2 + rng.choice([0, 0, 1, 3, -4, -9, -30])), rng.choice("abc")) for n in range(150)]
    cuts = sorted(rng.sample(range(1, 150), 4))
    assert stream_of(spark, rows, cuts, 10, 4, again={1, 3}) == tuple(replayed(rows, 10, 4))


def test_late_windows_have_tasks_by_their_rows(spark):
    """Not one for each of the session's shuffle partitions, for each shuffle and each table written."""
    rows = spark.range(400).select(F.col("id").alias("arrival"), F.timestamp_seconds(F.col("id") * 7 % 200).alias("ts"), F.lit("a").alias("key"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    try:
        top = shared_dir(spark, "late-tasks")
        windows = LateWindows(top, "10 seconds", "5 seconds", ["key"], "arrival")
        run = drain.run_batches(drain.arriving(rows, "arrival", 2), windows, f"{top}/c")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(str(run.runId)) for s in tracker.getJobInfo(job).stageIds}
    tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    assert len(tasks) > 10 and max(tasks) <= 8


# the union join


class States:
    """Value states and timers as a processor's handle has them, in memory."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        states = self.values

        class Value:
            def exists(self):
                return name in states

            def get(self):
                return states[name]

            def update(self, v):
                states[name] = v

            def clear(self):
                states.pop(name, None)

        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Due:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


def joined(rows, cuts, **options):
    """Runs rows (o, is_left, v, us) of one key in batches; timers fire between batches as the watermark follows."""
    join, handle, out = UnionJoin("o", "left", "v", "us", **options), States(), []
    join.init(handle)
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        if a < b:
            out += list(join.handleInputRows((1,), iter([pd.DataFrame(rows[a:b], columns=["o", "left", "v", "us"])]), None))
        mark = rows[b - 1][3] // 1000 if b < len(rows) else 1 << 60
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            out += list(join.handleExpiredTimer((1,), None, Due(at)))
    table = pd.concat(out)
    assert not handle.timers
    return [tuple(None if pd.isna(x) else x for x in r) for r in table[["kind", "o", "at_us", "left_value", "right_value"]].itertuples(index=False)]


def join_replay(rows, delay_us=None, ttl_us=None, replace=lambda new, old: (True, True), find=lambda: None):
    held, timer, out = {}, None, []
    live = lambda side, now: held[side][0] if side in held and (ttl_us is None or now - held[side][1] < ttl_us) else None

    def fire():
        a, b = live(True, timer), live(False, timer)
        if a is None or b is None:
            if b is None and (b := find()) is not None:
                held[False] = (b, timer)
            out.append(("timeout", None, timer, a, b))

    for o, left, v, now in [*rows, (None, None, None, 1 << 60)]:
        if timer is not None and timer < now:
            fire()
            timer = None
        if o is None:
            break
        old = live(left, now)
        keep, handle = replace(v, old) if old is not None else (True, True)
        if keep:
            held[left] = (v, now)
        if keep and handle:
            other = live(not left, now)
            if other is not None:
                out.append(("pair", o, now, *((v, other) if left else (other, v))))
                timer = None
            elif timer is None and delay_us is not None:
                timer = now + delay_us
    return out


@pytest.mark.parametrize("options", [{}, {"delay_us": 5_000_000}, {"delay_us": 3_000_000, "ttl_us": 4_000_000}, {"ttl_us": 2_000_000}])
def test_union_join_against_a_replay(options):
    for seed in range(60):
        rng, at, rows = random.Random(seed), 0, []
        for o in range(rng.randint(1, 30)):
            at += rng.choice([0, 1, 700_000, 3_000_000, 9_000_000])
            rows.append((o, rng.random() < 0.8, float(o), at))
        cuts = sorted(rng.sample(range(len(rows)), min(3, len(rows) - 1)))
        assert joined(rows, cuts, **options) == join_replay(rows, **options)
        larger = lambda new, old: (new % 3 != 0, new % 2 == 0)
        hooks = {"replace_left": larger, "replace_right": larger, "find_right": lambda key: 99.0}
        assert joined(rows, cuts, **options, **hooks) == join_replay(rows, **options, replace=larger, find=lambda: 99.0)


def test_union_join_reads_and_writes_a_key_once_for_a_batch():
    join, handle = UnionJoin("o", "left", "v", "us", delay_us=5), States()
    join.init(handle)
    rows = pd.DataFrame([(0, True, 1.0, 0), (1, False, 2.0, 3), (2, False, 3.0, 9)], columns=["o", "left", "v", "us"])
    assert len(next(iter(join.handleInputRows((1,), iter([rows]), None)))) == 2
    assert len(handle.values) == 1


def test_arriving_deals_the_rows_in_one_pass(spark):
    """df is looked through for its bounds and once more, however many micro-batches there are."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(5, 905).mapInArrow(look, "id long")
    stream = drain.arriving(df, "id", parts=9)
    assert seen.value <= 2 * 900
    order = []
    drain.run_batches(stream, lambda b, n: order.append((n, b.agg(F.min("id"), F.max("id"), F.count("*")).first()[:])), f"{shared_dir(spark, 'one-pass')}/c")
    assert order == [(n, (5 + 100 * n, 104 + 100 * n, 100)) for n in range(9)]


def test_arriving_gives_each_micro_batch_several_files(spark):
    """As many for each, also where few rows or none are; the last row of a stream that ends has its own."""
    ids = [*range(200), *range(300, 303), *range(390, 600)]
    df = spark.createDataFrame([(i, None) for i in ids], "id long, ts timestamp")
    stream = drain.arriving(df, "id", parts=6, end="ts", each=20).withColumn("file", F.input_file_name())
    got = {}

    def put(batch, number):
        rows = batch.collect()
        got[number] = (sorted(r.id for r in rows if r.id is not None), len(rows), len({r.file for r in rows}))

    drain.run_batches(stream, put, f"{shared_dir(spark, 'several-files')}/c")
    for n in range(6):
        mine = [i for i in ids if n * 100 <= i < n * 100 + 100]
        assert got[n][:2] == (mine, len(mine))
        assert len(mine) < 100 or got[n][2] == 4
    assert got[6] == ([], 1, 1) and len(got) == 7


def test_union_join_forgets_after_its_ttl():
    rows = [(0, True, 1.0, 0), (1, False, 2.0, 1_000_000), (2, True, 3.0, 10_000_000)]
    assert joined(rows, [], ttl_us=5_000_000) == [("pair", 1, 1_000_000, 1.0, 2.0)]
    assert joined(rows, [1, 2]) == [("pair", 1, 1_000_000, 1.0, 2.0), ("pair", 2, 10_000_000, 3.0, 2.0)]


# reminders


class Chunks(States):
    """With a map state; calls: how often it was asked or told something."""

    def __init__(self):
        super().__init__()
        self.chunks, self.calls = {}, 0

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def updateValue(self, k, v):  # noqa: N802
        self.chunks[k] = v
        self.calls += 1

    def getValue(self, k):  # noqa: N802
        self.calls += 1
        return self.chunks[k]

    def removeKey(self, k):  # noqa: N802
        del self.chunks[k]
        self.calls += 1

    def registerTimer(self, at):  # noqa: N802
        super().registerTimer(at)
        self.calls += 1


class Mark(Due):
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_reminders_come_once_when_they_are_due(most):
    for seed in range(40):
        rng = random.Random(seed)
        rows = [(rng.randrange(n, n + 40), float(n)) for n in range(80)]
        cuts, mark, got = sorted(rng.sample(range(1, 80), 6)), -1, []
        each, handle = Reminders(25, "ms", "v", most), Chunks()
        each.init(handle)
        for a, b in zip([0, *cuts], [*cuts, 80], strict=True):
            got += list(each.handleInputRows((1,), iter([pd.DataFrame(rows[a:b], columns=["ms", "v"])]), None))
            mark = max(mark, *(ms for ms, _ in rows[a:b]))
            while due := [t for t in handle.timers if t <= mark]:
                got += list(each.handleExpiredTimer((1,), Mark(mark), Due(min(due))))
                handle.timers.discard(min(due))
            put = sorted(r for part in got for r in part[["due_ms", "v"]].itertuples(index=False, name=None))
            assert put == sorted((ms + 25, v) for ms, v in rows[:b] if ms + 25 <= mark)


def test_reminders_ask_the_state_by_key_and_not_by_row():
    each, handle = Reminders(10, "ms", "v"), Chunks()
    each.init(handle)
    list(each.handleInputRows((1,), iter([pd.DataFrame({"ms": range(1000), "v": 1.0})]), None))
    assert len(handle.timers) == 1
    assert len(pd.concat(each.handleExpiredTimer((1,), Mark(5000), Due(10)))) == 1000
    assert handle.calls <= 4 and not handle.chunks


# the committing sink


def files_of(path):
    store, top = fs.FileSystem.from_uri(path)
    return {x.base_name for x in store.get_file_info(fs.FileSelector(f"{top}/data"))}


@pytest.mark.parametrize("stop", [{"before": "1"}, {"after": "1"}])
def test_a_stream_that_stops_gives_each_row_once(spark, stop):
    rows = spark.range(300).withColumn("v", F.col("id") * 2)
    stream = drain.arriving(rows, "id", 4)
    top = shared_dir(spark, "stop-test")
    with pytest.raises(StreamingQueryException):
        drain.run_into(stream, f"{top}/t", f"{top}/c", trial.Stopping, **stop)
    seen = committed.numbers(f"{top}/t")
    assert seen == ([0] if "before" in stop else [0, 1])
    drain.run_into(stream, f"{top}/t", f"{top}/c")
    got = committed.read(spark, f"{top}/t")
    assert sorted(r.id for r in got.collect()) == list(range(300)) and got.dtypes == rows.dtypes
    named = {f.split("/")[1] for e in committed.entries(f"{top}/t") for f in e["files"]}
    assert named == files_of(f"{top}/t")  # nothing is left of the batch that ran twice


def test_batches_of_a_committed_table(spark):
    path = shared_dir(spark, "table-test")
    df = spark.range(2500).repartition(2)
    spark.dataSource.register(committed.Committed)
    df.write.format("committed").mode("append").option("path", path).option("rows", 1000).option("tops", "id").save()
    assert len(files_of(path)) == 4 and committed.entries(path)[0]["rows"] == 2500
    committed.append(spark.range(10), path, 1, ["id"])
    committed.append(spark.range(99), path, 1, ["id"])  # that batch is there
    committed.append(spark.range(0), path, tops=["id"])
    assert committed.numbers(path) == [0, 1, 2] and committed.read(spark, path, first=1).count() == 10
    assert committed.top_before(path, "id", 0) is None and committed.top_before(path, "id", 3) == 2499
    table = committed.Table(df.schema, {"path": path})
    kept = [committed.Written([f]) for f in committed.entries(path, 1, 1)[0]["files"]]
    table.drop(kept, 1)  # an abort after the commit
    assert committed.read(spark, path).count() == 2510
    committed.forget(path, 1)
    assert committed.read(spark, path).count() == 10
    with pytest.raises(ValueError):
        committed.read(spark, shared_dir(spark, "none"))
    assert committed.read(spark, shared_dir(spark, "none"), "id long").count() == 0
