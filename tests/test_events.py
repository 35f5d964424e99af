"""Worked examples and properties of the event operators."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import codecs, coercion, protobuf, strings
from tidewheel.functions.granularity import PERIODS, Granularity, finer_or_equal, merged
from tidewheel.operators import intervals, late, sketches, throttle, upsert, windows
from tidewheel.plans.catalog import ORACLES, QUERIES
from tidewheel.sinks import batched
from tidewheel.sources import faker, fieldgen, files

T0 = datetime(1970, 1, 1)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def stream(spark, times):
    return spark.createDataFrame([(i, at(t), "a") for i, t in enumerate(times)], "arrival long, ts timestamp_ntz, k string")


def test_late_rows_by_hand(spark):
    rows = stream(spark, [1000, 5000, 9999, 10000, 9999, 1000, 20000, 19999])
    got = late.late_rows(rows, "arrival", "10 seconds").orderBy("arrival")
    assert [r.arrival for r in got.collect()] == [4, 5, 7]


def test_allowed_lateness_fires_again(spark):
    rows = stream(spark, [1000, 2000, 3000, 10000, 4000, 11999, 5000, 12000, 6000])
    got = late.firings(rows, "arrival", "10 seconds", ["k"], "2 seconds").where(F.col("win_start") == F.lit(T0)).collect()
    assert sorted((r.kind, r.cnt) for r in got) == [("main", 3), ("refire", 4), ("refire", 5)]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_running_max_over_blocks(spark, block):
    values = [5, 1, 7, 2, 9, 9, 3, 12]
    df = spark.createDataFrame(list(enumerate(values)), "o long, v int")
    got = [r.m for r in windows.running(df, "o", F.col("v"), "m", block=block).orderBy("o").collect()]
    assert got == [max(values[:i], default=None) for i in range(len(values))]


def test_count_windows_against_a_fold(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(10)) for i in range(60)]
    df = spark.createDataFrame(rows, "o long, k int, v int")
    held, expected, slid = {}, [], []
    for o, k, v in rows:
        held.setdefault(k, []).append(v)
        if len(held[k]) % 5 == 0:
            expected.append((k, len(held[k]) // 5 - 1, sum(held[k][-5:])))
        if len(held[k]) % 2 == 0:
            slid.append((k, len(held[k]), sum(held[k][-5:])))
    assert sorted(tuple(r) for r in windows.count_window(df, "k", ["o"], 5, [F.sum("v").alias("s")]).collect()) == sorted(expected)
    assert sorted(tuple(r) for r in windows.sliding_count_window(df, "k", ["o"], 5, 2, {"s": F.sum("v")}).collect()) == sorted(slid)


def test_interval_send_strict_keeps_the_distance(spark):
    df = spark.createDataFrame([(i, "k", at(t), float(i)) for i, t in enumerate([0, 400, 1100, 1200, 5000])], "o long, k string, ts timestamp_ntz, v double")
    eager = [(r.sent_us // 1000, r.v) for r in throttle.interval_send(df, "k", "o", "v", 1_000_000).orderBy("sent_us").collect()]
    assert eager == [(0, 0.0), (1000, 1.0), (1100, 2.0), (2100, 3.0), (5000, 4.0)]
    strict = [r.sent_us // 1000 for r in throttle.interval_send(df, "k", "o", "v", 1_000_000, strict=True).orderBy("sent_us").collect()]
    assert all(b - a >= 1000 for a, b in zip(strict, strict[1:], strict=False))
    lazy = [(r.sent_us // 1000, r.v) for r in throttle.interval_send(df, "k", "o", "v", 1_000_000, eager=False).orderBy("sent_us").collect()]
    assert lazy == [(1000, 1.0), (2100, 3.0), (6000, 4.0)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=12))
def test_condense_covers_the_same_points(spans):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([("k", a, a + n) for a, n in spans], "k string, a int, b int")
    got = sorted((r.a, r.b) for r in intervals.condense(df, ["k"], "a", "b").collect())
    assert all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))
    assert {p for a, n in spans for p in range(a, a + n)} == {p for a, b in got for p in range(a, b)}


def test_condense_with_equal_intervals_does_not_depend_on_their_order(spark):
    """Of equal intervals one opens the island; islands counted row by row in another order cut it in two."""
    rows = spark.createDataFrame([("k", a, a + 1) for a in range(0, 3000, 3) for _ in range(7)], "k string, a int, b int")
    assert sorted((r.a, r.b) for r in intervals.condense(rows, ["k"], "a", "b").collect()) == [(a, a + 1) for a in range(0, 3000, 3)]
    sql = ORACLES["interval_condense"]
    assert "RANGE UNBOUNDED PRECEDING" in sql and "ORDER BY a, b ROWS UNBOUNDED" not in sql


def test_varints_of_products_that_wrap_round(spark, tmp_path):
    ids = [0, 1, 2, 3_000_000, 3_037_000, 5_999_998, 5_999_999, (1 << 63) - 1, (1 << 63) - 2, (1 << 62) + 1]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    want = {i: signed(i * i * 1000003 if i % 2 == 0 else -i * 977) for i in ids}
    got = {r.event_id: r for r in QUERIES["varint_roundtrip"](spark, str(tmp_path)).collect()}
    assert {i: r.n for i, r in got.items()} == {i: r.fixed_back for i, r in got.items()} == want
    assert all(r.bytes == max(1, -(-(2 * r.n if r.n >= 0 else -2 * r.n - 1).bit_length() // 7)) for r in got.values())


@pytest.mark.parametrize("period, origin, zone", [("P1M", 1_705_312_800_000_000, "UTC"), ("P1M", 1_706_695_200_000_000, "UTC"), ("P2M", None, "UTC"), ("P1M", None, "Asia/Tokyo"), ("P1M1W", None, "UTC"), ("P1Y", -86_400_000_000, "UTC")])
def test_numbers_of_months_agree_with_their_floors(spark, period, origin, zone):
    g, rng = Granularity.of(period, origin, zone), random.Random(5)
    times = [datetime(1969, 1, 1) + timedelta(seconds=rng.randrange(60 * 365 * 86_400)) for _ in range(300)] + [datetime(2024, 2, 29, 10), datetime(2024, 1, 31, 10), datetime(2023, 2, 28, 10)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    assert df.where(g.start_of(g.number(F.col("ts"))) != g.floor(F.col("ts"))).count() == 0


def test_months_from_an_origin_are_split_in_few_steps(spark):
    """A bucket is worked out once for each row that it gives, not once for each that might be one."""
    df = spark.range(200_000).select((F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 999).cast("int"))).alias("a"))
    began = time.monotonic()
    got = intervals.split_by(df, F.col("a"), F.col("a") + F.expr("INTERVAL '21' DAY"), Granularity.of("P1M", 1_705_312_800_000_000))
    assert got.count() > 300_000 and got.agg(F.count_distinct("bucket").alias("n")).first().n > 30
    assert time.monotonic() - began < 40


@pytest.mark.parametrize("name", sorted(PERIODS))
def test_bucket_holds_its_time(spark, name):
    g = Granularity.of(name)
    times = [datetime(1969, 12, 31, 23, 59, 59), datetime(2024, 2, 29, 12, 34, 56), datetime(2024, 12, 30), datetime(1970, 1, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    start = g.floor(F.col("ts"))
    rows = df.select("ts", start.alias("a"), g.next(start).alias("b"), g.is_aligned(start).alias("ok")).collect()
    assert all(r.a <= r.ts < r.b and r.ok for r in rows)


@pytest.mark.parametrize("period", ["P1M2D", "P2MT12H", "P1Y1D"])
def test_compound_periods_go_step_by_step(spark, period):
    g = Granularity.of(period)
    start, starts, n = datetime(1970, 1, 1), [], 0
    while start < datetime(2030, 1, 1):
        starts.append(start)
        n += 1
        month = n * g.months
        start = datetime(1970 + month // 12, 1 + month % 12, 1) + timedelta(microseconds=n * g.us)
    times = [datetime(1970, 1, 1), datetime(1999, 12, 31, 23), datetime(2024, 2, 29, 12), datetime(2024, 3, 1), datetime(2028, 7, 4)] + starts[5:400:40]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    for r in df.select("ts", g.floor(F.col("ts")).alias("a"), g.next(g.floor(F.col("ts"))).alias("b")).collect():
        k = max(i for i, x in enumerate(starts) if x <= r.ts)
        assert (r.a, r.b) == (starts[k], starts[k + 1])


@pytest.mark.parametrize(("period", "origin"), [("P1M", datetime(2024, 1, 15, 10)), ("P1M", datetime(2023, 1, 31, 23, 59)), ("P3M", datetime(2024, 2, 29, 1)), ("P1Y", datetime(2024, 2, 29))])
def test_months_from_an_origin(spark, period, origin):
    g = Granularity.of(period, int((origin - T0).total_seconds()) * 1_000_000)
    times = [origin + timedelta(days=d, hours=h) for d in (-800, -31, -1, 0, 1, 27, 28, 29, 30, 31, 32, 59, 366, 700) for h in (-11, 0, 3)] + [datetime(2024, 2, 15, 1), datetime(2024, 2, 15, 10)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")

    def start(n):
        month = origin.month - 1 + n * g.months
        year, month = origin.year + month // 12, month % 12 + 1
        last = (datetime(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day
        return origin.replace(year=year, month=month, day=min(origin.day, last))

    for r in df.select("ts", g.floor(F.col("ts")).alias("a"), g.next(g.floor(F.col("ts"))).alias("b")).collect():
        n = max(n for n in range(-60, 60) if start(n) <= r.ts)
        assert (r.a, r.b) == (start(n), start(n + 1))


def test_durations_keep_their_milliseconds(spark):
    df = spark.createDataFrame([(at(1234),), (at(-1),)], "ts timestamp_ntz")
    half = Granularity.of('{"type": "duration", "duration": 500, "origin": 100}')
    assert [r.a for r in df.select(half.floor(F.col("ts")).alias("a")).collect()] == [at(1100), at(-400)]
    assert Granularity.of('{"type": "period", "period": "P1M", "origin": "2024-01-15T10:00:00Z"}').origin == 1_705_312_800_000_000
    for bad in ('{"type": "duration", "duration": 0}', "PT0S", "P0M"):
        with pytest.raises(ValueError):
            Granularity.of(bad)


def test_granularity_rules():
    hour, day = Granularity.of("HOUR"), Granularity.of("DAY")
    assert hour.is_finer_than(day) and not day.is_finer_than(hour)
    assert Granularity.of("PT60S") != Granularity.of("PT1M")
    assert finer_or_equal(hour)[0] == hour and merged([hour, hour]) == hour and merged([hour, day]) is None
    with pytest.raises(ValueError):
        Granularity.of("P")


def test_sketches(spark):
    df = spark.range(50_000).select((F.col("id") % 20_000).alias("v"), F.lit("k").alias("k"))
    states = sketches.hll_states(df, [F.col("k"), (F.col("v") % 7).alias("part")], "v")
    assert abs(sketches.hll_merge(states, [F.col("k")]).first().approx_distinct - 20_000) < 800


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "c", 5), (3, None, 7), (2, "gone", 9)], "id int, x string, y int")
    got = {r.id: (r.x, r.y) for r in upsert.merge(old, new, ["id"], keep_old=["y"], delete=F.col("x") == "gone").collect()}
    assert got == {1: ("c", 5), 3: (None, 7)}


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.text(max_size=40) | st.binary(max_size=300) | st.floats(allow_nan=False), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=4), x, max_size=20), max_leaves=20))
def test_msgpack_round_trip(value):
    assert codecs.unmsgpack(codecs.msgpack(value)) == value


def test_number_codecs(spark):
    numbers = [0, 1, -1, 127, 128, 300, -300, 2**31, -(2**31), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    n = F.col("n")
    rows = df.select("n", codecs.varint(n).alias("v"), codecs.unzigzag(codecs.from_varint(codecs.varint(codecs.zigzag(n)))).alias("z"), codecs.from_fixed(codecs.fixed(n, 8), 8).alias("f"), codecs.from_fixed(codecs.fixed(n, 4, False), 4, False).alias("low")).collect()
    for r in rows:
        x, out = r.n % (1 << 64), bytearray()
        while True:
            out.append((x & 127) | (128 if x > 127 else 0))
            x >>= 7
            if not x:
                break
        assert bytes(r.v) == bytes(out) and r.z == r.n == r.f and r.low == r.n % (1 << 32)


def test_protobuf_modes(spark):
    schema = [("a", 1, "int32", "singular"), ("b", 2, "string", "optional"), ("c", 3, "int64", "repeated"), ("d", 4, "bool", "singular")]
    cls = protobuf.message_class(schema)
    full = cls(a=5, b="", c=[1, -2], d=True).SerializeToString()
    df = spark.createDataFrame([(bytearray(full),), (bytearray(b""),), (bytearray(b"\xff\xff"),), (None,)], "raw binary")
    rows = [r[0] for r in df.select(protobuf.decode(F.col("raw"), schema)).collect()]
    assert (rows[0].a, rows[0].b, rows[0].c, rows[0].d) == (5, "", [1, -2], True)
    assert all(v is None for r in rows[1:] for v in r)
    plain = df.limit(2).select(protobuf.decode(F.col("raw"), schema, defaults=True)).collect()[1][0]
    assert (plain.a, plain.b, plain.c, plain.d) == (0, None, [], False)
    with pytest.raises(Exception):
        df.select(protobuf.decode(F.col("raw"), schema, fail=True)).collect()


def test_protobuf_descriptor_sets(spark):
    from google.protobuf import descriptor_pb2

    schema = [("id", 1, "uint32", "singular"), ("kind", 2, {"NONE": 0, "SOME": 3}, "singular"), ("inner", 3, [("s", 1, "string", "optional"), ("n", 2, "sint64", "repeated")], "repeated"), ("big", 4, "fixed64", "singular"), ("gone", 5, [("x", 1, "bool", "singular")], "singular")]
    cls = protobuf.message_class(schema)
    file = descriptor_pb2.FileDescriptorProto()
    cls.DESCRIPTOR.file.CopyToProto(file)
    told = protobuf.schema_of(descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString(), "tidewheel.Row")
    assert [(f, n, label) for f, n, _, label in told] == [(f, n, label) for f, n, _, label in schema] and told[2][2] == schema[2][2] and set(told[1][2].values()) == {0, 3}
    row = {"id": 4_000_000_000, "kind": "SOME", "inner": [{"s": "a", "n": [-5, 7]}, {}], "big": -1, "gone": None}
    raw = protobuf.write(cls, schema, row)
    read = lambda raw, defaults=False: protobuf.read_column(pa.array([raw]), schema, True, defaults).to_pylist()[0]
    assert read(raw) == {"id": 4_000_000_000 - (1 << 32), "kind": "SOME", "inner": [{"s": "a", "n": [-5, 7]}, {"s": None, "n": None}], "big": -1, "gone": None}
    assert read(raw, True)["inner"][1] == {"s": None, "n": []}
    assert read(protobuf.write(cls, schema, {"id": "12", "kind": 3, "big": "9"})) == {"id": 12, "kind": "SOME", "inner": None, "big": 9, "gone": None}
    assert protobuf.write(cls, schema, None) is None


def test_json_rows(spark):
    texts = ['{"a": "7", "b": {"x": 1}, "z": 0}', "{'a': 8, 'b': 'q'}", '{"a": "no number", "b": "q"}', "[1]", "{broken", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.x.a, r.x.b) for r in df.select("i", coercion.json_row(F.col("t"), "a int, b string").alias("x")).collect()}
    assert got == {0: (7, '{"x":1}'), 1: (8, "q"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_coercion(spark):
    df = spark.createDataFrame([("300", "2024-01-02 03:04:05"), ("-129", "short"), ("1e3x", None), (None, "2024-01-02T03:04:05.678")], "n string, t string")
    rows = df.select(coercion.number(F.col("n"), "tinyint").alias("n"), coercion.text_time(F.col("t")).alias("t"), coercion.with_default(F.col("t"), "string").alias("d")).collect()
    assert [r.n for r in rows] == [44, 127, 0, 0]
    assert [r.t for r in rows] == [datetime(2024, 1, 2, 3, 4, 5), None, None, datetime(2024, 1, 2, 3, 4, 5, 678000)]
    assert rows[2].d == ""
    times = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,)], "n long").select(coercion.epoch_time(F.col("n")).alias("t")).collect()
    assert [r.t.year for r in times] == [2023, 2023]


def test_chop_counts_bytes(spark):
    texts = ["plain", "żółw", "日本語", "a😀b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for most in range(0, 12):
        for r in df.select("s", strings.chop(F.col("s"), most).alias("c")).collect():
            assert r.c == max((r.s[:k] for k in range(len(r.s) + 1) if len(r.s[:k].encode()) <= most), key=len)


def test_faker(spark):
    options = {"fields.a.expression": "#{number.numberBetween '3','6'}", "fields.b.expression": "#{regexify '[xy]{3}'}", "fields.b.null-rate": "0.5", "number-of-rows": "400", "seed": "1"}
    rows = faker.scan(spark, "a int, b string", options).collect()
    assert len(rows) == 400 and {r.a for r in rows} == {3, 4, 5}
    assert 120 < sum(r.b is None for r in rows) < 280 and all(set(r.b) <= set("xy") for r in rows if r.b)
    assert sorted(map(str, rows)) == sorted(map(str, faker.scan(spark, "a int, b string", options).collect()))
    with pytest.raises(Exception):
        faker.scan(spark, "a int", {"number-of-rows": "1"}).collect()
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW fk (a INT) USING faker OPTIONS ('fields.a.expression' \"#{number.numberBetween '1','2'}\", 'number-of-rows' '7')")
    assert spark.sql("SELECT sum(a) AS s FROM fk").first().s == 7


def test_faker_rejects_what_it_cannot_make(spark):
    for kind in ("interval day", "variant"):
        with pytest.raises(Exception):
            faker.scan(spark, f"a {kind}", {"fields.a.expression": "1", "number-of-rows": "1"}).collect()
    with pytest.raises(Exception):
        faker.scan(spark, "a tinyint", {"fields.a.expression": "300", "number-of-rows": "1"}).collect()


def test_faker_stream(spark):
    from tidewheel.streaming.drain import drain

    spark.dataSource.register(faker.Faker)
    options = {"fields.a.expression": "#{number.numberBetween '3','6'}", "number-of-rows": "1000", "seed": "1"}
    rows = drain(spark.readStream.format("faker").schema("a int").options(**options).load())
    assert rows.count() == 1000 and {r.a for r in rows.distinct().collect()} == {3, 4, 5}
    clock = faker.FakerStream(faker.Fields(rows.schema, {"fields.a.expression": "1", "rows-per-second": "5"}))
    first = clock.initialOffset()["row"]
    assert 0 <= clock.latestOffset()["row"] - first <= 50 and [(p.start, p.end) for p in clock.partitions({"row": 10}, {"row": 15})] == [(10, 11), (11, 12), (12, 13), (13, 15)]


def test_fieldgen_json_leaves_out_nulls(spark):
    spec = '[{"type": "int_random", "fields": {"name": "n", "start": 1, "end": 2, "null_ratio": 1.0}}, {"type": "long_inc", "fields": {"name": "i", "start": 0}}]'
    assert [r.value for r in fieldgen.generate(spark, spec, 2, as_json=True).collect()] == ['{"i":0}', '{"i":1}']


def test_text_and_records(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"  one \n\nabcd\nlast")
    assert [r.value for r in files.text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "abcd", "last"]
    assert [r.value for r in files.text_lines(spark, str(tmp_path / "t.txt"), trim=False, least_bytes=5).collect()] == ["  one "]


def test_batched_writes():
    rows = [{"k": i % 3, "v": i} for i in range(7)]
    assert [len(b) for b in batched.flushes(rows, batched.Batching(rows=3))] == [3, 3, 1]
    assert list(batched.flushes(rows, batched.Batching(rows=5, key=lambda r: r["k"]))) == [[{"k": 0, "v": 6}, {"k": 1, "v": 4}, {"k": 2, "v": 5}]]
    tries = []

    def open_writer():
        def write(batch):
            tries.append(len(batch))
            if len(tries) in (1, 2):
                raise OSError

        return write

    assert batched.write_partition(rows, open_writer, batched.Batching(rows=4)) == {"in": 7, "out": 7, "dropped": 0, "errors": 2, "flushes": 2}
    fails = batched.write_partition(rows, lambda: lambda b: 1 / 0, batched.Batching(rows=4, drop_failed=True))
    assert fails == {"in": 7, "out": 0, "dropped": 7, "errors": 6, "flushes": 0}
    assert batched.upsert_sql("t", ["id", "x"], ["x"], ["id"]) == "INSERT INTO t(id, x) VALUES(?, ?) ON DUPLICATE KEY UPDATE x=IFNULL(x,VALUES(x))"


def test_flushes_by_size_time_and_pause():
    rows = [{"k": i % 2, "v": "x" * 10} for i in range(10)]
    by_size = batched.Batching(size=25, size_of=lambda r: len(r["v"]))
    assert [len(b) for b in batched.flushes(rows, by_size)] == [3, 3, 3, 1]
    keyed = batched.Batching(size=15, size_of=lambda r: len(r["v"]), key=lambda r: r["k"])
    assert [len(b) for b in batched.flushes(rows, keyed)] == [2] * 5
    now, slept = [0.0], []

    def tick():
        now[0] += 0.25
        return now[0]

    def sleep(n):
        slept.append(n)
        now[0] += n

    timed = batched.Batching(interval_seconds=1.0, pause_seconds=3.0, clock=tick, sleep=sleep)
    sizes = [len(b) for b in batched.flushes(rows, timed)]
    assert sum(sizes) == 10 and len(sizes) > 2 and len(slept) == len(sizes) - 1


def test_hosts_deletes_and_counts(spark, tmp_path):
    from tidewheel.sinks import connectors

    done = []
    write = batched.saves_then_deletes(lambda b: done.append(("save", len(b))), lambda b: done.append(("delete", len(b))), lambda r: r["gone"])
    batched.write_partition([{"id": i, "gone": i == 2} for i in range(5)], lambda: write, batched.Batching(rows=3))
    assert done == [("save", 2), ("delete", 1), ("save", 2)]
    period, ran = connectors.Period(lambda now: ["s"], 10, execute=lambda x: ran.append(x)), []
    batched.write_partition([{"id": i} for i in range(4)], lambda: lambda b: None, batched.Batching(rows=1), period)
    assert ran == ["s"]
    opened = batched.over_hosts(["a", "b", "c"], lambda host: host)
    assert sorted([opened(), opened(), opened()]) == ["a", "b", "c"]
    folder = str(tmp_path)

    def connect(host):
        def put(batch):
            if host == "bad":
                raise OSError(host)
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(str(r["id"]) for r in batch))

        return put

    sink = connectors.ClickHouse("t", ["bad", "good"], batch_rows=30)
    seen = sink.write(spark.range(100).repartition(2), connect)
    assert seen["in"] == seen["out"] == 100 and seen["dropped"] == 0 and seen["errors"] <= seen["flushes"]
    assert sorted(int(x) for f in tmp_path.iterdir() for x in f.read_text().split()) == list(range(100))
    with pytest.raises(Exception):
        connectors.ClickHouse("t", ["bad"]).write(spark.range(3), connect)
    assert connectors.ClickHouse("t", ["bad"]).write(spark.range(3), connect, drop_failed=True)["dropped"] == 3


def test_times(spark):
    from tidewheel.functions import times

    texts = ["2024-02-29T12:00:00.500Z", "2024-02-29T12:00:00+08:00", "2024-02-29T12:00:00", "2024-02-29", "1709208000500", "-1", "soon", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(times.instant(F.col("s")).alias("t")).collect()]
    noon = datetime(2024, 2, 29, 12)
    assert got == [noon + timedelta(milliseconds=500), noon - timedelta(hours=8), noon, datetime(2024, 2, 29), noon + timedelta(milliseconds=500), T0 - timedelta(milliseconds=1), None, None]
    assert (times.zone_of("Asia/Shanghai"), times.zone_of("+08:00"), times.zone_of("Nowhere/Land")) == ("Asia/Shanghai", "+08:00", "UTC")
    with pytest.raises(ValueError):
        times.zone_of("Nowhere/Land", fallback=False)
    cases = [("2024-01-31", "2024-02-29", 1), ("2024-01-31 10:00:00", "2024-02-29 09:00:00", 0), ("2024-03-15", "2024-01-15", -2), ("2024-03-15", "2024-01-16", -1), ("2024-01-01", "2024-01-01", 0), ("2024-02-29", "2025-02-28", 12)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert [r.m for r in df.select(times.months_apart(F.col("a"), F.col("b")).alias("m")).collect()] == [c[2] for c in cases]


def test_json_checked(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ('{"a": 1}',), ('{"a": "x", "b": 1}',), ("[1]",), (None,)], "t string")
    got = [r[0] for r in df.select(coercion.json_checked(F.col("t"), "a int, b int", ignore_errors=True)).collect()]
    assert [None if x is None else tuple(x) for x in got] == [(1, None), (1, None), None, None, None]
    got = [r[0] for r in df.select(coercion.json_checked(F.col("t"), "a int, b int", True, True)).collect()]
    assert [x is not None for x in got] == [True, False, False, False, False]
    assert df.limit(2).select(coercion.json_checked(F.col("t"), "a int, b int")).count() == 2
    for rows, strict in ((df.limit(2), True), (df.where("t LIKE '[%'"), False)):
        with pytest.raises(Exception):
            rows.select(coercion.json_checked(F.col("t"), "a int, b int", strict)).collect()


def test_hours_and_days_of_the_same_users(spark):
    """Three users in each hour, four in each day: states of hours, merged, count as the rows do."""
    rows = [(datetime(2024, 1, day, hour), user) for day in (25, 26) for hour, users in ((13, (1, 2, 3)), (14, (2, 3, 4))) for user in (*users, *users)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, user long")
    states = sketches.hll_states(df, [F.date_trunc("hour", "ts").alias("hour")], "user")
    assert [r.approx_distinct for r in sketches.hll_merge(states, [F.col("hour")]).collect()] == [3, 3, 3, 3]
    assert [r.approx_distinct for r in sketches.hll_merge(states, [F.date_trunc("day", "hour").alias("day")]).collect()] == [4, 4]


def test_reloading_table():
    clock, reads = [0.0], []
    held = files.Reloading(lambda: reads.append(1) or len(reads), interval=10, clock=lambda: clock[0])
    assert held.get() == 1 and held.get() == 1
    clock[0] = 11
    assert held.get() == 2


def test_connector_options():
    from tidewheel.sinks import connectors

    c = connectors.ClickHouse.of({"table": "t", "host": "a, b", "batch.byte.size": "10kb", "batch.interval": "5s", "connection.user": "u"})
    assert (c.hosts, c.batch_bytes, c.interval_seconds, c.connection, c.batching().drop_failed) == (["a", "b"], 10 << 10, 5, {"user": "u"}, False)
    assert (c.batching().size, c.batching().interval_seconds) == (10 << 10, 5)
    for bad in ({"table": "t"}, {"table": "t", "host": "a", "x": "1"}, {"table": "t", "host": "a", "batch.byte.size": "1000mb"}, {"table": "t", "host": "a", "batch.interval": "soon"}):
        with pytest.raises(ValueError):
            connectors.ClickHouse.of(bad)
    load = connectors.StreamLoad("t", "p", ["a"], derived={"b": "from_unixtime(a)"})
    assert load.headers(3)["columns"] == "a,b=from_unixtime(a)" and load.headers(3)["label"] == "p-3"
    with pytest.raises(ValueError):
        connectors.StreamLoad("t", "p", ["a"], "arrow", {"b": "a"}).headers(1)
    side = connectors.Period(lambda now: [f"at {now}"], 10)
    assert [side.due(t) for t in (0, 5, 10)] == [["at 0"], [], ["at 10"]]


def test_python_functions(spark):
    from tidewheel.functions import udfs

    df = spark.createDataFrame([("x", 1.0), ("y", None), ("x", 2.0)], "k string, v double")
    a, b = udfs.with_constant("-a"), udfs.with_constant("-b")
    assert df.select(a(F.col("k")), b(F.col("k"))).first() == ("x-a", "x-b")
    with pytest.raises(TypeError):
        udfs.with_constant(3)
    assert {r.k: r.m for r in df.groupBy("k").agg(udfs.mean(F.col("v")).alias("m")).collect()} == {"x": 1.5, "y": None}
    udfs.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT w.place, w.word FROM VALUES ('one two') AS t(s), LATERAL words_at(s) AS w ORDER BY 1").collect()] == [(0, "one"), (1, "two")]
    df.createOrReplaceTempView("udf_rows")
    assert spark.sql("SELECT mean_of(v) AS m FROM udf_rows").first().m == 1.5
