"""Sockets that break off, replays, and sources of elements."""

from __future__ import annotations

import socket
import threading
import time

import pytest

from tidewheel.operators import partition
from tidewheel.session import shared_dir
from tidewheel.sinks import batched
from tidewheel.sources import custom, faker, fieldgen, sockets


class Server(threading.Thread):
    """Sends one text for each connection and closes it."""

    def __init__(self, *texts):
        super().__init__(daemon=True)
        self.texts, self.listener = texts, socket.create_server(("127.0.0.1", 0))
        self.port = self.listener.getsockname()[1]

    def run(self):
        for text in self.texts:
            connection, _ = self.listener.accept()
            with connection:
                for i in range(0, len(text), 7):
                    connection.sendall(text[i : i + 7])
                    time.sleep(0.001)
        self.listener.close()


def until(done, seconds=60):
    end = time.monotonic() + seconds
    while not done():
        assert time.monotonic() < end, "took too long"
        time.sleep(0.05)


def test_records_by_any_delimiter_over_broken_connections():
    server = Server(b"a|bb||c\nc|half", b"d|", b"\xff\x00|e|")
    server.start()
    c = sockets.Connection("127.0.0.1", server.port, ord("|"), 0.05, 1 << 20)
    c.start()
    got = []

    def all_there():
        got.extend(c.take())
        return len(got) >= 7

    until(all_there)
    c.stop()
    assert got == [b"a", b"bb", b"", b"c\nc", b"d", b"\xff\x00", b"e"] and c.broken == 1


def test_the_sender_waits_for_a_slow_reader():
    server = Server(b"x" * 99 + b"\n", b"y" * 99 + b"\n")
    server.start()
    c = sockets.Connection("127.0.0.1", server.port, 10, 0.01, 50)
    c.start()
    until(lambda: c.held)
    time.sleep(0.3)
    assert len(c.held) == 1 and c.take() == [b"x" * 99]
    until(lambda: c.held)
    c.stop()


def reader_of(server, spool):
    return sockets.SocketReader({"hostname": "127.0.0.1", "port": str(server.port), "spool": spool, "retry-seconds": "0.05"})


def test_batches_are_read_again_from_the_spool(tmp_path):
    server = Server(b"1\n2\n3\n", b"4\n5\n")
    server.start()
    reader, batches, at = reader_of(server, f"file://{tmp_path}/spool"), [], {"record": 0}
    while at["record"] < 5:
        rows, end = reader.read(at)
        if end != at:
            batches.append((at, end, list(rows)))
        at = end
    reader.connection.stop()
    again = reader_of(server, f"file://{tmp_path}/spool")
    for start, end, rows in batches:
        assert list(again.readBetweenOffsets(start, end)) == rows
    assert list(again.readBetweenOffsets({"record": 0}, at)) == [(i, str(i + 1).encode()) for i in range(5)]
    again.commit(batches[0][1])
    with pytest.raises(ValueError):
        list(again.readBetweenOffsets({"record": 0}, at))
    again.commit(at)
    assert not again._files()
    with pytest.raises(ValueError):
        sockets.SocketReader({"hostname": "h"})


def test_a_stream_of_json_with_bad_rows(spark):
    server = Server(b'{"a": 1, "b": "x"};not json;{"a": 2, "b": "y"};', b'{"a": 3};')
    server.start()
    records = sockets.socket_records(spark, "127.0.0.1", server.port, ord(";"), retry_seconds="0.1")
    query = sockets.json_rows(records, "a int, b string").writeStream.format("memory").queryName("socket_rows").option("checkpointLocation", shared_dir(spark, "socket-test")).start()
    seen = lambda: spark.table("socket_rows").count() == 3
    try:
        until(seen)
        counts = [p.observedMetrics["decoded"] for p in query.recentProgress if "decoded" in p.observedMetrics]
        assert sum(c.bad for c in counts) == 1 and sum(c.rows for c in counts) == 4
    finally:
        query.stop()
    assert sorted((r.a, r.b or "") for r in spark.table("socket_rows").collect()) == [(1, "x"), (2, "y"), (3, "")]


def squares():
    class Squares(custom.Elements):
        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "n long, square long, task int"

        def element(self, number, task):
            return number, number * number, task

    return Squares


def test_elements_in_tasks(spark):
    spark.dataSource.register(squares())
    rows = spark.read.format("squares").option("number-of-rows", 50).option("partitions", 3).load().collect()
    assert sorted((r.n, r.square) for r in rows) == [(n, n * n) for n in range(50)] and all(r.task == r.n % 3 for r in rows)
    stream = spark.readStream.format("squares").option("number-of-rows", 200).option("rows-per-second", 100_000).option("most-rows", 70).load()
    query = stream.writeStream.format("memory").queryName("squares_seen").option("checkpointLocation", shared_dir(spark, "squares")).start()
    try:
        until(lambda: spark.table("squares_seen").count() == 200)
        assert max(p.numInputRows for p in query.recentProgress) <= 70
    finally:
        query.stop()
    assert sorted(r.n for r in spark.table("squares_seen").collect()) == list(range(200))


def test_a_pause_is_not_made_up_for_at_once():
    now = [100.0]
    pace = custom.Paced({"rows-per-second": "10", "most-rows": "25"}, lambda: now[0])
    pace.reached(40)  # where the last run ended
    assert pace.latest() == 40
    now[0] += 2
    assert pace.latest() == 60
    now[0] += 1000
    assert pace.latest() == 65
    pace.reached(65)
    assert pace.latest() == 90


def test_generated_fields_at_a_speed(spark):
    spec = '[{"type": "long_inc", "fields": {"name": "i", "start": 3, "step": 2}}, {"type": "str_fix", "fields": {"name": "s", "len": 4}}]'
    query = fieldgen.generate_stream(spark, spec, 5, 10).writeStream.format("memory").queryName("generated").option("checkpointLocation", shared_dir(spark, "generated")).start()
    try:
        until(lambda: spark.table("generated").count() >= 500)
    finally:
        query.stop()
    rows = spark.table("generated").collect()
    assert sorted(r.i for r in rows) == [3 + 2 * n for n in range(len(rows))] and all(len(r.s) == 4 for r in rows)


def test_a_lookup_in_a_lateral_join(spark):
    options = {"fields.age.expression": "#{number.numberBetween '20','60'}", "seed": "3"}
    faker.register_lookup(spark, "person_of", ["id"], "id bigint, age int", options)
    got = spark.sql("SELECT o.id, p.age FROM (SELECT id % 7 AS id FROM range(50)) o, LATERAL person_of(o.id) p").collect()
    ages = {r.id: r.age for r in got}
    assert len(got) == 50 and len({(r.id, r.age) for r in got}) == 7 and all(20 <= a < 60 for a in ages.values())
    plain = {r.id: r.age for r in faker.lookup(spark.range(7), ["id"], "id bigint, age int", options).collect()}
    assert plain == ages


def test_some_rows_are_logged(spark, tmp_path):
    path = str(tmp_path / "lines")

    def put(line):
        with open(path, "a") as f:
            f.write(line + "\n")

    df = spark.range(100).coalesce(1)
    assert batched.log_some(df, 1000, put=put).count() == 100
    assert open(path).read() == '+I: {"id": 0}\n'
    assert partition.task_ids(spark.range(10).repartition(3), start=100).select("id").distinct().count() == 10
