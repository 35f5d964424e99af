"""Saves and deletes through a real database file."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from tidewheel.sinks import batched, database


def opener(path):
    def connect():
        return sqlite3.connect(path, timeout=60)

    return connect


def table_of(path, **options):
    return database.Table(opener(path), "t", ("id", "v", "note"), ("id",), **options)


def made(path, rows=()):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v INTEGER, note TEXT)")
        c.executemany("INSERT INTO t VALUES(?, ?, ?)", rows)


def there(path):
    with sqlite3.connect(path) as c:
        return sorted(c.execute("SELECT id, v, note FROM t").fetchall())


def test_saves_then_deletes_in_a_database(spark, tmp_path):
    path = str(tmp_path / "a.db")
    made(path, [(1, 10, "kept"), (2, 20, None), (3, 30, "gone"), (99, 0, "other")])
    rows = [(0, 1, 11, "new"), (1, 2, 21, "set"), (2, 3, -1, None), (3, 4, 1, "a"), (4, 4, 2, "b"), (5, 5, -1, "never there")]
    df = spark.createDataFrame([*rows, *[(10 + i, 1000 + i, i, None) for i in range(500)]], "o int, id long, v long, note string")
    table = table_of(path, keep_old=("note",), is_deleted=lambda r: r["v"] < 0)
    seen = database.write_table(df, table, rows=50, order="o")
    assert there(path)[:5] == [(1, 11, "kept"), (2, 21, "set"), (4, 2, "b"), (99, 0, "other"), (1000, 0, None)] and len(there(path)) == 504
    assert seen["in"] == 506 and seen["out"] == 505 and seen["errors"] == 0
    database.write_table(df, table, rows=50, order="o")
    assert len(there(path)) == 504


def test_a_batch_that_fails_is_rolled_back_and_tried_again(tmp_path):
    path = str(tmp_path / "b.db")
    made(path)
    tries = []

    def connect():
        tries.append(len(tries))
        return sqlite3.connect(path if len(tries) != 1 else ":memory:")  # the first has no such table

    table = database.Table(connect, "t", ("id", "v", "note"), ("id",))
    rows = [{"id": i, "v": i, "note": None} for i in range(5)]
    seen = batched.write_partition(rows, table.open_writer, batched.Batching(rows=2, key=table.key_of))
    assert (seen["out"], seen["errors"], len(tries)) == (5, 1, 2) and len(there(path)) == 5
    bad = [{"id": 7, "v": 1, "note": None}, {"id": "no number", "v": 1, "note": None}]
    with pytest.raises(sqlite3.Error):
        batched.write_partition(bad, table.open_writer, batched.Batching(rows=2, retries=0))
    assert len(there(path)) == 5


def test_statements():
    table = table_of("x", keep_old=("note",))
    assert table.save_sql() == "INSERT INTO t(id, v, note) VALUES(?, ?, ?) ON CONFLICT(id) DO UPDATE SET v=excluded.v, note=COALESCE(t.note, excluded.note)"
    mysql = table_of("x", dialect="mysql", mark="%s", keep_old=("note",))
    assert mysql.save_sql() == "INSERT INTO t(id, v, note) VALUES(%s, %s, %s) ON DUPLICATE KEY UPDATE v=VALUES(v), note=IFNULL(note,VALUES(note))"
    assert "DO NOTHING" in database.Table(opener("x"), "t", ("id",), ("id",)).save_sql()
    with pytest.raises(ValueError):
        table_of("x", dialect="none").save_sql()


def test_maps_of_numbers(spark):
    from tidewheel.functions import coercion

    df = spark.sql("SELECT map('a', '1', 'b', 'x', 'c', null) AS m UNION ALL SELECT null")
    got = [r.m for r in df.select(coercion.each_value(F.col("m"), "int").alias("m")).collect()]
    assert got == [{"a": 1, "b": 0, "c": 0}, {}]
