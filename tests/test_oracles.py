"""Every query that has SQL gives the rows that the SQL gives, on the smallest tables."""

from __future__ import annotations

import datetime

import pytest
from conftest import SMALL

from tidewheel.plans.catalog import ORACLES, QUERIES


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(ORACLES[name])
    places = [relation.columns.index(c) for c in columns]
    assert len(columns) == len(relation.columns)
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
