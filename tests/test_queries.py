"""Every registered query against its SQL on a second engine."""

import datetime
import math

import duckdb
import pytest

from millrace.queries import CHECKS, QUERIES
from millrace.sources.views import TABLES



@pytest.fixture(scope="module")
def engine(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1e15 else value
    if isinstance(value, datetime.datetime):
        value = value.replace(tzinfo=None)
        return value.isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data_dir, engine):
    result = QUERIES[name](spark, data_dir)
    got = table_of(result.columns, [tuple(r) for r in result.collect()])
    cursor = engine.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    want = table_of(names, cursor.fetchall())
    assert sorted(names) == sorted(result.columns)
    assert got == want
