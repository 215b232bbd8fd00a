"""Every query with SQL is run beside DuckDB on the same small tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return c


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == want


def test_every_sql_has_a_query(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
