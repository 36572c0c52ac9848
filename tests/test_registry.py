"""The whole registry against DuckDB at the smallest size, where the data are at hand."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [n for n in entry.registry.oracle_sql()]


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    df = entry.registry.queries()[name](spark, DATA)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    res = duck.execute(entry.registry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    assert entry.entry(spark).count() > 0
