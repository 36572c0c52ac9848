"""The llm queries against DuckDB at the smallest size, and that the core does without this subpackage."""

import os
import pathlib
from collections import Counter

import duckdb
import pytest

from chronodoc.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", [n for n in queries.queries()])
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in queries.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    res = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert Counter(tuple(r[c] for c in sorted(df.columns)) for r in rows) == Counter(tuple(r[cols.index(c)] for c in sorted(cols)) for r in res.fetchall())


def test_core_does_not_import_this():
    root = pathlib.Path(__file__).parents[2] / "chronodoc"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "chronodoc.llm" not in p.read_text()
