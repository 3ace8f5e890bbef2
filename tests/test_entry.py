"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from quillspan import queries as core
from quillspan import queries_text

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{DATA}/{f}'")
    return con


def cell(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in tuple("if") else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = core.QUERIES[name](spark, DATA).toPandas(), duck.sql(core.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[cols].itertuples(index=False))
    assert rows(a) == rows(b)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
