"""The registered queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quire.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_queries_of_all_operators():
    assert [n.split("_")[0] for n in QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = QUERIES[name](spark, DATA), con.execute(ORACLES[name])
    columns, named = sorted(got.columns), [c[0] for c in want.description]
    assert sorted(named) == columns
    places = [named.index(c) for c in columns]
    rows = lambda all_rows: sorted(tuple(map(str, r)) for r in all_rows)
    assert rows(got.select(*columns).collect()) == rows([r[k] for k in places] for r in want.fetchall())
