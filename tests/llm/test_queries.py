"""Queries of the training-data operators against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from weft.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = queries.QUERIES[name](spark, SF)
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: float(v) if isinstance(v, float) else int(v) if isinstance(v, bool | int) or type(v).__name__ == "Decimal" else v
    want = sorted((tuple(plain(x) for x in row) for row in r.fetchall()), key=str)
    assert sorted((tuple(plain(row[c]) for c in names) for row in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
