"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import numpy as np
import pytest

from weft import plans

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal | float | np.floating):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool | int | np.integer):
        return int(v)
    return v if v is None or isinstance(v, str | datetime.date) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in plans.SQL:
        assert rows
        return
    r = duck.execute(plans.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
