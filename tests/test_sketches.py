"""Roll-ups of kept sketches against exact aggregates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import sketches

SCHEMA = "day int, kind string, who long, amount double"


def kept(spark, rows):
    return sketches.sketched(spark.createDataFrame(rows, SCHEMA), ["day", "kind"], F.col("who"), F.col("amount"))


def test_roll_ups_stay_within_their_error(spark):
    r = random.Random(5)
    rows = [(d, r.choice("aab"), r.randrange(30000), r.random() ** 2) for d in range(6) for _ in range(8000)]
    got = sketches.estimated(sketches.rolled_up_all(kept(spark, rows), [["kind"], ["day"], []]), (0.5, 0.99)).collect()
    assert sorted((x.level, x.kind, x.day) for x in got if x.level != "day") == [("", None, None), ("kind", "a", None), ("kind", "b", None)]
    assert sum(x.level == "day" for x in got) == 6
    for x in got:
        mine = [y for y in rows if x.kind in (None, y[1]) and x.day in (None, y[0])]
        true = len({y[2] for y in mine})
        assert x.n == len(mine)
        assert abs(x.distinct - true) <= sketches.DISTINCT_ERROR * true
        for q, v in zip((0.5, 0.99), x.amounts, strict=True):
            assert abs(sum(y[3] <= v for y in mine) / len(mine) - q) <= 2 * sketches.RANK_ERROR


def test_overlaps(spark):
    rows = [(0, k, w, 1.0) for k, ids in (("a", range(0, 9000)), ("b", range(6000, 12000)), ("c", range(20000, 20010))) for w in ids]
    k = sketches.rolled_up(kept(spark, rows), ["kind"])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "zz"), (None, "a"), ("a", "b"), ("c", "c")], "a string, b string")
    got = {(x.a, x.b): x for x in sketches.overlaps(k, pairs, "kind").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("c", "c")}
    ab = got["a", "b"]
    for mine, true in ((ab.both, 3000), (ab.either, 12000), (ab.only_a, 6000)):
        assert abs(mine - true) <= sketches.THETA_ERROR * 12000
    assert got["a", "c"].both == 0 and (got["c", "c"].both, got["c", "c"].only_a) == (10, 0)


def test_nulls_and_empties(spark):
    rows = [(1, None, None, None), (1, None, 4, None), (2, "a", None, 3.0), (2, "a", None, 3.0)]
    got = {(x.day, x.kind): x for x in sketches.estimated(kept(spark, rows)).collect()}
    assert (got[1, None].n, got[1, None].distinct, got[1, None].amounts) == (2, 1, [None, None])
    assert (got[2, "a"].n, got[2, "a"].distinct, got[2, "a"].amounts) == (2, 0, [3.0, 3.0])
    assert kept(spark, []).count() == 0
    with pytest.raises(ValueError):
        sketches.sketched(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("day", "n"), ["n"], F.col("who"), F.col("amount"))
