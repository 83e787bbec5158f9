from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import negatives

ROWS = "vec_id long, label string, x array<double>"


def brute(rows: list[tuple], anchors, positives=5, wrong=3, low=50, high=95) -> list[tuple]:
    rows = [(i, a, x) for i, a, x in rows if a is not None and x is not None]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for me, (i, label, x) in enumerate(rows):
        if not anchors(i):
            continue
        scored = [(sum(int(a) * int(b) for a, b in zip(x, y, strict=False)), j, other) for k, (j, other, y) in enumerate(rows) if k != me]
        for s, p, _ in sorted((t for t in scored if t[2] == label), key=key)[:positives]:
            fit = sorted((t for t in scored if t[2] != label and low * s <= 100 * t[0] <= high * s), key=key)[:wrong]
            out += [(i, p, n + 1, t[1], s, t[0]) for n, t in enumerate(fit)]
    return sorted(out, key=str)


def ours(spark, rows, anchor, **more) -> list[tuple]:
    out = negatives.hard_negatives(spark.createDataFrame(rows, ROWS).repartition(3), anchor, **more)
    return sorted((tuple(r) for r in out.collect()), key=str)


def clustered(seed: int, n: int, width: int, labels: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    centre = r.normal(size=(9, width)) * 40
    return [(int(i), str(r.integers(labels)), [float(v) for v in np.floor(centre[r.integers(9)] + r.normal(size=width) * r.choice([2, 30]))]) for i in range(n)]


def test_brute_force(spark, monkeypatch):
    """Small blocks and slices, so that cells have several blocks and anchors several slices."""
    monkeypatch.setattr(negatives, "BLOCK", 20)
    monkeypatch.setattr(negatives, "SLICE", 15)
    rows = clustered(1, 600, 12, 4)
    assert ours(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    r = random.Random(2)
    rows = [(i, "a" if i % 3 else "b", [10.0, 5.0, 1.0]) for i in range(150)]
    rows += [(1000 + i, r.choice("abc"), [float(r.randint(-3, 9)) for _ in range(3)]) for i in range(150)]
    assert ours(spark, rows, F.col("vec_id") % 25 == 0) == brute(rows, lambda i: i % 25 == 0)


def test_nulls_repeats_and_lengths(spark):
    rows = [
        (0, "a", [3.0, 4.0]), (0, "a", [3.0, 4.0]), (1, "a", [3.0, 3.0]), (None, "a", [3.0, 4.0]), (None, "b", [2.0, 3.0]), (2, "b", [2.0, 3.0]), (2, "b", [2.0, 3.0]),
        (3, "b", [2.0]), (50, "c", []), (51, None, [3.0, 4.0]), (52, "b", None), (100, "a", [-3.0, -4.0]), (150, "lone", [1.0, 1.0]), (4, "b", [0.0, 0.0]),
    ]
    assert ours(spark, rows, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i is not None and i % 50 == 0)
    assert ours(spark, [(0, "a", [1.0]), (1, "a", [1.0])], F.lit(True)) == []
    assert ours(spark, [], F.lit(True)) == []


def test_large_numbers_are_exact(spark):
    r = random.Random(4)
    rows = [(i, "ab"[i % 2], [float(r.randint(-(2**27), 2**27)) for _ in range(4)]) for i in range(60)]
    assert ours(spark, rows, F.col("vec_id") % 5 == 0) == brute(rows, lambda i: i % 5 == 0)


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [nan]), (5, [inf, 1.0]), (6, [-inf]), (7, [])]
    got = negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: r.x for r in got.collect()} == {1: [128.0, -1.0], 7: []}


@pytest.mark.parametrize("low,high", [(0, 100), (120, 150)])
def test_other_ranges(spark, low, high):
    rows = clustered(3, 200, 6, 3)
    docs = spark.createDataFrame([(*t, 1, 2) for t in rows], f"{ROWS}, cell int, rid int")
    out = negatives.hard_negatives(docs, F.col("vec_id") % 20 == 0, low=low, high=high)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, lambda i: i % 20 == 0, low=low, high=high)
