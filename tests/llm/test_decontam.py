from __future__ import annotations

import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import decontam


def brute(text, items, least=13, share=0.8):
    t = decontam.words(text)
    out = set()
    for item_id, item in items:
        w = decontam.words(item)
        need = least if len(w) >= least else len(w)
        for shift in range(-len(w) + 1, len(t)) if w else ():
            a, b = max(0, -shift), min(len(w), len(t) - shift)
            same = [w[i] == t[i + shift] for i in range(a, b)]
            at = [i for i, s in enumerate(same) if s]
            for x in range(len(at)):
                for y in range(x, len(at)):
                    n, k = at[y] - at[x] + 1, y - x + 1
                    if n >= need and k >= share * n - 1e-9 and (k == n or len(w) >= least):
                        out.add(item_id)
    return out


def test_seeds_hit_every_window():
    seeds = decontam.spaced_seeds(13, 2, 6)
    for wrong in combinations(range(13), 2):
        assert any(all(o + k not in wrong for o in s) for s in seeds for k in range(13 - s[-1]))


@pytest.mark.parametrize("n,errors", [(13, 2), (14, 2), (15, 3), (16, 3), (17, 3), (18, 3), (19, 3), (20, 4), (21, 4), (25, 5)])
def test_seeds_hit_every_overlap(n, errors):
    assert errors == int(0.2 * n + 1e-9)
    places = [sum(1 << o + k for o in s) for s in decontam.overlap_seeds(13, 0.8, 6) for k in range(n - s[-1])]
    wrong = np.array([sum(1 << i for i in c) for c in combinations(range(n), errors)])
    assert np.logical_or.reduce([wrong & m == 0 for m in places]).all()


def test_no_length_is_missed():
    assert decontam.missed_length(decontam.overlap_seeds(13, 0.8, 6)) == 0
    assert decontam.missed_length(decontam.spaced_seeds(13, 2, 6)) == 15


@pytest.mark.parametrize("n,wrong", [(15, (2, 5, 7)), (20, (1, 8, 10, 12))])
def test_longer_overlaps_are_found(n, wrong):
    item = [f"w{i}" for i in range(n)]
    text = " ".join("other" if i in wrong else w for i, w in enumerate(item))
    assert brute(text, [(1, " ".join(item))]) == {1}
    assert decontam.SeedIndex([(1, " ".join(item))]).match(text) == [(1, 0, n, n - len(wrong))]


def test_matches_brute_force(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.choice((4, 9, 13, 30, 60))))) for i in range(25)] + [(50, None), (51, ""), (52, "!!")]
    docs = []
    for i in range(120):
        body = [word() for _ in range(r.randint(0, 80))]
        if i % 2:
            w = items[i % 25][1].split()
            part = w[r.randrange(max(1, len(w) - 20)) :]
            part = [word() if r.random() < r.choice((0, 0.1, 0.25)) else x for x in part]
            at = r.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, ", ".join(body).upper() if i % 3 else " ".join(body)))
    docs += [(None, items[4][1]), (500, None), (501, ""), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = sorted(((i, x) for i, t in docs for x in brute(t, items)), key=str)
    got = decontam.contaminated(d, b).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == want
    in_blocks = decontam.contaminated(d, b, block_bytes=400)
    assert sorted(((r["doc_id"], r["item_id"]) for r in in_blocks.collect()), key=str) == want
    clean = decontam.uncontaminated(d, b)
    assert clean.columns == d.columns
    assert clean.count() == sum(not brute(t, items) for _, t in docs)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, b).count() == 0
    assert decontam.uncontaminated(d, b).count() == 1
    assert decontam.contaminated(d.limit(0), d.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_longest_overlap():
    assert decontam.longest_overlap(np.array([0, 1, 1, 0, 1, 1, 1, 0], bool), 0.8) == (1, 6, 5)
    assert decontam.longest_overlap(np.zeros(4, bool), 0.8) == (0, 0, 0)


def test_repetitive_texts_against_repetitive_items():
    index = decontam.SeedIndex([(1, "a " * 100), (2, "a b " * 40), (None, "a b c " * 5)])
    start = time.time()
    assert index.match("a " * 300_000) == [(1, 0, 100, 100)]
    assert index.match("c " + "a b " * 150_000) == [(2, 1, 80, 80)]
    assert time.time() - start < 20


def test_long_items_of_few_words():
    """Items and texts of 50,000 equal words and of 5,000 words of two; the latter against a plain search of every diagonal."""
    start = time.time()
    index = decontam.SeedIndex([(1, "a " * 50_000)])
    assert index.match("a " * 50_000) == [(1, 0, 50_000, 50_000)]
    assert index.match("b " + "a " * 20_000) == [(1, 1, 20_000, 20_000)]
    r = np.random.default_rng(8)
    item, text = (np.where(r.random(5_000) < 0.5, "a", "b") for _ in range(2))
    index = decontam.SeedIndex([(1, " ".join(item))])
    (found,) = index.match(" ".join(text))
    assert time.time() - start < 20
    assert index.match(" ".join(text), any_=True)
    best = (0, 0, 0)
    for shift in range(1 - len(item), len(text)):
        i, j = max(0, -shift), min(len(item), len(text) - shift)
        at, n, equal = decontam.longest_overlap(item[i:j] == text[i + shift : j + shift], 0.8)
        best = max(best, (n, equal, -(at + i + shift)))
    assert found == (1, -best[2], best[0], best[1])
