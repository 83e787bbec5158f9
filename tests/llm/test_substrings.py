from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.conftest import DOCS, text
from weft.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows: list[tuple[int | None, str | None]], length: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        off = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                off[i : i + length] = [True] * length
        edges = [i for i in range(len(w) + 1) if (i < len(w) and off[i]) != (i > 0 and off[i - 1])]
        spans = [(i, j - i) for i, j in zip(edges[::2], edges[1::2], strict=True)]
        out.append((d, " ".join(x for x, o in zip(w, off, strict=True) if not o), len(w), sum(off), spans))
    return sorted(out, key=str)


def ours(docs, length: int) -> list[tuple]:
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed, [tuple(s) for s in r.repeats]) for r in substrings.deduplicated(docs, length, min(5, length)).collect()), key=str)


@pytest.mark.parametrize("length", [1, 4, 13])
def test_brute_force(spark, corpus, length):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    assert ours(corpus, length) == brute(rows, length)


def test_passages_in_other_surroundings(spark):
    """A passage in many documents, cut at other places, between other words, twice in one document; few words in all."""
    r = random.Random(3)
    passage = text(r, 60, 400).split()
    rows = []
    for d in range(150):
        i, j = sorted(r.sample(range(61), 2))
        w = text(r, r.randint(0, 20), 300).split() + passage[i:j] + text(r, r.randint(0, 9), 300).split() + passage[5 : 5 + r.randint(11, 16)]
        rows.append((d * 7 % 151, "\t".join(w)))
    rows += [(1000 + d, " ".join(r.choice("ab") for _ in range(r.randint(10, 80)))) for d in range(60)]
    rows += [(2000 + d, "x " * n) for d, n in enumerate((12, 13, 14, 500, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(docs, 13) == brute(rows, 13)


def test_nulls_repeats_and_clashes(spark):
    long = text(random.Random(1), 40)
    rows = [(None, long), (None, long), (5, long), (5, long), (5, "other " + long), (6, long + " end"), (7, None), (8, ""), (9, " \t\n"), (10, "one two")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, a int, tag int, gone int")
    got = ours(docs, 13)
    assert got == brute(rows, 13)
    assert sum(r[3] for r in got if r[0] in (None, 5)) == 0 and [r[3] for r in got if r[0] == 6] == [40]


def test_empty_table(spark):
    assert ours(spark.createDataFrame([], DOCS), 13) == []


def test_a_long_text_is_linear(spark):
    """Texts of 300,000 words, of two words at random and of one word only."""
    r = np.random.default_rng(1)
    two = " ".join(np.where(r.random(300_000) < 0.5, "a", "b"))
    docs = spark.createDataFrame([(1, two), (2, two[2:]), (3, "a " * 300_000), (4, "a " * 300_001)], "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substrings.deduplicated(docs).drop("text", "repeats").collect()}
    assert got[1] == (300_000, 0) and got[2] == (299_999, 299_999) and got[4] == (300_001, 300_001)
