from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from weft.llm import suffix_sort, suffixes


def brute(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted({(-(1 << 63) if d is None else d, t or "") for d, t in rows}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("depth", [2, 5, 9, 100])
def test_suffix_order(depth):
    r = random.Random(depth)
    for _ in range(150):
        x = [r.randrange(r.choice((1, 2, 5))) for _ in range(r.randrange(70))]
        got = suffixes.suffix_order(np.array(x, np.int64), depth).tolist()
        assert sorted(got) == list(range(len(x)))
        keys = [tuple(x[i : i + depth]) for i in got]
        assert keys == sorted(keys)


def documents():
    r = random.Random(8)
    words = [f"{r.getrandbits(40):x}" for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [say(r.randint(1, 120)) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[i % 4]) for i in range(12)]
    passage = say(40)
    rows += [(200 + i, f"{say(r.randint(0, 30))} {passage[r.randrange(60) :]} {say(r.randint(0, 30))}") for i in range(25)]
    rows += [(300, "-" * 900), (301, "x" + "-" * 150), (302, "ab" * 300), (303, None), (304, ""), (305, "é" * 120), (306, say(3000) + base[1]), (None, base[2]), (1, base[1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 3])
def test_matches_brute_force(spark, monkeypatch, crowd):
    rows = documents()
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes.repeated_stretches, "__defaults__", (100, crowd))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixes.deduplicated(d).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        key = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
        assert tuple(r)[1:] == want[key], key


def test_empty_table(spark):
    assert suffixes.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_over_batches():
    """The comparison of contexts carries its state from batch to batch."""
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted((r.randrange(6), r.randrange(4), r.randrange(9), 10 * k, 5) for k in range(200))
    as_batch = lambda part: pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*part, strict=True)], names=["key", "ctx", "doc", "at", "n"])
    run = suffixes._compare(100)
    total = lambda size: sorted((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()) for b in run(as_batch(rows[i : i + size]) for i in range(0, 200, size)) for i in range(b.num_rows) if b.column(2)[i].as_py() > 0)
    assert total(1) == total(7) == total(200)


def test_distributed_sort_is_the_sorted_order(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab") for _ in range(r.choice((1, 2, 3, 7, 40)))) for _ in range(12)]
    rows = [(s, i, ord(c)) for s, t in enumerate(texts) for i, c in enumerate(t)]
    d = spark.createDataFrame(rows, "s long, i long, c long")
    got = suffix_sort.suffix_ranks(d, 64).orderBy("rank").collect()
    suffixes_in_order = [texts[x["s"]][x["i"] :] for x in got]
    assert suffixes_in_order == sorted(suffixes_in_order) and len(got) == len(rows)


def test_distributed_sort_finds_the_repeats(spark):
    r = random.Random(9)
    part = "".join(r.choice("abc ") for _ in range(60))
    texts = ["".join(r.choice("abcde ") for _ in range(30)) + part + "".join(r.choice("abcde ") for _ in range(r.randint(0, 9))) for _ in range(6)] + ["é" * 30, "", None, "x" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), set()
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        for i in range(len(raw) - 19):
            (want if raw[i : i + 20] in seen else set()).add((k, i))
            seen.add(raw[i : i + 20])
    assert {tuple(x) for x in suffix_sort.repeated_strings(d, length=20).collect()} == want


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 3])
def test_texts_are_dealt_once(spark, monkeypatch, crowd):
    """Crowded grams take no job of their own, in which the texts were compressed and dealt a second time."""
    dealt, packed = spark.sparkContext.accumulator(0), suffixes._packed

    def counted(batches):
        for b in packed(batches):
            dealt.add(b.num_rows)
            yield b

    monkeypatch.setattr(suffixes, "_packed", counted)
    monkeypatch.setattr(suffixes.repeated_stretches, "__defaults__", (100, crowd))
    rows = documents()
    suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert dealt.value == len(rows)


def test_strings_over_batches():
    """The first string of a hash is kept from batch to batch, beside parts of grams between them."""
    import pyarrow as pa

    r = random.Random(3)
    shared = bytes(r.randrange(256) for _ in range(120))
    rows = sorted((r.randrange(4), r.randrange(1, 3), r.randrange(9), 1000 * r.randrange(6), None) for _ in range(150))
    rows = sorted([*rows, *[(k, 0, 20 + d, 0, shared) for k in range(4) for d in range(2 * k, 2 * k + 2)]], key=lambda x: x[:4])
    kinds = [*[pa.int64()] * 4, pa.binary()]
    as_batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["key", "more", "doc", "at", "part"])
    want, first = set(), {}
    for key, more, doc, at, part in rows:
        if part is None and first.setdefault((key, more), (doc, at)) != (doc, at):
            want.add((doc, at, -100))
    want |= {(20 + d, 0, -120) for d in (1, 3, 5, 7)}
    # All the parts are of the same bytes, of which the first lot keeps one.
    want |= {(20 + d, 0, -120) for d in (2, 4, 6)}
    for size in (1, 7, 150, 400):
        got = [tuple(c[i].as_py() for c in b.columns) for b in suffixes._sorted_out(100)(as_batch(rows[i : i + size]) for i in range(0, len(rows), size)) for i in range(b.num_rows)]
        assert set(got) == want
