"""The section scanner against a plain loop over whole texts."""

from __future__ import annotations

import random
import re

from weft.functions import rules
from weft.operators import scanner

HEADINGS = {"Abstract": "abstract", "1. Introduction": "introduction", "Results": "result", "2 Method of it": "method", "结论": "conclusion"}


def size(t: str) -> int:
    c = sum("一" <= x <= "鿿" for x in t)
    return c // 2 + (len(t) - c) // 4


def plain(pages: list[tuple[int | None, str | None]]) -> list[tuple]:
    flat = [(p, x) for p, t in sorted(pages, key=lambda v: (v[0] is not None, v[0] or 0)) for x in (t or "").split("\n")]
    out, text, section, tail, at, opened, last = [], "", "", "", 0, flat[0][0] if flat else None, None

    def flush(page):
        nonlocal text, tail, at, opened
        t = text.strip()
        if t and (len(t) >= 30 or section in ("title", "abstract")):
            body = section in ("", "introduction", "related_work", "background", "future_work", "acknowledgment")
            parts = [t]
            if size(t) <= 900:
                if body and tail and size(tail + " " + t) <= 1000:
                    parts = [tail + " " + t]
            else:
                bits = [b.strip() for b in t.split("\n\n") if b.strip()]
                if len(bits) == 1:
                    bits = [b.strip() for b in re.split(r"(?<=[.!?。！？])\s+", t) if b.strip()]
                parts = [bits[0]]
                for b in bits[1:]:
                    if size(parts[-1] + " " + b) > 900:
                        parts.append(b)
                    else:
                        parts[-1] += " " + b
            a = at
            for b in parts:
                out.append((len(out), section, "body" if body else section, b, size(b), a, a + len(b), opened, last))
                a += len(b) + 1
            w = t.split()
            tail = " ".join(w[-80:]) if len(w) > 80 else t
            at += len(text)
        text, opened = "", page

    for page, x in flat:
        if x.strip() in HEADINGS:
            flush(page)
            section = HEADINGS[x.strip()]
            continue
        text, last = text + x + "\n", page
        if size(text) >= 800:
            flush(page)
    flush(None)
    return out


def document(r: random.Random) -> list[tuple[int, str]]:
    words = ["alpha", "be", "gamma-ray", "结果很好", "of", "measurement", "ends.", "really?", "x"]
    pages = []
    for p in range(r.randint(1, 6)):
        lines = []
        for _ in range(r.randint(0, 12)):
            kind = r.random()
            line = r.choice(list(HEADINGS)) if kind < 0.15 else "" if kind < 0.3 else " ".join(r.choice(words) for _ in range(r.choice((1, 5, 60, 60, 900, 1500)) if kind < 0.9 else 2))
            lines.append(line)
        pages.append((p, "\n".join(lines)))
    return pages


def test_plain_loop(spark):
    r = random.Random(6)
    docs = {d: document(r) for d in range(40)}
    docs[100] = [(None, "no page number, but a line that is long enough"), (1, None), (2, ""), (3, "Abstract\nshort")]
    docs[101] = [(1, "tiny")]
    docs[None] = [(1, "a document without an id, with one line of text")]
    rows = [(d, p, t, 1) for d, pages in docs.items() for p, t in pages]
    table = spark.createDataFrame(rows, "doc_id long, page_no long, text string, chunk_index int").repartition(3)
    got: dict = {}
    for x in scanner.scanned(table, "doc_id", "page_no", "text").orderBy("doc", "chunk_index").collect():
        got.setdefault(x["doc"], []).append(tuple(x)[1:])
    for d, pages in docs.items():
        assert got.get(d, []) == plain(pages), d
    kinds = {k for chunks in got.values() for _, _, k, *_ in chunks}
    assert {"body", "abstract", "result", "method", "conclusion"} <= kinds and set(HEADINGS.values()) <= set(rules.HEADINGS)


def test_sql_and_empty_table(spark):
    scanner.register(spark)
    pages = spark.createDataFrame([("d", 1, "Abstract\nA text of some words, which is long enough.")], "doc string, page int, text string")
    scanner.lines_of(pages, "doc", "page", "text").createOrReplaceTempView("lines")
    (row,) = spark.sql("SELECT * FROM section_chunks(TABLE(lines))").collect()
    assert (row["doc"], row["section"], row["page_start"], row["page_end"]) == ("d", "abstract", 1, 1)
    assert scanner.scanned(pages.limit(0), "doc", "page", "text").count() == 0
