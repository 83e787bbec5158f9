from __future__ import annotations

import binascii
import hashlib
import heapq
import itertools
import random
import re

import pytest

from weft.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        k = binascii.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [] if k == 0 else [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Shortest paths over (row, state) by (cost, edits): ``rows`` has (role, fault)."""
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, edits, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, edits
        following = 3 if state == 2 else 2
        heapq.heappush(queue, (cost + 2, edits + "I", i, following))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heapq.heappush(queue, (cost + 2 + extra, edits + "R", i + 1, following))
                if role[:1] == "s" and state == 0:
                    heapq.heappush(queue, (cost + extra, edits + "K", i + 1, 1))
                if (role[:1], following) in (("u", 2), ("a", 3)):
                    heapq.heappush(queue, (cost + extra, edits + "K", i + 1, following))
    raise AssertionError


def brute(rows, ids) -> list[tuple]:
    out = []
    for conv in ids:
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest([(r, f) for (_, r, _), f in zip(own, faults, strict=True)])
        said, state, left = [], 0, iter(own)
        for e in audit:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            role = row[1] if e == "K" else ("assistant" if state == 2 else "user")
            said.append(f"{role}:{row[2] if row else ''}")
            state = 1 if state == 0 and role[:1] == "s" else 3 if state == 2 else 2
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def ours(spark, rows) -> list[tuple]:
    t = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{TURNS}, chunk int, digest string").repartition(3)
    return sorted((tuple(r) for r in repair.report(repair.damaged(t), t).collect()), key=str)


def wanted(rows) -> list[tuple]:
    return brute(damage(rows), {r[0] for r in rows})


def conversation(r: random.Random, conv, n: int) -> list[tuple]:
    say = lambda: r.choice(["Yes.", "No!", "Why?", "cut off", "more ", "", " \n", "Ends. \t"]) if r.random() < 0.5 else f"word {r.randint(0, 99)}."
    return [(conv, i if r.random() < 0.9 else i + 3, r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), say()) for i in range(n)]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    r = random.Random(chunk)
    rows = [t for c in range(200) for t in conversation(r, c, r.randint(1, 9))]
    assert ours(spark, rows) == wanted(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, "Hi."), (1, None, "user", None), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 2, "assistant", "Ho."), (1, 2, "assistant", "Ha.")]
    rows += [(2, None, "user", "A."), (2, None, "assistant", "B."), (3, 1, "system", "S."), (4, 1, "été", "é."), (4, -5, "user", " ")]
    rows += [(100 + k, 0, "user", "Only.") for k in range(60)]
    assert ours(spark, rows) == wanted(rows)
    assert any(x[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for x in ours(spark, rows)), "some conversation loses all rows"


def test_a_long_conversation_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 50)
    r = random.Random(9)
    rows = conversation(r, 1, 4000) + conversation(r, 2, 7)
    assert ours(spark, rows) == wanted(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_prefixes_share_their_layers(monkeypatch):
    steps = []
    real = repair.step
    monkeypatch.setattr(repair, "step", lambda *a: steps.append(1) or real(*a))
    sigs = sorted({"suaua", "suauaua", "suaux", "ua", "uaU"})
    got = [w for w in repair.walk(iter(sigs), (0,))]
    assert len(steps) == 11 and len(got) == 5  # suaua, ua, x, ua, U
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for sig, ways in zip(sigs, got, strict=True):
        rows = [("", "blank") if c == "x" else (roles[c.lower()], "truncated" if c.isupper() else "") for c in sig]
        closed = min((c + 2 * len(repair._CLOSE[e]), x + repair._CLOSE[e]) for _, e, c, x in ways)
        assert closed == cheapest(rows)
