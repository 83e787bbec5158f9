"""Graph scopes, central sentences and searches over communities, against plain Python on small graphs."""

from __future__ import annotations

import math
import random
import re

import pandas as pd

from weft.operators import communities

NODES, EDGES, SAID = "node_id string, node_type string, label string", "src string, dst string, edge_type string", "node_id string, paper_id long, evidence_id long"


def graph(spark):
    n = [("topic:a", "topic", "Alpha"), ("method:b", "method", "Beta"), ("gap:c", "gap", "Gamma"), ("paper:1", "paper", "One"), ("paper:2", "paper", "Two"), ("far", "topic", "Far"), ("alone", "topic", "Alone")]
    e = [("paper:1", "topic:a", "ON"), ("paper:1", "topic:a", "ON"), ("paper:2", "topic:a", "ON"), ("paper:2", "method:b", "USES"), ("method:b", "gap:c", "HAS"), ("far", "gap:c", "HAS"), (None, "topic:a", "ON"), ("paper:9", "nowhere", "ON")]
    s = [("topic:a", 1, 10), ("topic:a", 2, 11), ("topic:a", 2, 11), ("method:b", 2, None), ("far", None, 13), ("gap:c", 7, 14), (None, 5, 5)]
    return spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES), spark.createDataFrame(s, SAID)


def test_graph_scopes(spark):
    n, e, s = graph(spark)
    rest = spark.createDataFrame([("gap:c", 3, 30), ("gap:c", 3, 31), ("far", 4, 40)], SAID)
    asked = [(1, ["topic:a", "nowhere", None, "topic:a"], 1), (2, ["gap:c"], 0), (3, ["alone"], None), (4, ["topic:a"], 5), (5, [], 1), (6, None, 1), (None, ["topic:a"], 1), (1, ["topic:a", "nowhere", None, "topic:a"], 1)]
    r = spark.createDataFrame(asked, "request_id long, nodes array<string>, hops int")
    got = communities.graph_scopes(r, n, e, s, rest)
    rows = {x.request_id: x for x in got.report.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert tuple(rows[1])[1:] == (3, 2, 2, 2, ["Alpha"], [])
    assert tuple(rows[2])[1:] == (1, 0, 2, 3, ["Gamma"], [])
    assert tuple(rows[3])[1:] == (1, 0, 0, 0, ["Alone"], ["scope_no_papers", "scope_no_evidence"])
    assert tuple(rows[4])[1:] == (4, 3, 2, 2, ["Alpha"], ["hops_truncated"])
    for k in (5, 6):
        assert tuple(rows[k])[1:] == (0, 0, 0, 0, [], ["scope_no_papers", "scope_no_evidence"])
    assert {tuple(x) for x in got.papers.where("request_id = 2").collect()} == {(2, 7), (2, 3)}
    assert {tuple(x) for x in got.evidence.where("request_id = 2").collect()} == {(2, 14), (2, 30), (2, 31)}
    none = communities.graph_scopes(r, n.limit(0), e, s, rest).report
    assert all(x.warnings[0] == "graph_not_found" and x.papers == 0 for x in none.collect())


def brute(rows, most, centre):
    said: dict = {}
    for c, _, t in rows:
        if c is not None:
            for x in re.split(r"[.!?]+(?:\s|$)|\n", t or ""):
                if x.strip(" "):
                    said.setdefault(c, []).append(x.strip(" "))
    words = lambda x: {w for w in re.split(r"[^\w]+", x.lower()) if len(w) > 2}
    spread: dict = {}
    for c, all_ in said.items():
        for w in {w for x in all_ for w in words(x)}:
            spread.setdefault(w, set()).add(c)
    out = {}
    for c, all_ in said.items():
        weigh = {w: round(sum(w in words(x) for x in all_) / len(all_) * math.log(1 + len(said) / len(spread[w])), 9) for w in {w for x in all_ for w in words(x)}}
        top = set(sorted(weigh, key=lambda w: (-weigh[w], w))[:centre])
        score = lambda x: round(sum(weigh[w] for w in words(x) & top) / math.sqrt(len(words(x)) or 1), 6)  # noqa: B023, E731
        out[c] = [(x, score(x)) for x in sorted(set(all_), key=lambda x: (-score(x), x))[:most]]  # noqa: B023
    return out


def test_central_sentences_equal_a_plain_loop(spark):
    r = random.Random(3)
    vocab = [f"{a}{b}x" for a in "abcdefgh" for b in "klmnopqr"]
    texts = [(i, "".join(" ".join(r.choices(vocab[: r.choice((4, 20, 64))], k=r.randrange(1, 9))) + r.choice([". ", "!\n", "? ", "\n"]) for _ in range(r.randrange(0, 7)))) for i in range(60)]
    rows = [(r.choice(["one", "two", "three"]), i, x) for i, x in texts]
    rows += [rows[0], rows[0], (None, 1, "No community."), ("one", None, "No node here."), ("dumb", 60, None), ("dumb", 61, ""), ("short", 62, "b. a. c\nb. d")]
    m = spark.createDataFrame(rows, "community string, node_id long, text string")
    got: dict = {}
    for x in communities.central_sentences(m, 4, 12).orderBy("community", "rank").collect():
        got.setdefault(x.community, []).append((x.sentence, x.score))
    want = brute(rows, 4, 12)
    assert {c: [s for s, _ in v] for c, v in got.items()} == {c: [s for s, _ in v] for c, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for c in want for a, b in zip(got[c], want[c], strict=True))
    told = {x.community: x for x in communities.summaries(m, 2).collect()}
    assert set(told) == {"one", "two", "three", "dumb", "short"} and (told["dumb"].members, told["dumb"].summary) == (2, "")
    assert told["short"].summary == "a. b."
    assert communities.summaries(m.limit(0)).count() == 0
    upper = communities.summaries(m, 2, write=lambda p: p.str.upper().str[:9]).collect()
    assert {x.community: x.summary for x in upper} == {c: "SUMMARIZE" if c != "dumb" else "" for c in told}


def test_global_search(spark):
    told = spark.createDataFrame([("c1", 4, "Graph mining finds cycles."), ("c2", 2, "Cycles and graph colours."), ("c3", 1, "Soil and rain."), ("c4", 1, "")], "community string, members long, summary string")
    q = spark.createDataFrame([(1, "graph cycles"), (2, "nothing here"), (3, None), (4, "soil"), (4, "soil"), (None, "graph")], "query_id long, question string")
    got = {x.query_id: x for x in communities.global_search(q, told).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].sources == ["c1", "c2"] and got[1].answer == "[Community 1 (4)]\nGraph mining finds cycles.\n\n---\n\n[Community 2 (2)]\nCycles and graph colours."
    assert (got[2].answer, got[2].sources, got[3].answer) == ("", [], "") and got[4].sources == ["c3"]
    assert {x.query_id: x.sources for x in communities.global_search(q, told, most=1).collect()}[1] == ["c1"]

    def model(p: pd.Series) -> pd.Series:
        return p.map(lambda x: "NO_RELEVANCE" if "mining" in x and "summary of" in x else "all: " + x[-12:] if x.startswith("Put") else "part")

    got = {x.query_id: x for x in communities.global_search(q, told, write=model).collect()}
    assert (got[1].sources, got[1].answer) == (["c2"], "all: graph cycles")
    assert (got[2].sources, got[2].answer) == ([], "")


def test_local_search(spark):
    n, e, s = graph(spark)
    members = spark.createDataFrame([("c1", "topic:a"), ("c1", "method:b"), ("c1", "method:b"), ("c2", "gap:c"), ("c3", "far")], "community string, node_id string")
    told = spark.createDataFrame([("c1", 2, "About alpha."), ("c2", 1, ""), ("c3", 1, "Far off.")], "community string, members long, summary string")
    q = spark.createDataFrame([(1, "why", ["topic:a"], 2), (2, "what", ["nowhere"], 1), (3, None, None, 1)], "query_id long, question string, nodes array<string>, hops int")
    got = {x.query_id: x for x in communities.local_search(q, n, e, members, told, s).collect()}
    assert got[1].context == "[entities]\n  method: Beta\n  topic: Alpha\n[relations]\n  One --ON--> Alpha\n  Two --USES--> Beta\n  Two --ON--> Alpha\n[communities]\n  About alpha."
    assert (got[1].answer, got[1].sources, got[1].context_nodes) == (got[1].context, [1, 2], ["method:b", "topic:a"])
    for k in (2, 3):
        assert tuple(got[k])[1:] == ("", "", [], [])
    said = communities.local_search(q, n, e, members, told, s, write=lambda p: p.str[-3:]).collect()
    assert {x.query_id: x.answer for x in said} == {1: "why", 2: "", 3: ""}
