"""Leiden communities and label propagation on graphs with known answers."""

from __future__ import annotations

import itertools
import random

from weft.operators import graphs, leiden

NODE, EDGE = "node_id string, node_type string", "src string, dst string, edge_type string"


def connected(members: set, pairs: set) -> bool:
    seen, todo = set(), [min(members)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [y for y in members if (x, y) in pairs or (y, x) in pairs]
    return seen == members


def test_known_communities(spark):
    """Cliques in a ring of cliques, a ring of nodes, an isolated node, loops, null ends, repeated and reversed edges, unknown ends."""
    cliques = [[f"c{k}-{i}" for i in range(6)] for k in range(5)]
    pairs = {p for c in cliques for p in itertools.combinations(c, 2)} | {(cliques[k][0], cliques[(k + 1) % 5][1]) for k in range(5)}
    ring = [f"r{i:02}" for i in range(30)]
    pairs |= set(zip(ring, ring[1:] + ring[:1], strict=True))
    nodes = [x for c in cliques for x in c] + ring + ["alone", None, "alone"]
    odd = [("c0-0", "c0-0"), (None, "c0-1"), ("c0-1", None), ("c0-1", "c0-0"), ("r00", "nowhere")]
    n = spark.createDataFrame([(x, "t") for x in nodes], NODE)
    e = spark.createDataFrame([(*p, "e") for p in [*sorted(pairs), *odd]], EDGE)
    got = leiden.communities(n, e).collect()
    of: dict[str, set] = {}
    for r in got:
        of.setdefault(r.community, set()).add(r.node_id)
    assert sorted(r.node_id for r in got) == sorted({x for x in nodes if x})
    assert all(min(m) == c and connected(m, pairs) for c, m in of.items())
    assert all(set(c) in of.values() for c in cliques) and {"alone"} in of.values()
    assert 2 <= sum(c.startswith("r") for c in of) <= 15
    assert leiden.communities(n.limit(0), e).count() == 0
    q = leiden.modularity(e.where("src <> 'r00' or dst <> 'nowhere'"), spark.createDataFrame(got)).first()[0]
    assert q > 0.75


def test_no_worse_than_label_propagation(spark):
    r = random.Random(2)
    group = {i: i % 4 for i in range(80)}
    pairs = {(f"n{i}", f"n{j}") for i, j in itertools.combinations(range(80), 2) if r.random() < (0.35 if group[i] == group[j] else 0.03)}
    n = spark.createDataFrame([(f"n{i}", "t") for i in range(80)], NODE)
    e = spark.createDataFrame([(*p, "e") for p in sorted(pairs)], EDGE)
    spread = graphs.label_propagation(n, e)
    assert spread.count() == 80
    mine = leiden.modularity(e, leiden.communities(n, e)).first()[0]
    assert mine >= leiden.modularity(e, spread).first()[0] - 1e-9
    true = spark.createDataFrame([(f"n{i}", str(g)) for i, g in group.items()], "node_id string, community string")
    assert mine >= leiden.modularity(e, true).first()[0] - 0.02


def test_label_propagation_returns_when_rounds_are_up(spark):
    ring = [f"r{i:02}" for i in range(30)]
    n = spark.createDataFrame([(x, "t") for x in ring], NODE)
    e = spark.createDataFrame([(a, b, "e") for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], EDGE)
    out = graphs.label_propagation(n, e, rounds=2)
    assert out.count() == 30 and out.where("not settled").count() > 0
