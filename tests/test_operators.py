from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import rules, scores, text
from weft.operators import chunks, collections, evidence, graphs, ranking, records, reports, scopes, store


def one(spark, c, **columns):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    names = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else kinds.get(type(v), 'string')}" for k, v in columns.items()) or "x int"
    return spark.createDataFrame([tuple(columns.values()) or (1,)], names).select(c.alias("out")).first()["out"]


@pytest.mark.parametrize("doi,want", [(" https://doi.org/10.1/AB ", "10.1/ab"), ("DOI:10.1/x", "10.1/x"), ("http://dx.doi.org/10.1/x", "http://dx.doi.org/10.1/x"), (None, "")])
def test_doi(spark, doi, want):
    assert one(spark, text.normalize_doi(F.col("d")), d=doi) == want


@pytest.mark.parametrize("name,want", [("Smith, John Paul", "smith jp"), ("John Paul Smith", "smith jp"), ("Plato", "plato"), ("", ""), ("  ", ""), ("Doe,", "doe")])
def test_author(spark, name, want):
    assert one(spark, text.normalize_author(F.col("a")), a=name) == want


@pytest.mark.parametrize("label,want", [("Large_Language-Models", "llm"), ("ＬＬＭｓ", "llm"), ("glass", "glass"), ("graph neural networks.", "gnn"), ("analysis", "analysi"), ("bus", "bus"), (" A。b ", "a b"), (" A；b ", "a;b")])
def test_label(spark, label, want):
    assert one(spark, text.normalize_label(F.col("x"), rules.ALIASES), x=label) == want


@pytest.mark.parametrize("raw,want", [('{"a": 1}', '{"a":1}'), ('say ```json\n{"a": 2}\n``` ok', '{"a":2}'), ("x {'a': 3,} y", '{"a":3}'), ("none", None)])
def test_json(spark, raw, want):
    assert one(spark, text.parsed_json(F.col("x")), x=raw) == want


def test_repair(spark):
    raw = "computa-\ntion (cid:12)of ﬁne aB a(b)c word [1, 2]\n - 12 -\nend"
    assert one(spark, text.repaired(F.col("x")), x=raw) == "computation of fine a B a (b) c word[1, 2]\nend"


def test_redact(spark):
    raw = "key sk-" + "a" * 24 + " Bearer abc.def api_key: 12 C:\\Users\\me /home/me/x"
    assert one(spark, text.redact(F.col("x")), x=raw) == "key [REDACTED_API_KEY] Bearer [REDACTED_TOKEN] api_key=[REDACTED] [REDACTED_PATH] [REDACTED_PATH]"
    assert one(spark, text.redact(F.col("x")), x="b" * 300) == "b" * 200 + "...[300chars]"


def test_similarities_of_empty_texts(spark):
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a="", b="x") == 0
    assert one(spark, text.fuzzy_match(F.col("a"), F.col("b")), a=" ", b="x") == 0
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_intent_and_limits(spark):
    assert one(spark, text.first_match(F.col("x"), rules.INTENTS, "summary"), x="Compare the Methods") == "method_compare"
    assert one(spark, text.first_match(F.col("x"), rules.LIMITATION_TYPES, "unknown"), x="a SMALL sample of one dataset") == "sample_size"
    assert one(spark, scores.gap_confidence(F.array(F.lit("future_work"), F.lit("possible_gap")), F.lit("high"), F.lit(5), F.lit(True))) == pytest.approx(1.0)


def test_citations(spark):
    a = ["Ann Lee", "B. C. Doe", "Max", "Eva Noe"]
    c = lambda s: scores.citation(s, F.lit("p:1"), F.lit("T"), F.col("a"), F.lit(2001), F.lit("V"), F.lit("10.1/x"))
    assert one(spark, c("apa"), a=a) == "Lee, A., Doe, B.C., Max, Noe, E. (2001). T. V. https://doi.org/10.1/x"
    assert one(spark, c("gbt7714"), a=a) == "Ann Lee, B. C. Doe, Max, et al. T[J]. V, 2001. DOI: 10.1/x."
    assert one(spark, c("simple"), a=a) == "[p:1] Ann Lee, B. C. Doe, Max (2001). T. DOI: 10.1/x"
    assert one(spark, c("bibtex"), a=a).startswith("@article{lee2001,\n  title = {T},\n  author = {Ann Lee and B. C. Doe")


def test_upsert_and_page(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k int, s string, unknown int")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"]).collect()) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", None)]
    rows, total = store.page(old, 0, 1000, {"s": []}, [F.asc("k")])
    assert rows.count() == 0 and total.first()["total"] == 0
    tagged = old.withColumn("tags", F.array("s"))
    assert store.select_where(tagged, {"tags": {"$contains": "b"}, "k": {"$eq": 2}, "s": {"$odd": 1}}).count() == 1


def test_keep_first_is_sequential(spark):
    r = random.Random(1)
    pairs = {tuple(sorted(r.sample(range(40), 2))) for _ in range(60)}
    kept = []
    for i in range(40):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    ids = spark.createDataFrame([(i,) for i in range(40)], "id long")
    got = records.keep_first(ids, spark.createDataFrame(list(pairs), "a long, b long"))
    assert sorted(r["id"] for r in got.collect()) == kept


def test_similar_word_sets(spark):
    r = random.Random(2)
    rows = [(i, [f"w{r.randrange(12)}" for _ in range(r.randrange(9))]) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, t array<string>")
    got = {(x["a"], x["b"]) for x in records.similar_word_sets(d, "id", F.col("t"), 0.7).collect()}
    s = {i: set(t) for i, t in rows if t}
    assert got == {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.7 * len(s[a] | s[b]) - 1e-12}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 9), unique=True, max_size=6), min_size=1, max_size=3))
def test_fusion_is_the_sum_over_lists(spark, lists):
    frames = [spark.createDataFrame([(x, k) for k, x in enumerate(one_list)], "id long, rank int") for one_list in lists]
    got = {r["id"]: r["rrf"] for r in ranking.fuse(frames, ["id"]).collect()}
    want: dict[int, float] = {}
    for one_list in lists:
        for k, x in enumerate(one_list):
            want[x] = want.get(x, 0) + 1 / (61 + k)
    assert got == pytest.approx(want)


def simulated(seed, n):
    r = random.Random(seed)
    return [(i, r.random(), r.random()) for i in range(n)]


@pytest.mark.parametrize("case", ["normal", "disagree", "no overlap", "same"])
def test_fusion_scenarios(spark, case):
    rows = simulated(42, 20)
    dense = sorted(rows, key=lambda x: -x[1])[:10]
    sparse = {"normal": sorted(rows, key=lambda x: -x[2])[:10], "disagree": sorted(rows, key=lambda x: x[1])[:10], "no overlap": [(100 + i, 0, 0) for i in range(10)], "same": dense}[case]
    frame = lambda x: spark.createDataFrame([(i, k) for k, (i, *_) in enumerate(x)], "id long, rank int")
    got = {r["id"]: r["score"] for r in ranking.intersect_ranks(frame(dense), frame(sparse), ["id"], 10).collect()}
    place = {i: k for k, (i, *_) in enumerate(sparse)}
    assert got == pytest.approx({i: 1 - (k + place[i]) / 20 for k, (i, *_) in enumerate(dense) if i in place})


def test_budget_and_floor(spark):
    d = spark.createDataFrame([("a", i, c) for i, c in enumerate([5, 5, 9, 1])], "g string, i int, c int")
    assert [r["i"] for r in ranking.within_budget(d, "c", 11, [F.asc("i")], ["g"]).collect()] == [0, 1]
    few = ranking.at_least(d.withColumn("s", F.col("c") / 10.0), "s", 0.95, 3, [F.asc("i")], ["g"])
    assert sorted(r["i"] for r in few.collect()) == [0, 1, 2]


def test_graph(spark):
    e = spark.createDataFrame([(a, b, "x") for a, b in [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("e", "f")]], "src string, dst string, edge_type string")
    n = spark.createDataFrame([(c, "t") for c in "abcdefg"], "node_id string, node_type string")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert {(r["node"], r["hop"]) for r in graphs.neighbours(seeds, e, 5).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    p = graphs.paths(spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "f")], "src string, dst string"), e)
    assert sorted("".join(r["path"]) for r in p.collect()) == ["a", "abc", "adc"]
    c = {r["node_id"]: r["community"] for r in graphs.label_propagation(n, e).collect()}
    assert c["g"] == "g" and len({c["e"], c["f"]} & {"e", "f"}) >= 1 and len(c) == 7
    stats = {(r["kind"], r["name"]): r["n"] for r in graphs.statistics(n, e).collect()}
    assert stats == {("node", "t"): 7, ("edge", "x"): 5, ("isolated", "all"): 1}
    m = graphs.contracted(e, spark.createDataFrame([("b", "a")], "node_id string, into string"))
    assert {(r["src"], r["dst"]) for r in m.collect()} == {("a", "c"), ("c", "d"), ("a", "d"), ("e", "f")}
    pairs, total = graphs.missing_pairs(spark.createDataFrame([(x,) for x in "ab"], "l string"), spark.createDataFrame([(x,) for x in "xyz"], "r string"), spark.createDataFrame([("a", "x"), ("q", "x")], "l string, r string"))
    assert [tuple(r) for r in pairs.collect()] == [("a", "y"), ("a", "z"), ("b", "x"), ("b", "y"), ("b", "z")] and total.first()["n_missing"] == 5


def test_incremental_build_is_the_full_one(spark):
    rows = spark.createDataFrame([(f"m{i % 4}", i, 10 * i) for i in range(20)] + [("unknown", 1, 1), (" ", 2, 2)], "m string, p long, e long")
    make = lambda d: graphs.mentions(d, "method", F.col("m"), F.col("p"), F.col("e"))
    full = sorted(map(tuple, make(rows).collect()))
    assert sorted(map(tuple, graphs.merge_graphs(make(rows.where("p < 7")), make(rows.where("p >= 7"))).collect())) == full
    kept, _ = graphs.without_paper(make(rows.where("p < 4")), spark.createDataFrame([], "src string, dst string"), 1)
    assert {r["label"] for r in kept.collect()} == {"m0", "m2", "m3"}
    assert {(r["label"], r["papers"], r["evidence"]) for r in graphs.counted(make(rows)).collect()} == {(f"m{k}", 5, 5) for k in range(4)}


def test_labels_come_to_rest(spark):
    """A bipartite graph, on which labels that all change at once swap for ever."""
    e = spark.createDataFrame([(f"a{i}", f"b{j}", "x") for i in range(6) for j in range(6) if (i < 3) == (j < 3)] + [("a0", "b5", "x")], "src string, dst string, edge_type string")
    n = spark.createDataFrame([(f"{c}{i}",) for c in "ab" for i in range(6)] + [("alone",)], "node_id string")
    label = {r["node_id"]: r["community"] for r in graphs.label_propagation(n, e).collect()}
    around = {}
    for r in e.collect():
        around.setdefault(r["src"], []).append(label[r["dst"]])
        around.setdefault(r["dst"], []).append(label[r["src"]])
    assert label["alone"] == "alone"
    assert all(near.count(label[k]) == max(map(near.count, near)) for k, near in around.items())


def brute_keep(ids, pairs):
    kept, at = [], {}
    for a, b in pairs:
        at.setdefault(b, set()).add(a)
    for i in sorted(ids):
        if not at.get(i, set()) & set(kept):
            kept.append(i)
    return kept


def test_greedy_passes(spark):
    r = random.Random(8)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)}
    ids = spark.createDataFrame([(i,) for i in range(60)], "id long")
    d = spark.createDataFrame(sorted(pairs), "a long, b long")
    kept = brute_keep(range(60), pairs)
    assert sorted(x["id"] for x in records.keep_first(ids, d).collect()) == kept
    for x in records.merged_into(ids, d).collect():
        assert x["kept"] == (x["id"] in kept)
        assert x["into"] == (x["id"] if x["kept"] else min(a for a, b in pairs if b == x["id"] and a in kept))
    assert records.keep_first(ids, d.limit(0)).count() == 60 and records.keep_first(ids.limit(0), d.limit(0)).count() == 0


def test_near_texts_and_vectors(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice((0, 3, 40, 200)))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base + [t[:-2] + "zz" for t in base] + base[:5])] + [(99, None)]
    grams = lambda t: {t.lower()[i : i + 5] for i in range(max(len(t) - 4, 1))} if t else set()
    alike = lambda x, y: bool(x and y) and len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y))
    pairs = {(a, b) for a, x in rows for b, y in rows if a < b and alike(x, y)}
    got = chunks.without_near_copies(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert sorted(x["id"] for x in got) == brute_keep([i for i, _ in rows], pairs)
    vectors = [(i, i % 2, [r.gauss(0, 1) for _ in range(3)]) for i in range(50)] + [(50, 0, [0.0] * 3), (51, 0, None)]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    cos = lambda x, y: dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y and any(x) and any(y) else 0
    pairs = {(a, b) for a, k, x in vectors for b, m, y in vectors if a < b and k == m and cos(x, y) >= 0.85}
    out = records.vector_merges(spark.createDataFrame(vectors, "id long, k int, v array<double>"), "id", "k", "v").collect()
    assert sorted(x["id"] for x in out if x["kept"]) == brute_keep([i for i, _, _ in vectors], pairs) and len(out) == 52


def test_quotes_and_counter_evidence(spark):
    r = random.Random(6)
    q = [(i, r.sample("abcdefghij", r.randint(0, 6))) for i in range(20)]
    t = [(i, r.sample("abcdefghijkl", r.randint(0, 9))) for i in range(40)]
    kind = "{} long, words array<string>"
    a, b = spark.createDataFrame(q, kind.format("q")), spark.createDataFrame(t, kind.format("t"))
    got = {(x["q"], x["t"]): round(x["share"], 6) for x in records.quotes_held(a, "q", F.col("words"), b, "t", F.col("words")).collect()}
    assert got == {(i, j): round(len(set(x) & set(y)) / len(x), 6) for i, x in q for j, y in t if x and len(set(x) & set(y)) >= 0.6 * len(x)}
    both = {tuple(x) for x in evidence.counter_evidence(a, b, "q", "t").collect()}
    assert both == {(i, j) for i, x in q for j, y in t if len(set(x) & set(y)) >= 2}


def test_scopes(spark):
    p = spark.createDataFrame([(1, 2000, "a", False), (2, 2001, "a", None), (3, None, "b", True), (None, 2000, "a", False), (1, 2000, "a", False)], "paper_id long, year int, project string, out boolean")
    ids = lambda d: sorted(x["paper_id"] for x in d.collect())
    assert ids(scopes.all_papers(p, F.col("out"))) == [1, 2]
    assert ids(scopes.by_years(p, 2001, "2000")) == [1, 2] and ids(scopes.by_years(p, None, 2000)) == [1] and ids(scopes.by_years(p, "n", None)) == [1, 2]
    want = spark.createDataFrame([(1,), (3,), (3,), (9,), (None,)], "paper_id long")
    got = {x["paper_id"]: x["reason"] for x in scopes.selected(want, p.where("paper_id is not null").dropDuplicates(), F.col("project") == "a", F.col("out")).collect()}
    assert got == {1: "valid", 3: "project_mismatch", 9: "not_found"}
    assert ids(scopes.in_all(scopes.scope_of(p), p.where("year = 2000"))) == [1]
    said = spark.createDataFrame([("x", 1), ("x", 5), ("y", 1)], "answer string, paper_id long")
    assert {x["answer"]: (x["violations"], x["score"]) for x in scopes.violations(said, scopes.scope_of(p)).collect()} == {"x": (1, 0.9), "y": (0, 1.0)}
    assert scopes.by_topics(spark.createDataFrame([(1, "Big Data"), (2, None)], "paper_id long, topic string"), ["data"]).count() == 1
    assert scopes.widened(p, F.col("year") == 2001, 2).count() == 5 and scopes.widened(p, F.col("year") == 2001, 1).count() == 1
    assert scopes.all_papers(p.limit(0), F.col("out")).count() == 0


def test_evidence(spark):
    refs = spark.createDataFrame([(1, 2), (1, 7), (2, 2), (3, 7), (4, None)], "citing long, key long")
    known = spark.createDataFrame([(2,)], "key long")
    assert sorted(tuple(x) for x in evidence.cites(refs.where("key is not null"), known, "citing", "key").collect()) == [(1, "2"), (1, "ghost:7"), (3, "ghost:7")]
    assert [tuple(x) for x in evidence.ghosts(refs, known, "citing", "key").collect()] == [(7, 2)]
    assert tuple(evidence.traceability(refs.where("key is not null"), known, "key").first()) == (2, 1, 0.5)
    assert evidence.traceability(refs.limit(0), known, "key").first()["coverage"] == 1.0
    e = spark.createDataFrame([(1, "a", "high"), (2, "a", "low"), (2, "a", "low"), (3, "b", None)], "paper_id long, topic string, strength string")
    c = {x["key"]: (x["n"], x["papers"], x["confidence"]) for x in evidence.clustered(e, F.col("topic"), 0.4, 0.1, 0.9, 2).collect()}
    assert c == {"a": (3, 2, 0.6)}
    assert {x["node"]: (x["papers"], x["first"]) for x in evidence.provenance(e.select(F.col("topic").alias("node"), "paper_id"), "node", 1).collect()} == {"a": (2, [1]), "b": (1, [3])}
    s = evidence.consensus(e, "topic", F.col("paper_id") == 1, F.col("paper_id") == 2).orderBy("topic").collect()
    assert s[0]["score"] == round((1 - 0.8) / 1.8, 4) and s[1]["score"] is None


def test_collections(spark):
    d = spark.createDataFrame([("p", "1", "b"), ("p", "1", "a"), ("q", "1", "c"), ("p", None, "d")], "project_id string, document_id string, text string")
    c = collections.put(collections.empty(spark), d)
    assert sorted(x["text"] for x in c.collect()) == ["b", "c", "d"]
    c = collections.put(c, d.where("text = 'a'"))
    assert sorted(x["text"] for x in c.collect()) == ["a", "c", "d"] and c.columns == collections.empty(spark).columns


def test_packed_paragraphs(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(60))
    cases = [None, " ", "one short text", "a b\n\nc d", f"intro here\n\n{long}\n\nend", "\n\n".join(["word " * 30] * 9)]
    got = [x["c"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i").select(chunks.packed_paragraphs(F.col("t"), 100).alias("c")).collect()]
    assert got[:4] == [[], [], ["one short text"], ["a b\n\nc d"]]
    assert all(len(c) // 4 <= 125 for x in got for c in x)
    assert "".join("".join(got[4]).split()) == "".join(cases[4].split()) and len(got[5]) == 5


def brute_packed(sentences, most):
    out, now, n = [], "", 0
    for s in sentences:
        t = len(s) // 4
        if n > 0 and n + t > most:
            out.append(now)
            now, n = s, t
        else:
            now, n = (s if now == "" else f"{now} {s}"), n + t
    return [*out, now] if now else out


def test_chunks(spark):
    r = random.Random(3)
    s = ["x" * r.randint(1, 60) + "." for _ in range(50)]
    got = spark.createDataFrame([(" ".join(s),), (None,), ("",)], "t string").select(chunks.packed(F.col("t"), 20).alias("c")).collect()
    assert got[0]["c"] == brute_packed(s, 20) and got[1]["c"] == [] and got[2]["c"] == []


def test_fragments_and_parents(spark):
    kind = "x array<struct<section:string,text:string>>"
    d = spark.createDataFrame([([("a", "t" * 40), ("a", "u" * 8), ("b", "v" * 8), ("b", "w" * 8), ("a", "z" * 400)],), ([],)], kind)
    m = d.select(chunks.merged_fragments(F.col("x"), 5, 50).alias("m"), chunks.parents(F.col("x"), 10).alias("p")).collect()
    assert [(c["section"], len(c["text"])) for c in m[0]["m"]] == [("a", 49), ("b", 17), ("a", 400)] and m[1]["m"] == []
    assert m[0]["p"] == [0, 1, 2, 2, 3] and m[1]["p"] == []


def test_reports(spark):
    d = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, "a")], "x string, y string")
    got = [tuple(r["d"]) for r in d.select(reports.paragraph_diff("x", "y").alias("d")).collect()]
    assert got == [(1, 0, 1, 2), (1, 0, 0, 0)]
    v = spark.createDataFrame([("r", 1, "one"), ("r", 2, "two")], "k string, n int, content string")
    put = lambda e: spark.createDataFrame([("r", 1, e)], "k string, n int, expected int")
    assert [tuple(r) for r in reports.restored(v, "k", "n", put(2)).collect()] == [("r", 3, "one")]
    assert reports.restored(v, "k", "n", put(1)).count() == 0
    s = spark.createDataFrame([("a", "verified"), ("a", "contradicted"), ("b", "verified"), ("c", "unverified")], "k string, o string")
    assert {r["k"]: r["verdict"] for r in reports.verdicts(s, "k", "o").collect()} == {"a": "contradicted", "b": "verified", "c": "unverified"}


def test_every_rule_has_fields():
    assert set(rules.INTENTS) <= set(rules.INTENT_FIELDS)
    assert len(list(itertools.chain(*rules.LIMITATION_TYPES.values()))) > 20
