"""Queries on small tables unlike the standard ones, against their SQL in DuckDB or a plain loop."""

from __future__ import annotations

import math
import random

import pytest

from weft import plans
from weft.operators import chunks, dense, edits, grams, ranking, records, redundant, sparse

duckdb = pytest.importorskip("duckdb")


def compared(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL) over the tables, given as (rows, columns), sorted by all columns."""
    con = duckdb.connect()
    for t, (rows, columns) in tables.items():
        path = f"{folder}/{t}.parquet"
        spark.createDataFrame(rows, columns).repartition(3).write.mode("overwrite").parquet(path)
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')")
    df = plans.QUERIES[name](spark, str(folder))
    columns = ", ".join(df.columns)
    here = sorted((tuple(r) for r in df.collect()), key=repr)
    return here, sorted(con.execute(f"select {columns} from ({plans.SQL[name]})").fetchall(), key=repr)


def test_headings_in_capitals_and_after_numbers(spark, tmp_path):
    lines = ["Is", "THE", "the", "The ", " That It.", "THAT IT.", "1. The end", "3) is", "2. Method and data", "2. Method", "The\x0b", "İs", "The ", ""]
    here, sql = compared(spark, tmp_path, "f22_headings", documents=([(1, "\n".join(lines)), (7, "The\nThe"), (8, "2. Method and data"), (9, None)], "doc_id long, text string"))
    assert here == sql and len(sql) == 10


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(n, copies, labels=3, seed=4):
    r = random.Random(seed)
    some = [[float(r.randint(-3, 3)) for _ in range(5)] + [1.0] for _ in range(n)]
    return [(i, some[r.randrange(copies)] if i % 3 else some[i], r.randrange(labels)) for i in range(n)], "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["v02_dense_knn", "v04_dbsf", "v07_hierarchical"])
def test_nearest_vectors_with_copies(spark, tmp_path, name):
    here, sql = compared(spark, tmp_path, name, embeddings=vectors(700, 300 if name == "v04_dbsf" else 4), documents=([(1, "none")], "doc_id long, text string"))
    assert len(here) == len(sql) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(here, sql, strict=True))
    assert "NestedLoopJoin" not in (p := plan(plans.QUERIES[name](spark, str(tmp_path)))) and "Aggregate" not in p and "MapInArrow" in p


def test_nearest_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(dense, "_STEP", 7)
    r, nan = random.Random(2), float("nan")
    odd = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [1.0] * 3, [nan, 1.0, 1.0, 1.0], [1e300] * 4]
    rows = [(i, odd[i % 20] if i % 20 < len(odd) else [float(r.randint(-2, 2)) for _ in range(4)], "ab"[i % 2] if i % 7 else None) for i in range(100)] + [(None, [1.0] * 4, "a")]
    table = spark.createDataFrame(rows, "id long, v array<double>, g string")
    asked = table.where("id % 5 = 0").withColumnRenamed("id", "q")

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or None in x + y:
            return 0.0
        dot = lambda a, b: sum(m * n for m, n in zip(a, b, strict=True))
        under = math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))
        return dot(x, y) / under if under else 0.0

    for within in (None, "g"):
        got = ranking.nearest(asked, table, 6, "q", "id", "v", block=8, within=within).collect()
        want = []
        for i, x, g in rows[:100:5]:
            each = [(cosine(x, y), j) for j, y, h in rows[:100] if i != j and (not within or (g is not None and g == h))]
            each.sort(key=lambda t: (-math.inf if math.isnan(t[0]) else -t[0], t[1]))
            want += [(i, j, k, str(round(s, 9) + 0.0)) for k, (s, j) in enumerate(each[:6])]
        assert sorted((x["query_id"], x["id"], x["rank"], str(round(x["score"], 9) + 0.0)) for x in got) == sorted(want)


def test_vector_merges_of_copies_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(dense, "TILE", 16)
    rows, _ = vectors(120, 5)
    rows = [(i, v, k if i % 11 else None) for i, v, k in rows] + [(200, None, 0), (201, [0.0] * 6, 0)]
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    into = {}
    for i, v, k in rows:
        near = [j for j, w, m in rows if j < i and into[j] == j and m == k and v and w and any(v) and any(w) and cos(v, w) >= 0.85]
        into[i] = min(near, default=i)
    out = records.vector_merges(spark.createDataFrame(rows, "id long, v array<float>, k int"), "id", "k", "v")
    assert {r["id"]: (r["kept"], r["into"]) for r in out.collect()} == {i: (i == j, j) for i, j in into.items()} and out.count() == len(rows)
    assert "NestedLoopJoin" not in plan(dense.similar_pairs(spark.createDataFrame(rows, "id long, vector array<float>, kind int"), 0.85))


@pytest.mark.parametrize("name", ["v03_sparse_knn", "v04_hybrid", "v10_local_search"])
def test_sparse_search_of_odd_texts(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(sparse, "_READ", 40)
    monkeypatch.setattr(sparse, "QUERIES", 3)
    r = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randrange(40))) for _ in range(250)]
    texts[7], texts[50], texts[60], texts[61] = None, texts[100], texts[100], texts[100]
    texts[8], texts[9], texts[10] = "", "word0 " * 300, "lonely"
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "word1 word2 word59"), (None, "word3 word4"), (None, "word3")]
    tables = {"documents": (rows, "doc_id long, text string"), "embeddings": vectors(250, 200)}
    if name == "v10_local_search":
        for t, (rows, columns) in tables.items():
            spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{t}.parquet")
        both = plans.QUERIES[name](spark, str(tmp_path))
        assert both.count() > 50 and both.groupBy("query_id").count().where("count > 60").isEmpty()
        assert "explode" not in plan(both)
    else:
        here, sql = compared(spark, tmp_path, name, **tables)
        assert here == sql and len(sql) > 40
        assert "explode" not in plan(plans.QUERIES[name](spark, str(tmp_path)))


SUPPLIERS = ([(i, f"Supplier#{i:09d}", i % 3 if i % 13 else None) for i in range(90)], "s_suppkey long, s_name string, s_nationkey int")
PARTS = ([(i, "hot metal" if i % 5 else None, f"Brand#{i % 4}", "LARGE", i % 7 if i % 17 else None) for i in range(300)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")


def test_many_rows_of_few_keys(spark, tmp_path):
    customers = [(i, f"Customer#{i:09d}", i % 3 if i % 11 else None) for i in range(200)], "c_custkey long, c_name string, c_nationkey int"
    tables = {"customer": customers, "supplier": SUPPLIERS, "part": PARTS}
    for name, n in (("f14_levenshtein", 4000), ("j04_pair_decision", 20000), ("j24_counter_evidence", 1000)):
        here, sql = compared(spark, tmp_path, name, **tables)
        assert here == sql and len(sql) > n
        p = plan(plans.QUERIES[name](spark, str(tmp_path)))
        assert name == "f14_levenshtein" or "_part" in p and p.split("SortMergeJoin")[0].count("Exchange") == 0


def test_edit_distances_of_odd_names(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abé𝄞") for _ in range(r.randrange(n)))
    rows = [[(i % 3 if i % 9 else None, i, [None, "", "a" * 70, "b" * 64, word(5), word(80), word(30)][i % 7]) for i in range(s, s + 60)] for s in (0, 100)]
    left, right = (spark.createDataFrame(x, "key int, id long, name string") for x in rows)

    def edits_between(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    got = sorted(map(tuple, edits.distances(left, right).collect()))
    assert got == sorted((a, b, None if x is None or y is None else edits_between(x, y)) for k, a, x in rows[0] for m, b, y in rows[1] if k is not None and k == m)
    assert "FlatMapGroupsInArrow" in plan(edits.distances(left, right))


def test_redundant_chunks_of_long_groups(spark, monkeypatch):
    monkeypatch.setattr(redundant, "_ROWS", 7)
    monkeypatch.setattr(redundant, "_ENTRIES", 100)
    r = random.Random(9)
    base = [[f"w{r.randrange(40)}" for _ in range(r.randrange(9))] for _ in range(25)]
    rows = [(i % 3 if i % 20 else None, i, " ".join(r.sample(x, len(x)) + ["Z"] * r.randrange(2)) if (x := r.choice(base)) or i % 2 else None) for i in range(150)]
    table = spark.createDataFrame(rows, "g int, id long, t string")
    sim = chunks.within_similarity(table, "g", "id", "t").where("similarity >= 0.5").collect()
    near, kept = {(x["a"], x["b"]) for x in sim}, set()
    for _, i, _ in rows:
        if not any((j, i) in near for j in kept):
            kept.add(i)
    out = redundant.without_redundant(table, "g", "id", "t", 0.5)
    assert sorted(x["id"] for x in out.collect()) == sorted(kept) and len(kept) < 100
    assert redundant.kept([["a"], [], ["a"], []], 0.5).tolist() == [True, True, False, True]


def test_chunks_of_a_query_make_no_pairs(spark, tmp_path):
    spark.createDataFrame([(i, f"Some text number {i % 4} that is long enough. " * 40) for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    p = plan(plans.QUERIES["c09_redundant_chunks"](spark, str(tmp_path)))
    assert "MapInArrow" in p and "Join" not in p


def test_backfill_of_evidence_of_several_papers(spark, tmp_path):
    r = random.Random(5)
    # Lines 1 to 12 of an order: line 11 of one is the evidence of line 1 of the next, of another part perhaps.
    lines = [(r.randrange(40), r.randint(1, 12), r.randrange(30), r.randrange(12), "N") for _ in range(400)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"),
        "orders": ([(i, "1-URGENT", "O") for i in range(38)], "o_orderkey long, o_orderpriority string, o_orderstatus string"),
        "supplier": ([(i, f"s{i}") for i in range(10)], "s_suppkey long, s_name string"),
        "part": ([(i, "name", "type") for i in range(27)], "p_partkey long, p_name string, p_type string"),
    }
    here, sql = compared(spark, tmp_path, "j27_backfill", **tables)
    assert here == sql and len(sql) == 10


def test_near_texts_by_grams(spark, monkeypatch):
    monkeypatch.setattr(grams, "_READ", 9)
    r = random.Random(4)
    base = ["".join(r.choice("ab é𝄞\0") for _ in range(60)) for _ in range(12)] + ["a", "ab", "abcd", "a\0"]
    rows = [(i, t if i % 3 else t[:-1] + "x") for i, t in enumerate(r.choices(base, k=90))]
    of = lambda t: {t[i : i + 5] for i in range(max(len(t) - 4, 1))}
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and len(of(x) & of(y)) >= 0.8 * len(of(x) | of(y)))
    near = grams.similar(spark.createDataFrame(rows, "id long, t string"), 0.8, 5)
    assert sorted(map(tuple, near.collect())) == want and len(want) > 50
    assert "MapInArrow" in plan(near)
