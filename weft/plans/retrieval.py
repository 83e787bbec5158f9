"""Retrieval over documents and vectors, chunking, answers, reports, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import rules, text
from weft.operators import chunks, graphs, lineage, ranking, records, reports, scanner, scopes, sparse, store
from weft.operators import evidence as evidence_ops
from weft.plans.registry import query, table
from weft.plans.tables import EVIDENCE, evidence
from weft.streaming import tasks

_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 2)"


def terms(c="text"):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)


_POST = f"p AS (SELECT doc_id AS id, term, count(*) AS tf, any_value(n) AS size FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {_TERMS} AS t FROM documents)) GROUP BY ALL)"
_QUERIES = f"q AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark)"


def posted(spark, sf):
    return ranking.postings(table(spark, sf, "documents"), "doc_id", terms())


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(terms())).alias("term"))


_TFIDF = f"{_POST}, d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM p GROUP BY term ORDER BY total DESC, term LIMIT 10000), w AS (SELECT id, p.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM p JOIN d USING (term)), v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"


def weights(spark, sf):
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    return ranking.tf_idf(posted(spark, sf), n)


@query("v01_tf_idf", f"WITH {_TFIDF} SELECT id, term, round(weight, 6) AS weight FROM v")
def v01(spark, sf):
    return weights(spark, sf).withColumn("weight", F.round("weight", 6))


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
_KNN = f"s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)"


def near(spark, sf, k, corpus=None):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ranking.nearest(q, (corpus if corpus is not None else e).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k)


@query("v02_dense_knn", f"WITH {_KNN} SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def v02(spark, sf):
    return near(spark, sf, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("v05_filtered_knn", f"WITH {_KNN.replace('% 50 = 0)', '% 50 = 0 AND c.label IN (1, 2))')} SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5")
def v05(spark, sf):
    return near(spark, sf, 5, table(spark, sf, "embeddings").where(F.col("label").isin(1, 2))).select("query_id", "id", F.round("score", 6).alias("score"))


_SPARSE = f"{_TFIDF}, qv AS (SELECT id AS query_id, term, weight FROM v WHERE id % 50 = 0), sp AS (SELECT query_id, v.id, sum(v.weight * qv.weight) AS score FROM v JOIN qv USING (term) WHERE v.id <> query_id GROUP BY ALL)"


def sparse_near(spark, sf, k):
    return ranking.ranked(sparse.nearest(table(spark, sf, "documents"), "doc_id", terms(), "id % 50 = 0", k), "score", "id", ["query_id"], most=k)


@query("v03_sparse_knn", f"WITH {_SPARSE} SELECT query_id, id, round(score, 6) AS score FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) <= 10")
def v03(spark, sf):
    return sparse_near(spark, sf, 10).select("query_id", "id", "score")


_BOTH = f"{_SPARSE}, {_KNN}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s QUALIFY rank < 20), b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM sp QUALIFY rank < 20)"


@query("v04_hybrid", f"WITH {_BOTH} SELECT query_id, id, round(rrf, 8) AS rrf FROM (SELECT query_id, id, sum(1.0 / (61 + rank)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 8) DESC, id) <= 10")
def v04(spark, sf):
    f = ranking.fuse([near(spark, sf, 20), sparse_near(spark, sf, 20)], ["query_id", "id"]).withColumn("rrf", F.round("rrf", 8))
    return ranking.ranked(f, "rrf", "id", ["query_id"], most=10).select("query_id", "id", "rrf")


@query("v04_dbsf", f"WITH {_BOTH.replace('AS rank FROM s QUALIFY', 'AS rank, score FROM s QUALIFY')}, m AS (SELECT query_id, id, least(1, greatest(0, (score - (avg(score) OVER w - 3 * stddev_pop(score) OVER w)) / (6 * stddev_pop(score) OVER w))) AS x FROM a WINDOW w AS (PARTITION BY query_id)) SELECT query_id, id, round(x, 6) AS scaled FROM m")
def v04_dbsf(spark, sf):
    return ranking.distribution_scores(near(spark, sf, 20), "score", ["query_id"]).select("query_id", "id", F.round("scaled", 6).alias("scaled"))


_BM = f"{_POST}, {_QUERIES}, sz AS (SELECT DISTINCT id, size FROM p), n AS (SELECT count(*) AS n, avg(size) AS a FROM sz), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), bm AS (SELECT query_id, p.id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.6 + 0.4 * size / n.a))) AS score FROM p JOIN d USING (term) JOIN q USING (term), n GROUP BY ALL)"


@query("d01_bm25", f"WITH {_BM} SELECT query_id, id, round(score, 5) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, id) <= 20")
def d01(spark, sf):
    s = ranking.bm25(asked(spark, sf), *ranking.asked_postings(table(spark, sf, "documents"), "doc_id", terms(), asked(spark, sf))).withColumn("score", F.round("score", 5))
    return ranking.ranked(s, "score", "id", ["query_id"], most=20).select("query_id", "id", "score")


_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2)"
_FIELDS = f"f AS (SELECT doc_id AS id, 3.5 AS w, {_TOK.format('text')} AS t FROM documents UNION ALL SELECT doc_id, 2.0, {_TOK.format('split_part(text, chr(10), 1)')} FROM documents UNION ALL SELECT doc_id, 0.5, {_TOK.format('source')} FROM documents), p AS (SELECT id, term, sum(w) AS tf FROM (SELECT id, w, unnest(t) AS term FROM f) GROUP BY ALL), sz AS (SELECT id, sum(w * len(t)) AS size FROM f GROUP BY id)"


@query("d01_field_bm25", f"WITH {_FIELDS}, {_QUERIES}, n AS (SELECT count(*) AS n, avg(size) AS a FROM sz WHERE size > 0), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), bm AS (SELECT query_id, p.id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.6 + 0.4 * size / n.a))) AS score FROM p JOIN sz USING (id) JOIN d USING (term) JOIN q USING (term), n GROUP BY ALL) SELECT query_id, id, round(score, 5) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, id) <= 20")
def d01_fields(spark, sf):
    """Text, first line and source weighed as fields."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("abstract"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("venue"))
    fields = [(terms(c), rules.FIELD_WEIGHTS[c]) for c in ("abstract", "title", "venue")]
    s = ranking.bm25(asked(spark, sf), *ranking.field_postings(d, "doc_id", fields, asked(spark, sf))).withColumn("score", F.round("score", 5))
    return ranking.ranked(s, "score", "id", ["query_id"], most=20).select("query_id", "id", "score")


_GRAMS = "SELECT {0}, list_distinct(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query("d02_phrase_bonus", f"WITH q AS (SELECT item_id, unnest(g) AS g FROM ({_GRAMS.format('item_id')} FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark))), a AS (SELECT doc_id, unnest(g) AS g FROM ({_GRAMS.format('doc_id')} FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents))), t AS (SELECT doc_id, unnest(g) AS g FROM ({_GRAMS.format('doc_id')} FROM (SELECT doc_id, {_WORDS.format('split_part(text, chr(10), 1)')} AS w FROM documents))) SELECT item_id, doc_id, round(sum(b), 4) AS bonus FROM (SELECT item_id, doc_id, 0.3 AS b FROM q JOIN a USING (g) UNION ALL SELECT item_id, doc_id, 1.0 FROM q JOIN t USING (g)) GROUP BY ALL")
def d02(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return ranking.phrase_bonus(table(spark, sf, "benchmark"), "item_id", "text", d, "doc_id", {"title": 1.0, "text": 0.3}).withColumn("bonus", F.round("bonus", 4))


_RANK = r"""WITH d AS (SELECT min(doc_id) AS doc_id, text, any_value(lang) AS lang FROM documents GROUP BY text), c AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, len(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS u FROM d),
a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n DESC, doc_id) - 1 AS k FROM c QUALIFY k < 60), b AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY u DESC, doc_id) - 1 AS k FROM c QUALIFY k < 60)
SELECT lang, doc_id, round(sum(1.0 / (61 + k)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"""


@query("v06_hybrid_rank", _RANK)
def v06(spark, sf):
    """Distinct documents of each language, ranked by two signals and fused."""
    d = store.first_of(table(spark, sf, "documents").select("doc_id", "lang", "text", F.xxhash64("text").alias("h")), ["h", "text"], [F.asc("doc_id")])
    w = text.words(F.col("text"))
    c = d.select("doc_id", "lang", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("u"))
    lists = [ranking.ranked(c, s, "doc_id", ["lang"], most=60) for s in ("n", "u")]
    return ranking.fuse(lists, ["lang", "doc_id"]).withColumn("rrf", F.round("rrf", 8))


_HIER = "l0 AS (SELECT vec_id AS q, label AS paper FROM embeddings WHERE vec_id % 50 = 0), l1 AS (SELECT q, c.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM l0 JOIN embeddings e ON e.vec_id = q JOIN embeddings c ON c.label = paper AND c.vec_id <> q)"


@query("v07_hierarchical", f"WITH {_HIER} SELECT q AS query_id, id, round(score, 6) AS score FROM l1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 5")
def v07(spark, sf):
    """The level above selects groups; the level below is searched within them."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    top = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return ranking.nearest(top, e, 5, within="label").select("query_id", "id", F.round("score", 6).alias("score"))


@query("v08_evidence_score", f"WITH {EVIDENCE} SELECT evidence_id, 8 + (contains(lower(limitation), 'high')::INT + contains(lower(limitation), 'urgent')::INT) + (contains(lower(finding), 'high')::INT + contains(lower(finding), 'urgent')::INT) + CASE WHEN contains(lower(topic), 'high') OR contains(lower(topic), 'urgent') THEN 2 ELSE 0 END + CASE WHEN contains(lower(method), 'high') THEN 2 ELSE 0 END + CASE strength WHEN 'high' THEN 1 WHEN 'low' THEN -2 ELSE 0 END AS score FROM evidence")
def v08(spark, sf):
    e = evidence(spark, sf)
    fields = {c: F.col(c) for c in ("finding", "limitation", "future_work", "topic", "method")}
    asked_for = F.array(F.lit("high"), F.lit("urgent"))
    s = reports.evidence_score(asked_for, "limitation_analysis", fields, F.col("strength"), F.lit(""))
    return e.select("evidence_id", s.alias("score"))


# Chunks -----------------------------------------------------------------------------


@query("c01_chunks")
def c01(spark, sf):
    """Sentences packed into chunks; a fold, no SQL."""
    return chunks.chunked(table(spark, sf, "documents"), "doc_id", "text", 100).select("doc_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text"), "token_count")


@query("c01_section_scan")
def c01_scan(spark, sf):
    """Conversations as papers: each turn a page that a heading by its role begins; scanned line by line with state. Tested against a plain loop."""
    named = F.create_map(*map(F.lit, ("system", "Abstract", "user", "1. Introduction", "assistant", "Results")))
    pages = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("\n", named[F.col("role")], "text").alias("page"))
    return scanner.scanned(pages, "conv_id", "turn", "page").withColumn("text", F.md5(F.col("text").cast("binary")))


@query("w08_merge_fragments")
def w08(spark, sf):
    """Turns as chunks, small ones merged into the one before of the same role; a fold, no SQL."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("section"), "text"))).alias("x"))
    m = chunks.merged_fragments(F.transform("x", lambda t: F.struct(t["section"].alias("section"), t["text"].alias("text"))), 100, 500)
    return c.select("conv_id", F.size("x").alias("before"), F.size(m).alias("after"))


@query("w09_parents")
def w09(spark, sf):
    """Turns grouped into parents; a fold, no SQL."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("section"), "text"))).alias("x"))
    p = chunks.parents(F.transform("x", lambda t: F.struct(t["section"].alias("section"), t["text"].alias("text"))), 200)
    return c.select("conv_id", F.posexplode(p).alias("turn", "parent"))


@query("c05_near_chunks")
def c05(spark, sf):
    """Chunks of all documents; character five-grams at 0.8 or more; of similar ones the earliest kept one stays, greedily. Tested against a plain loop, as all pairs are slow in SQL."""
    c = chunks.chunked(table(spark, sf, "documents"), "doc_id", "text", 100).withColumn("id", F.struct("doc_id", "chunk_index"))
    return chunks.without_near_copies(c, "id", "text").select("id.*")


@query("c06_bm25_similarity", r"WITH t AS (SELECT conv_id AS g, turn AS id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9]+')) AS term FROM conversations), w AS (SELECT g, id, term, count(*) AS tf FROM t GROUP BY ALL), z AS (SELECT g, id, sum(tf) AS size FROM w GROUP BY ALL), n AS (SELECT g, count(*) AS n, avg(size) AS a FROM z GROUP BY g), d AS (SELECT g, term, count(*) AS df FROM w GROUP BY ALL), s AS (SELECT w.g, w.id, w.term, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / a)) AS s FROM w JOIN z USING (g, id) JOIN n USING (g) JOIN d USING (g, term)), x AS (SELECT a.g, b.id AS q, a.id, sum(a.s * b.tf) AS score FROM s a JOIN s b ON a.g = b.g AND a.term = b.term GROUP BY ALL) SELECT x.g AS conv_id, least(x.q, x.id) AS a, greatest(x.q, x.id) AS b, round(sum(x.score / o.score) / 2, 5) AS similarity FROM x JOIN x o ON o.g = x.g AND o.q = x.q AND o.id = x.q WHERE x.q <> x.id GROUP BY ALL")
def c06(spark, sf):
    return chunks.within_similarity(table(spark, sf, "conversations"), "conv_id", "turn", "text").withColumn("similarity", F.round("similarity", 5))


@query("c07_similar_turns")
def c07(spark, sf):
    """Of similar turns of a conversation the first stays, whatever is similar only to one that went; greedy."""
    sim = chunks.within_similarity(table(spark, sf, "conversations"), "conv_id", "turn", "text").where("similarity >= 0.3")
    turn = lambda c: F.struct("conv_id", F.col(c).alias("turn"))
    pairs = sim.select(turn("a").alias("a"), turn("b").alias("b"))
    ids = table(spark, sf, "conversations").select(turn("turn").alias("id"))
    return records.keep_first(ids, pairs).select("id.*")


@query("c12_rule_card", r"SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: contains(lower(x), ' that ') AND length(x) > 10 AND length(x) < 500)[1], 'unknown') AS finding FROM documents")
def c12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.get(text.cue_sentences(F.col("text"), [" that "]), F.lit(0)), F.lit("unknown")).alias("finding"))


@query("c13_card_score", "SELECT p_partkey AS card, round(0.4 * (1 + (p_size > 10)::INT + (p_size > 30)::INT) / 3.0 + 0.4 * (p_partkey % 5) / 4.0 + 0.2 * CASE WHEN contains(p_name, 'al') THEN 0 ELSE 1 END, 6) AS quality FROM part")
def c13(spark, sf):
    full = (1 + (F.col("p_size") > 10).cast("int") + (F.col("p_size") > 30).cast("int")) / 3.0
    q = 0.4 * full + 0.4 * (F.col("p_partkey") % 5) / 4.0 + 0.2 * F.when(text.holds_any(F.col("p_name"), ["al"]), 0).otherwise(1)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("card"), F.round(q, 6).alias("quality"))


@query("c14_validate_spans", r"WITH s AS (SELECT p_partkey AS card, p_partkey AS span, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_brand ELSE p_type || ' unheard' END AS quote FROM part), c AS (SELECT p_partkey AS span, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part WHERE p_partkey % 7 > 0), w AS (SELECT card, s.span, quote, text, list_distinct(list_filter(regexp_split_to_array(lower(quote), '\s+'), lambda w: w <> '')) AS q FROM s LEFT JOIN c USING (span)) SELECT card, span, CASE WHEN text IS NULL THEN 'missing' WHEN contains(lower(text), lower(quote)) THEN 'held' WHEN len(list_intersect(q, regexp_split_to_array(lower(text), '\s+'))) >= 0.6 * len(q) THEN 'fuzzy' ELSE 'unheld' END AS status FROM w")
def c14(spark, sf):
    p = table(spark, sf, "part")
    quote = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.concat("p_type", F.lit(" unheard")))
    spans = p.select(F.col("p_partkey").alias("card"), F.col("p_partkey").alias("span"), quote.alias("quote"))
    known = p.where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("span"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return reports.validated_spans(spans, known, "span").select("card", "span", "status")


@query("c15_card_evidence", "SELECT p_partkey AS paper_id, i AS place, f AS finding FROM (SELECT p_partkey, unnest([0, 1, 2]) AS i, unnest([p_name, p_type, CASE WHEN p_size > 25 THEN p_brand ELSE 'unknown' END]) AS f FROM part) WHERE f <> 'unknown'")
def c15(spark, sf):
    f = F.array(F.col("p_name"), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("unknown"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.posexplode(f).alias("place", "finding")).where("finding <> 'unknown'")


@query("c16_migrate", "SELECT event_id AS chunk_id, coalesce(event_type, 'body') AS chunk_type, 0 AS page FROM events")
def c16(spark, sf):
    return store.evolved(table(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), F.coalesce("event_type", F.lit("body")).alias("chunk_type")), {"page": "int"}, []).fillna({"page": 0})


@query("c17_route_entities", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS methods, count(*) FILTER (l_returnflag = 'R') AS datasets FROM lineitem GROUP BY 1")
def c17(spark, sf):
    return evidence_ops.routed(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", {"A": "methods", "R": "datasets"})


# Reports ----------------------------------------------------------------------------


@query("r02_candidates", "SELECT l_orderkey, l_linenumber, round(0.25 * l_discount * 10 + 0.25 * l_tax * 10 + 0.2 * 0.5 + 0.1 * 0.5 + 0.2 * 1 - least(0.3, 0.1 * l_linenumber) + CASE l_returnflag WHEN 'A' THEN 0.05 WHEN 'R' THEN -0.15 ELSE 0 END, 5) AS score FROM lineitem")
def r02(spark, sf):
    verdict = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "contradicted")
    s = reports.candidate_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5), F.lit(0.5), F.lit(1.0), F.col("l_linenumber"), F.coalesce(verdict, F.lit("")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(s, 5).alias("score"))


@query("r03_validate_candidates", "SELECT l_returnflag AS cause, count(*) AS dropped FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 1")
def r03(spark, sf):
    scope = scopes.scope_of(table(spark, sf, "part").where("p_size < 40"), "p_partkey")
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.col("l_returnflag").alias("cause"))
    return scopes.dropped_by_cause(line, scope, "cause")


@query("r04_verdicts", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'contradicted' WHEN bool_and(l_returnflag = 'A') THEN 'verified' ELSE 'unverified' END AS verdict FROM lineitem GROUP BY 1")
def r04(spark, sf):
    said = F.when(F.col("l_returnflag") == "R", "contradicted").when(F.col("l_returnflag") == "A", "verified").otherwise("unverified")
    return reports.verdicts(table(spark, sf, "lineitem").withColumn("said", said), "l_orderkey", "said")


@query("r05_sections", f"WITH {EVIDENCE}, g AS (SELECT topic, finding, min(evidence_id) AS e FROM evidence GROUP BY ALL), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY topic ORDER BY e, finding) <= 8) SELECT topic, string_agg('- ' || finding, chr(10) ORDER BY e, finding) AS body FROM f GROUP BY topic")
def r05(spark, sf):
    f = evidence(spark, sf).groupBy("topic", "finding").agg(F.min("evidence_id").alias("e"))
    top = store.first_n(f, ["topic"], [F.asc("e"), F.asc("finding")], 8)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("e", F.concat(F.lit("- "), F.col("finding")).alias("t")))), lambda x: x["t"])
    return top.groupBy("topic").agg(F.array_join(listed, "\n").alias("body"))


@query("r06_diff_versions")
def r06(spark, sf):
    """Paragraph differences of successive turns; a sequence matcher, no SQL."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before is not null")
    return c.select("conv_id", "turn", reports.paragraph_diff("before", "text").alias("d")).select("conv_id", "turn", "d.*")


@query("r07_restore", "SELECT conv_id, 1 + (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id) AS turn, md5(text) AS content FROM conversations c WHERE turn = 0 AND conv_id % 3 > 0")
def r07(spark, sf):
    v = table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("content"))
    last = v.groupBy("conv_id").agg(F.max("turn").alias("m"))
    wanted = last.select("conv_id", F.lit(0).cast("long").alias("turn"), (F.col("m") - (F.col("conv_id") % 3 == 0).cast("int")).alias("expected"))
    return reports.restored(v, "conv_id", "turn", wanted)


@query("r08_validate_answer", "SELECT l_orderkey AS answer, count(*) FILTER (p_size < 40) AS kept, round(CASE WHEN count(*) FILTER (p_size >= 40) > 0 THEN greatest(0.1, 0.8 - 0.3) ELSE 0.8 END, 6) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def r08(spark, sf):
    scope = scopes.scope_of(table(spark, sf, "part").where("p_size < 40"), "p_partkey")
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("paper_id"))
    return scopes.kept_within(line, scope, "answer", 0.8)


@query("r09_fallback_answer", "SELECT c_nationkey AS q, string_agg(c_name, '; ' ORDER BY c_custkey) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 5 GROUP BY 1")
def r09(spark, sf):
    top = store.first_n(table(spark, sf, "customer"), ["c_nationkey"], [F.asc("c_custkey")], 5)
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    return top.groupBy(F.col("c_nationkey").alias("q")).agg(F.array_join(names, "; ").alias("answer"))


# Streams ----------------------------------------------------------------------------


def scratch(spark):
    return f"{lineage.shared_folder(spark)}/query-{uuid.uuid4().hex}"


def events_in(spark, sf):
    return tasks.event_stream(spark, sf, "events.parquet")


@query("st1_progress", "SELECT user_id, event_type, n FROM (SELECT user_id, max_by(event_type, (epoch_us(ts), event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1)")
def st1(spark, sf):
    return tasks.settled(tasks.last_states(events_in(spark, sf)), scratch(spark))


@query("st2_states", "WITH e AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n, max(event_type) FILTER (k = 1) AS last, count(*) FILTER (before IS NOT NULL AND before <> event_type) AS changes FROM e GROUP BY 1")
def st2(spark, sf):
    """A task's states, counted by a stateful operator."""
    return tasks.settled(tasks.numbered_states(events_in(spark, sf)), scratch(spark), ["user_id"])


@query("st3_incremental_graph", "SELECT event_type AS label, count(DISTINCT user_id) AS papers, count(DISTINCT event_id) AS evidence FROM events GROUP BY 1")
def st3(spark, sf):
    """A graph that a stream maintains is the one built at once."""
    build = lambda d: graphs.mentions(d, "state", F.col("event_type"), F.col("user_id"), F.col("event_id"))
    n = tasks.maintained(events_in(spark, sf), build, scratch(spark))
    return graphs.counted(n).select("label", "papers", "evidence")


@query("st5_rate", "SELECT user_id, count(*) AS calls, count(*) FILTER (g < 600000000) AS too_soon FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY 1")
def st5(spark, sf):
    return tasks.rate_gaps(table(spark, sf, "events"), 600)


@query("st6_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st6(spark, sf):
    return tasks.settled(tasks.tumbling(events_in(spark, sf), "1 day", "2 hours").withColumn("total", F.round("total", 2)), scratch(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st6_sliding", "SELECT s AS start, count(*) AS n FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s) GROUP BY 1")
def st6s(spark, sf):
    return tasks.sliding(table(spark, sf, "events"), "12 hours", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st6_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 4 HOUR)::INT, 1) AS new FROM events)) GROUP BY user_id, s")
def st6w(spark, sf):
    return tasks.sessions(table(spark, sf, "events"), "4 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
