"""Stores, predicates, joins, aggregates, windows and sets over parts (as papers), line items (as evidence) and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import rules, scores, text
from weft.operators import evidence as evidence_ops
from weft.operators import measures, ranking, records, scopes, spread, store
from weft.plans.registry import query, table

#: Parts as papers: cited by line items, last dated by them.
PAPERS = "papers AS (SELECT p_partkey AS paper_id, p_name AS title, p_brand AS venue, p_type AS topic, count(l_orderkey) AS citations, CAST(max(year(l_shipdate)) AS INTEGER) AS year FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)"
#: Line items as evidence for them.
EVIDENCE = "evidence AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS paper_id, p_type AS topic, s_name AS method, p_name AS finding, o_orderpriority AS limitation, o_orderstatus AS future_work, CASE l_returnflag WHEN 'R' THEN 'low' WHEN 'A' THEN 'medium' ELSE 'high' END AS strength FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey)"
QUALITY = "(0.75 * CASE WHEN citations > 0 THEN sqrt(citations) / sqrt(greatest(m, 1)) ELSE 0 END + 0.10 * CASE WHEN citations <= 0 THEN 0 ELSE least(1.0, ln(1 + citations / greatest(2002 - year, 1)::DOUBLE) / ln(1 + greatest(m, 1))) END + 0.15 * exp(-0.08 * greatest(2002 - year, 0)))"
AS_OF = 2002


def papers(spark, sf):
    p, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    cited = line.groupBy(F.col("l_partkey").alias("paper_id")).agg(F.count(F.lit(1)).alias("citations"), F.max(F.year("l_shipdate")).alias("year"))
    p = p.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.col("p_type").alias("topic"))
    return p.join(cited, "paper_id", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


def evidence(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("topic"), F.col("p_name").alias("finding"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("method"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("limitation"), F.col("o_orderstatus").alias("future_work"))
    strength = F.when(F.col("l_returnflag") == "R", "low").when(F.col("l_returnflag") == "A", "medium").otherwise("high")
    return line.join(p, "l_partkey").join(s, "l_suppkey").join(o, "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_partkey").alias("paper_id"), "topic", "method", "finding", "limitation", "future_work", strength.alias("strength")
    )


def with_quality(spark, sf):
    p = papers(spark, sf)
    most = p.agg(F.max("citations").alias("m"))
    return p.crossJoin(F.broadcast(most)).withColumn("quality", F.round(scores.quality(F.col("citations"), F.col("year"), F.col("m"), AS_OF), 6)).drop("m")


SCORED = f"{PAPERS}, scored AS (SELECT papers.*, round({QUALITY}, 6) AS quality FROM papers, (SELECT max(citations) AS m FROM papers))"


# Stores ---------------------------------------------------------------------------


@query("s01_get", "SELECT * FROM customer WHERE c_custkey = 77")
def s01(spark, sf):
    return store.get(table(spark, sf, "customer"), "c_custkey", 77)


@query("s02_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def s02(spark, sf):
    return store.select_where(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": {"$near": 1}}).select("o_orderkey", "o_totalprice")


@query("s03_list_all", "SELECT * FROM nation")
def s03(spark, sf):
    return table(spark, sf, "nation")


@query("s04_page", "SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def s04(spark, sf):
    rows, total = store.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), 3, 20, {"o_orderstatus": "O"}, [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return rows.crossJoin(F.broadcast(total)).drop("o_orderstatus")


@query("s05_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def s05(spark, sf):
    return store.select_where(table(spark, sf, "events"), {"event_type": "click"}).agg(F.count(F.lit(1)).alias("n"))


@query("s06_upsert", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN -1.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, NULL, NULL, -1.0 FROM supplier WHERE s_suppkey % 3 = 0")
def s06(spark, sf):
    s = table(spark, sf, "supplier")
    some = s.where("s_suppkey % 3 = 0")
    new = some.select("s_suppkey").union(some.select(F.col("s_suppkey") + 1000000)).select("s_suppkey", F.lit(-1.0).alias("s_acctbal"), F.lit("x").alias("unknown"))
    return store.upsert(s, new, ["s_suppkey"])


@query("s07_delete", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def s07(spark, sf):
    return store.delete(table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("s08_cascade", "SELECT 'orders' AS name, count(*) AS deleted FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def s08(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    root = c.where("c_nationkey = 3").select(F.col("c_custkey").alias("key"))
    _, first = store.cascade({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, root, "key")
    gone = o.join(root, F.col("o_custkey") == F.col("key"), "left_semi").select(F.col("o_orderkey").alias("key"))
    _, second = store.cascade({"lineitem": (table(spark, sf, "lineitem"), "l_orderkey")}, gone, "key")
    return first.union(second)


@query("s09_keep_earliest", "SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate)")
def s09(spark, sf):
    return store.keep_earliest(table(spark, sf, "orders"), "o_custkey", "o_orderdate").select("o_orderkey")


@query("s10_evolve", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region")
def s10(spark, sf):
    return store.evolved(table(spark, sf, "region").withColumn("old", F.lit(1)), {"note": "string", "r_name": "string"}, ["old"])


@query("s11_row_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s11(spark, sf):
    stored = table(spark, sf, "events").select("event_id", F.unix_timestamp("ts").alias("epoch"), F.to_json(F.from_json("props", "k long")).alias("props"))
    return stored.select("event_id", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.from_json("props", "k long")["k"].alias("k"))


@query("s14_record_source", r"SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS abstract, string_split(url, '/')[3] AS host FROM pages")
def s14(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "<[^>]+>", "").alias("abstract"), F.split("url", "/")[2].alias("host"))


@query("s17_strategies", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 50 WHEN 'MACHINERY' THEN 100 ELSE 20 END AS quota FROM customer")
def s17(spark, sf):
    presets = spark.createDataFrame([("BUILDING", 50), ("MACHINERY", 100)], "c_mktsegment string, quota int")
    return table(spark, sf, "customer").join(F.broadcast(presets), "c_mktsegment", "left").select("c_custkey", F.coalesce("quota", F.lit(20)).alias("quota"))


@query("s18_import_list", "SELECT d.k AS doi, p_name AS title FROM (SELECT o_orderkey * 2 AS k FROM orders WHERE o_orderkey <= 500) d LEFT JOIN part ON p_partkey = k")
def s18(spark, sf):
    keys = table(spark, sf, "orders").where("o_orderkey <= 500").select((F.col("o_orderkey") * 2).alias("doi")).distinct()
    return keys.join(table(spark, sf, "part").select(F.col("p_partkey").alias("doi"), F.col("p_name").alias("title")), "doi", "left")


@query("s23_scanned", "SELECT source, count(*) FILTER (n_chars < 400) > 0.2 * count(*) AND count(*) FILTER (n_chars > 5000) < 0.3 * count(*) AS scanned FROM documents GROUP BY source")
def s23(spark, sf):
    return measures.scanned(table(spark, sf, "documents"), "source", "n_chars")


@query("s27_index_rows", "SELECT conv_id, turn, md5(text) AS text FROM conversations WHERE role <> 'system'")
def s27(spark, sf):
    return table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"))


@query("s28_summary_or_text", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), left(text, 40)) AS document FROM documents")
def s28(spark, sf):
    summary = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif(summary, F.lit("")), F.left("text", F.lit(40))).alias("document"))


@query("s29_profiles", "SELECT doc_id, split_part(text, chr(10), 1) || ' ' || left(text, 500) AS profile, len(embedding) AS size FROM documents JOIN embeddings ON vec_id = doc_id")
def s29(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    return d.join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", F.concat_ws(" ", F.split_part("text", F.lit("\n"), F.lit(1)), F.left("text", F.lit(500))).alias("profile"), F.size("embedding").alias("size"))


@query("s30_contexts", "SELECT conv_id, turn, trim(role || ' ' || left(text, 60)) AS document FROM conversations")
def s30(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.concat_ws(" ", "role", F.left("text", F.lit(60)))).alias("document"))


@query("s32_delete_many", "SELECT vec_id FROM embeddings WHERE label NOT IN (1, 3) AND vec_id % 7 <> 0")
def s32(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return store.delete(store.select_where(e, {"label": [x for x in range(-1, 50) if x not in (1, 3)]}), e.where("vec_id % 7 = 0"), "vec_id").select("vec_id")


@query("s33_counts", "SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def s33(spark, sf):
    one = lambda n: table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return one("region").union(one("nation")).union(one("embeddings"))


@query("s34_markdown", "SELECT n_regionkey AS report_id, '# ' || any_value(r_name) || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS content FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def s34(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    listed = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("n_name")))), "\n").alias("body"))
    return listed.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("report_id"), F.concat(F.lit("# "), F.col("r_name"), F.lit("\n"), F.col("body")).alias("content"))


@query("s39_profile_rows", "SELECT doc_id, source || ' ' || left(text, 500) AS profile FROM documents WHERE length(trim(text)) > 100")
def s39(spark, sf):
    return table(spark, sf, "documents").where(F.length(F.trim("text")) > 100).select("doc_id", F.concat_ws(" ", "source", F.left("text", F.lit(500))).alias("profile"))


# Predicates -------------------------------------------------------------------------


@query("p01_meta", "SELECT p_partkey AS paper_id, 'x' || p_partkey AS doi, 1990 + p_size AS year, p_brand AS source FROM part")
def p01(spark, sf):
    m = table(spark, sf, "part").select(
        F.col("p_partkey").alias("paper_id"),
        F.struct(F.concat(F.lit("x"), F.col("p_partkey")).alias("doi")).alias("identifiers"),
        F.struct((1990 + F.col("p_size")).alias("year")).alias("dates"),
        F.struct(F.col("p_brand").alias("platform")).alias("origin"),
    )
    return m.select("paper_id", "identifiers.doi", "dates.year", F.col("origin.platform").alias("source"))


@query("p03_year_filter", f"WITH {PAPERS} SELECT paper_id FROM papers WHERE year IS NULL OR year BETWEEN 1999 AND 2000")
def p03(spark, sf):
    return papers(spark, sf).where(F.col("year").isNull() | F.col("year").between(1999, 2000)).select("paper_id")


def _floor(threshold, least, order):
    return f"SELECT venue, paper_id FROM (SELECT *, count(*) FILTER (quality >= {threshold}) OVER (PARTITION BY venue) AS g, count(*) OVER (PARTITION BY venue) AS n, row_number() OVER (PARTITION BY venue ORDER BY {order}) AS k FROM scored) WHERE CASE WHEN g < {least} AND n > {least} THEN k <= {least} ELSE quality >= {threshold} END"


@query("p04_relevance_filter", f"WITH {SCORED} {_floor(0.97, 3, 'paper_id')}")
def p04(spark, sf):
    return ranking.at_least(with_quality(spark, sf), "quality", 0.97, 3, [F.asc("paper_id")], ["venue"]).select("venue", "paper_id")


@query("p05_quality_filter", f"WITH {SCORED} {_floor(0.97, 3, 'quality DESC, paper_id')}")
def p05(spark, sf):
    return ranking.at_least(with_quality(spark, sf), "quality", 0.97, 3, [F.desc("quality"), F.asc("paper_id")], ["venue"]).select("venue", "paper_id")


@query("p06_two_stage", f"WITH {SCORED}, a AS (SELECT * FROM scored WHERE paper_id % 3 > 0) SELECT venue, paper_id FROM a WHERE quality >= 0.7")
def p06(spark, sf):
    first = ranking.at_least(with_quality(spark, sf).withColumn("r", (F.col("paper_id") % 3 > 0).cast("double")), "r", 0.5, 1, [F.asc("paper_id")], ["venue"])
    return ranking.at_least(first, "quality", 0.7, 1, [F.desc("quality"), F.asc("paper_id")], ["venue"]).select("venue", "paper_id")


@query("p08_ranked_quality", f"WITH {SCORED} SELECT venue, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY paper_id) AS k FROM scored WHERE round(quality, 3) >= 0.5) WHERE k <= 10")
def p08(spark, sf):
    kept = with_quality(spark, sf).where(F.round("quality", 3) >= 0.5)
    return ranking.ranked(kept.withColumn("s", -F.col("paper_id")), "s", "paper_id", ["venue"], most=10).select("venue", "paper_id")


@query("p09_chunks", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'system') AND role NOT IN ('assistant')")
def p09(spark, sf):
    return table(spark, sf, "conversations").where(F.col("role").isin("user", "system") & ~F.col("role").isin("assistant")).select("conv_id", "turn")


@query("p10_search_nodes", "SELECT p_partkey AS node_id FROM part WHERE contains(lower(p_name), 'al') AND p_type IN ('STANDARD', 'ECONOMY') ORDER BY p_partkey LIMIT 50")
def p10(spark, sf):
    return table(spark, sf, "part").where(F.contains(F.lower("p_name"), F.lit("al")) & F.col("p_type").isin("STANDARD", "ECONOMY")).select(F.col("p_partkey").alias("node_id")).orderBy("node_id").limit(50)


@query("p11_gaps", "SELECT o_orderkey AS gap_id, o_totalprice AS confidence FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000")
def p11(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_totalprice >= 100000").select(F.col("o_orderkey").alias("gap_id"), F.col("o_totalprice").alias("confidence"))


@query("p25_embeddable", "SELECT doc_id, left(text, 500) AS text FROM documents WHERE length(trim(text)) > 50")
def p25(spark, sf):
    return table(spark, sf, "documents").where(F.length(F.trim("text")) > 50).select("doc_id", F.left("text", F.lit(500)).alias("text"))


@query("p26_keyword_relevance", "SELECT doc_id FROM documents WHERE contains(lower(text), ' the ')::INT + contains(lower(text), ' der ')::INT + contains(lower(text), ' de ')::INT + contains(lower(text), 'license')::INT >= 2")
def p26(spark, sf):
    hits = sum((F.contains(F.lower("text"), F.lit(k)).cast("int") for k in (" the ", " der ", " de ", "license")), F.lit(0))
    return table(spark, sf, "documents").where(hits >= 2).select("doc_id")


@query("p27_update", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'excluded' ELSE o_orderstatus END AS status FROM orders")
def p27(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 50000, "excluded").otherwise(F.col("o_orderstatus")).alias("status"))


@query("p28_library", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (contains(lower(c_name), '1')) AS shown FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def p28(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.lower("c_name"), F.lit("1"))).alias("shown"))


# Joins ------------------------------------------------------------------------------


_RES = "results AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'arxiv' ELSE 'semantic_scholar' END AS source, p_name AS title, CAST(1990 + p_size AS INTEGER) AS year, p_brand AS venue, left(p_name || p_type, 4 + p_size % 9) AS abstract, CASE WHEN p_partkey % 4 = 0 THEN '10.1/' || p_name || p_brand END AS doi, CAST(floor(p_retailprice) AS INTEGER) AS citations, CASE WHEN p_partkey % 5 = 0 THEN 'u' || p_partkey END AS pdf_url, [p_type, p_brand][1:1 + p_partkey % 2] AS authors FROM part)"


def results(spark, sf):
    k, p = F.col("p_partkey"), table(spark, sf, "part")
    source = F.when(k % 3 == 0, "openalex").when(k % 3 == 1, "arxiv").otherwise("semantic_scholar")
    return p.select(
        k.alias("id"), source.alias("source"), F.col("p_name").alias("title"), (1990 + F.col("p_size")).cast("int").alias("year"), F.col("p_brand").alias("venue"),
        F.substring(F.concat("p_name", "p_type"), F.lit(1), 4 + F.col("p_size") % 9).alias("abstract"), F.when(k % 4 == 0, F.concat(F.lit("10.1/"), "p_name", "p_brand")).alias("doi"),
        F.floor("p_retailprice").cast("int").alias("citations"), F.when(k % 5 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("pdf_url"), F.slice(F.array("p_type", "p_brand"), F.lit(1), (1 + k % 2).cast("int")).alias("authors"),
    )


_ORD = "CASE source WHEN 'openalex' THEN -4 WHEN 'semantic_scholar' THEN -3 ELSE -2 END, id"


@query("j01_merge_records", f"""WITH {_RES}, r AS (SELECT *, row_number() OVER (PARTITION BY title, venue ORDER BY {_ORD}) AS k FROM results)
SELECT title || '|' || venue AS key, any_value(title) AS title, any_value(venue) AS venue, string_agg(DISTINCT source, '+' ORDER BY source) AS source, min_by(year, k) AS year, min_by(doi, k) FILTER (doi IS NOT NULL) AS doi, max(citations) AS citations,
 min_by(abstract, -length(abstract) * 100000 + k) AS abstract, coalesce(min_by(pdf_url, k) FILTER (source = 'arxiv' AND pdf_url IS NOT NULL), min_by(pdf_url, k) FILTER (pdf_url IS NOT NULL)) AS pdf_url, array_to_string(min_by(authors, -len(authors) * 100000 + k), ',') AS authors, count(*) AS merged_from FROM r GROUP BY r.title, r.venue""")
def j01(spark, sf):
    r = results(spark, sf).withColumn("key", F.concat_ws("|", "title", "venue"))
    out = records.merged(r, "key", [-records.priority(F.col("source")), F.col("id")])
    return out.withColumn("authors", F.array_join("authors", ","))


@query("j02_title_duplicates", r"WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS s FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM d a JOIN d b ON a.doc_id < b.doc_id AND len(a.s) BETWEEN 0.85 * len(b.s) AND len(b.s) / 0.85 WHERE len(list_intersect(a.s, b.s)) >= 0.85 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))")
def j02(spark, sf):
    d = table(spark, sf, "documents")
    return records.similar_word_sets(d, "doc_id", text.words(F.lower("text")), 0.85).withColumn("similarity", F.round("similarity", 6))


@query("j03_match_known", "SELECT p_partkey AS id, k.known_id, CASE WHEN k.known_id IS NULL THEN 0.0 ELSE 0.9 END AS confidence FROM part LEFT JOIN (SELECT p_name, min(p_partkey) AS known_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) k USING (p_name) WHERE p_partkey % 2 = 1")
def j03(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("title:"), F.col("p_name")).alias("key"))
    return records.matched(p.where("id % 2 = 1"), p.where("id % 2 = 0").withColumnRenamed("id", "known_id"), "key").drop("key")


@query("j04_pair_decision", "SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_brand = b.p_brand THEN 'merge' WHEN abs(a.p_size - b.p_size) <= 1 THEN 'possible_duplicate' ELSE 'new' END AS action FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def j04(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_type", F.col("p_partkey").alias("a"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    q = p.withColumnsRenamed({"a": "b", "brand": "_brand", "size": "_size"})
    action = evidence_ops.pair_decision("a", "b", F.col("brand") == F.col("_brand"), F.abs(F.col("size") - F.col("_size")) <= 1)
    return spread.spread_join(p, q, ["p_name", "p_type"], "a", 8).where("a < b").select("a", "b", action.alias("action"))


@query("j05_insert_new", "SELECT min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 1 AND (p_name, p_brand) NOT IN (SELECT p_name, p_brand FROM part WHERE p_partkey % 2 = 0) GROUP BY p_name, p_brand")
def j05(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    new = p.where("id % 2 = 1").join(p.where("id % 2 = 0"), ["p_name", "p_brand"], "left_anti")
    return store.first_of(new, ["p_name", "p_brand"], [F.asc("id")]).select("id")


@query("j06_pool_join", "SELECT c_custkey, coalesce(n_name, c_name) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def j06(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return evidence_ops.labelled(table(spark, sf, "customer"), n, "c_nationkey", "c_name").select("c_custkey", "label")


@query("j07_cites", "WITH r AS (SELECT l_orderkey AS citing, l_partkey AS ref FROM lineitem), p AS (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) SELECT citing, coalesce(CAST(p_partkey AS VARCHAR), 'ghost:' || ref) AS cited FROM r LEFT JOIN p ON ref = p_partkey WHERE citing IS DISTINCT FROM p_partkey")
def j07(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("key"))
    return evidence_ops.cites(r, table(spark, sf, "part").where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "key"), "citing", "key")


@query("j08_enrich", "SELECT l_orderkey, l_linenumber, o_orderpriority AS section, c_name AS paper, round(l_quantity + o_totalprice, 2) AS score FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def j08(spark, sf):
    line = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("section"), "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("paper"))
    j = evidence_ops.enriched(line, o, c, "o_orderkey", "o_custkey")
    score = evidence_ops.layered_score({"chunk": F.col("l_quantity"), "section": F.col("o_totalprice")})
    return j.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "section", "paper", F.round(score, 2).alias("score"))


@query("j10_first_evidence", f"WITH {EVIDENCE}, f AS (SELECT paper_id, min(evidence_id) AS evidence_id FROM evidence GROUP BY 1) SELECT vec_id AS hit, f.evidence_id FROM embeddings JOIN f ON paper_id = vec_id")
def j10(spark, sf):
    first = store.first_of(evidence(spark, sf).select("paper_id", "evidence_id"), ["paper_id"], [F.asc("evidence_id")])
    return table(spark, sf, "embeddings").join(first, F.col("vec_id") == F.col("paper_id")).select(F.col("vec_id").alias("hit"), "evidence_id")


@query("j11_parents", "SELECT a.conv_id, a.turn, md5(coalesce(b.text, a.text)) AS text FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - a.turn % 2 AND a.turn % 2 = 1")
def j11(spark, sf):
    c = table(spark, sf, "conversations").withColumn("parent", F.when(F.col("turn") % 2 == 1, F.col("turn") - 1))
    return evidence_ops.in_place_of_parents(c, ["conv_id", "turn"], "parent", "text").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"))


@query("j15_intersection", "WITH a AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1 AS k FROM embeddings), b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) - 1 AS k FROM embeddings) SELECT a.label, a.vec_id, round(1 - (a.k + b.k) / 40.0, 6) AS score FROM a JOIN b USING (label, vec_id) WHERE a.k < 20 AND b.k < 20")
def j15(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    a, b = ranking.ranked(e, "x", "vec_id", ["label"], most=20), ranking.ranked(e, "y", "vec_id", ["label"], most=20)
    return ranking.intersect_ranks(a, b, ["label", "vec_id"], 20).withColumn("score", F.round("score", 6))


_AB = "a AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1 AS k FROM embeddings QUALIFY k < 20), b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) - 1 AS k FROM embeddings QUALIFY k < 20)"


@query("j16_rrf_pair", f"WITH {_AB}, n AS (SELECT label, count(*) AS n FROM a GROUP BY 1) SELECT label, vec_id, round(1.0 / (60 + coalesce(a.k, n) + 1) + 1.0 / (60 + coalesce(b.k, n) + 1), 8) AS rrf FROM a FULL JOIN b USING (label, vec_id) JOIN n USING (label)")
def j16(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    a, b = ranking.ranked(e, "x", "vec_id", ["label"], most=20), ranking.ranked(e, "y", "vec_id", ["label"], most=20)
    return ranking.fuse_pair(a, b, ["label", "vec_id"], ["label"]).withColumn("rrf", F.round("rrf", 8))


@query("j17_rrf", f"WITH {_AB} SELECT label, vec_id, round(sum(1.0 / (60 + k + 1)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def j17(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    a, b = ranking.ranked(e, "x", "vec_id", ["label"], most=20), ranking.ranked(e, "y", "vec_id", ["label"], most=20)
    return ranking.fuse([a, b], ["label", "vec_id"]).withColumn("rrf", F.round("rrf", 8))


@query("j19_exclude_local", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09 AND l_tax > 0.07) ORDER BY s_suppkey LIMIT 10")
def j19(spark, sf):
    local = table(spark, sf, "lineitem").where("l_quantity >= 50 AND l_discount > 0.09 AND l_tax > 0.07").select(F.col("l_suppkey").alias("s_suppkey"))
    return evidence_ops.not_local(table(spark, sf, "supplier").select("s_suppkey"), local, "s_suppkey", 10)


@query("j20_source_index", "SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS sections, count(*) AS uses FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j20(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    out = evidence_ops.source_index(table(spark, sf, "orders").withColumnRenamed("o_custkey", "id"), c, "id", "o_orderpriority")
    return out.withColumn("sections", F.array_join("sections", "|"))


@query("j21_traceability", "SELECT count(*) AS cited, count(*) FILTER (p_partkey IS NULL) AS missing, round(count(p_partkey) * 1.0 / count(*), 6) AS coverage FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 > 0) ON l_partkey = p_partkey")
def j21(spark, sf):
    known = table(spark, sf, "part").where("p_partkey % 10 > 0").select(F.col("p_partkey").alias("paper_id"))
    return evidence_ops.traceability(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "paper_id"), known, "paper_id")


_VOC = r"v AS (SELECT w, count(DISTINCT doc_id) AS f FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents WHERE lang = 'en') WHERE length(w) >= 4 GROUP BY w HAVING count(DISTINCT doc_id) >= 40)"


def vocabulary(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    return d.where(F.length("w") >= 4).groupBy("w").agg(F.count_distinct("doc_id").alias("f")).where("f >= 40")


@query("j22_edit_pairs", f"WITH {_VOC} SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w) AS distance FROM v a JOIN v b ON left(a.w, 3) = left(b.w, 3) AND a.w < b.w WHERE levenshtein(a.w, b.w) <= 2")
def j22(spark, sf):
    return records.edit_pairs(vocabulary(spark, sf))


@query("j23_vector_pairs")
def j23(spark, sf):
    """Greedy merging at a cosine of 0.85; tested against a plain loop."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return records.vector_merges(e, "vec_id", "label", "embedding", 0.85)


@query("j24_counter_evidence", "SELECT c.s_suppkey AS candidate, p.p_partkey AS finding FROM supplier c JOIN part p ON c.s_nationkey = p.p_size % 25 WHERE contains(p_name, 'al') AND c.s_suppkey % 2 = p.p_partkey % 2")
def j24(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("candidate"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("m"), (F.col("s_suppkey") % 2).cast("string"))).alias("words"))
    p = table(spark, sf, "part").where(F.contains("p_name", F.lit("al"))).select(F.col("p_partkey").alias("finding"), F.array(F.concat(F.lit("n"), (F.col("p_size") % 25).cast("string")), F.concat(F.lit("m"), (F.col("p_partkey") % 2).cast("string"))).alias("words"))
    return evidence_ops.counter_evidence(s, p, "candidate", "finding")


@query("j25_dangling", "SELECT DISTINCT l_partkey AS edge, 'target' AS side FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 > 0) UNION ALL SELECT DISTINCT l_partkey, 'source' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 > 0)")
def j25(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("edge")).distinct()
    s = table(spark, sf, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("target"))
    p = table(spark, sf, "part").where("p_partkey % 9 > 0").select(F.col("p_partkey").alias("source"))
    return evidence_ops.dangling(e, {"target": s, "source": p}, "edge")


@query("j27_backfill", f"WITH {EVIDENCE} SELECT s_suppkey AS edge, count(DISTINCT evidence_id) AS n, min(evidence_id) AS first FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey JOIN evidence e ON e.paper_id = l_partkey GROUP BY 1")
def j27(spark, sf):
    drawn = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("edge"), F.col("l_partkey").alias("paper_id"))
    drawn = drawn.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge")), "edge", "left_semi")
    return evidence_ops.backfill_counts(drawn, evidence(spark, sf), "edge")


# Aggregates -------------------------------------------------------------------------


@query("a03_quality", f"WITH {SCORED} SELECT paper_id, quality FROM scored")
def a03(spark, sf):
    return with_quality(spark, sf).select("paper_id", "quality")


@query("a04_provenance", "SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS papers, list_aggregate(list_sort(list(DISTINCT l_partkey))[1:3], 'string_agg', ',') AS first3 FROM lineitem GROUP BY 1")
def a04(spark, sf):
    said = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("paper_id"))
    out = evidence_ops.provenance(said, "node")
    return out.select("node", "papers", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first3"))


@query("a11_limitations", f"WITH {EVIDENCE}, e AS (SELECT lower(left(limitation || ' ' || finding, 80)) AS key, paper_id FROM evidence) SELECT key, count(*) AS n, count(DISTINCT paper_id) AS papers, round(least(0.9, 0.4 + 0.1 * count(DISTINCT paper_id)), 6) AS confidence FROM e GROUP BY key HAVING count(DISTINCT paper_id) >= 2 OR count(*) >= 2")
def a11(spark, sf):
    return evidence_ops.clustered(evidence(spark, sf), F.lower(F.left(F.concat_ws(" ", "limitation", "finding"), F.lit(80))), 0.4, 0.1, 0.9, 2)


@query("a12_future_works", f"WITH {EVIDENCE} SELECT future_work || ' ' || topic AS key, count(*) AS n, round(least(0.85, 0.3 + 0.15 * count(DISTINCT paper_id)), 6) AS confidence FROM evidence GROUP BY 1")
def a12(spark, sf):
    return evidence_ops.clustered(evidence(spark, sf), F.concat_ws(" ", "future_work", "topic"), 0.3, 0.15, 0.85).drop("papers")


@query("a14_ghosts", "SELECT l_partkey AS ghost, count(DISTINCT l_orderkey) AS cited_by FROM lineitem WHERE l_partkey % 2 = 1 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def a14(spark, sf):
    cited = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "ghost")
    return evidence_ops.ghosts(cited, table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ghost")), "l_orderkey", "ghost")


@query("a15_matrix", f"WITH {EVIDENCE} SELECT topic, count(DISTINCT finding) AS findings, count(DISTINCT limitation) AS limitations, string_agg(DISTINCT future_work, '|' ORDER BY future_work) AS future FROM evidence GROUP BY topic")
def a15(spark, sf):
    m = evidence_ops.matrix(evidence(spark, sf), "topic", ["finding", "limitation"], "future_work")
    return m.select("topic", F.col("finding").alias("findings"), F.col("limitation").alias("limitations"), F.array_join("future_work", "|").alias("future"))


@query("a16_facets", f"WITH {EVIDENCE} SELECT 'topic' AS facet, topic AS value, count(*) AS n FROM evidence GROUP BY 2 UNION ALL SELECT 'method', method, count(*) FROM evidence GROUP BY 2 UNION ALL SELECT 'strength', strength, count(*) FROM evidence GROUP BY 2")
def a16(spark, sf):
    return evidence_ops.facets(evidence(spark, sf), ["topic", "method", "strength"])


@query("a17_topics", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'cheap' ELSE lower(p_type) END AS topic, count(DISTINCT p_partkey) AS papers FROM part GROUP BY 1")
def a17(spark, sf):
    return table(spark, sf, "part").groupBy(text.resolve_alias(F.lower("p_type"), {"economy": "cheap"}).alias("topic")).agg(F.count_distinct("p_partkey").alias("papers"))


@query("a18_consensus", f"WITH {EVIDENCE}, w AS (SELECT topic, future_work = 'F' AS pro, future_work = 'O' AS con, CASE strength WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END AS w FROM evidence) SELECT topic, round(sum(w) FILTER (pro), 4) AS supports, round(sum(w) FILTER (con), 4) AS contradicts, round((sum(w) FILTER (pro) - sum(w) FILTER (con)) / (sum(w) FILTER (pro) + sum(w) FILTER (con)), 4) AS score FROM w GROUP BY topic")
def a18(spark, sf):
    return evidence_ops.consensus(evidence(spark, sf), "topic", F.col("future_work") == "F", F.col("future_work") == "O")


@query("a20_metrics", "SELECT event_type AS name, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean, round(sum(value), 2) AS total FROM events GROUP BY 1")
def a20(spark, sf):
    return measures.summaries(table(spark, sf, "events").withColumnRenamed("event_type", "name"), "name", "value")


@query("a21_sections", "SELECT conv_id, role AS section, md5(string_agg(text, chr(10) ORDER BY turn)) AS text, max(turn) AS last, sum(length(text) // 4)::BIGINT AS tokens, dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS place FROM conversations GROUP BY conv_id, role")
def a21(spark, sf):
    c = table(spark, sf, "conversations").withColumn("tok", text.estimated_tokens(F.col("text")))
    g = c.groupBy("conv_id", F.col("role").alias("section")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"), F.max("turn").alias("last"), F.sum("tok").alias("tokens"), F.min("turn").alias("first"))
    joined = F.array_join(F.transform("x", lambda t: t["text"]), "\n")
    return g.select("conv_id", "section", F.md5(joined.cast("binary")).alias("text"), "last", "tokens", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first")).alias("place"))


_LINES = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' AND length(trim(line)) < 50 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2)"


@query("a22_headers", f"WITH {_LINES} SELECT source, line, n FROM h")
def a22(spark, sf):
    return measures.repeated_lines(table(spark, sf, "documents"), "source", "doc_id", "text")


@query("a23_watermark", "WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT source, bool_or(contains(lower(line), 'license')) OR max(n) >= 3 AS watermark FROM (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 19 THEN count(*) OVER (PARTITION BY source, line) ELSE 0 END AS n FROM l) GROUP BY source")
def a23(spark, sf):
    return measures.watermarked(table(spark, sf, "documents"), "source", "text", ["license"])


@query("a24_diagnostics", "SELECT f AS field, count(*) AS n FROM (SELECT unnest([CASE WHEN l_quantity > 25 THEN 'finding' END, CASE WHEN l_tax > 0.04 THEN 'limitation' END]) AS f FROM lineitem) WHERE f IS NOT NULL GROUP BY 1")
def a24(spark, sf):
    return measures.matched_fields(table(spark, sf, "lineitem"), {"finding": F.col("l_quantity") > 25, "limitation": F.col("l_tax") > 0.04})


@query("a25_project_stats", "SELECT source AS project, count(*) AS papers, count(*) FILTER (lang = 'en') AS parsed, count(DISTINCT lang) AS kinds FROM documents GROUP BY 1")
def a25(spark, sf):
    return measures.project_stats(table(spark, sf, "documents").withColumnRenamed("source", "project"), "project", F.col("lang") == "en", "lang")


@query("a26_coverage", "SELECT o_orderstatus AS report, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0 END), 6) AS coverage, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0 END) >= 0.5 AS passed FROM orders GROUP BY 1")
def a26(spark, sf):
    return measures.coverage(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "report"), "report", F.col("o_totalprice") > 100000)


@query("a27_revise", "SELECT l_shipdate AS day, round(avg(CASE WHEN l_returnflag IN ('R', 'A') THEN 1.0 ELSE 0 END), 6) AS ratio, avg(CASE WHEN l_returnflag IN ('R', 'A') THEN 1.0 ELSE 0 END) > 0.1 AS revise FROM lineitem GROUP BY 1")
def a27(spark, sf):
    return measures.to_revise(table(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "day"), "day", F.col("l_returnflag").isin("R", "A"))


@query("a28_entities", "SELECT lower(p_name) AS name, p_type AS kind, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS description FROM part GROUP BY 1, 2")
def a28(spark, sf):
    return measures.described(table(spark, sf, "part"), F.lower("p_name"), "p_type", "p_brand")


@query("a29_rates", "SELECT 'redaction' AS name, 1.0 - avg(contains(text, '@')::INT) AS score FROM documents UNION ALL SELECT 'generic_text', 1.0 - avg(contains(lower(text), 'that the')::INT) FROM documents UNION ALL SELECT 'innovation_specificity', avg((length(text) > 300)::INT) FROM documents")
def a29(spark, sf):
    shares = {"redaction": ~F.contains("text", F.lit("@")), "generic_text": ~F.contains(F.lower("text"), F.lit("that the")), "innovation_specificity": F.length("text") > 300}
    return measures.rates(table(spark, sf, "documents"), shares)


@query("a30_gates", "WITH e AS (SELECT 'redaction' AS name, 1.0 - avg(contains(text, '@')::INT) AS score FROM documents UNION ALL SELECT 'generic_text', 1.0 - avg(contains(lower(text), 'that the')::INT) FROM documents), g AS (SELECT * FROM (VALUES ('scope_guard', 1.0, true), ('citation_coverage', 0.8, true), ('report_traceability', 0.8, true), ('innovation_specificity', 0.7, false), ('generic_text', 0.8, false), ('redaction', 1.0, true)) t(name, expected, required)) SELECT g.name, g.required, CASE WHEN e.name IS NULL THEN NOT g.required WHEN g.expected = 1.0 THEN score = 1.0 ELSE score >= expected END AS passed FROM g LEFT JOIN e USING (name)")
def a30(spark, sf):
    shares = {"redaction": ~F.contains("text", F.lit("@")), "generic_text": ~F.contains(F.lower("text"), F.lit("that the"))}
    return measures.quality_gates(measures.rates(table(spark, sf, "documents"), shares))


@query("a31_retrieval_metrics", "SELECT o_custkey AS query, round(avg((o_orderstatus = 'F')::INT), 6) AS precision, round(avg((o_orderstatus = 'F')::INT) FILTER (k <= 3), 6) AS precision_at_3, count(*) FILTER (o_orderstatus = 'F') AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) GROUP BY 1")
def a31(spark, sf):
    o = ranking.ranked(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", ["o_custkey"])
    hit = (F.col("o_orderstatus") == "F").cast("int")
    return o.groupBy(F.col("o_custkey").alias("query")).agg(F.round(F.avg(hit), 6).alias("precision"), F.round(F.avg(F.when(F.col("rank") < 3, hit)), 6).alias("precision_at_3"), F.count_if(hit == 1).alias("relevant"))


@query("a32_next_version", "SELECT conv_id, max(turn) + 1 AS version FROM conversations GROUP BY 1")
def a32(spark, sf):
    return measures.next_versions(table(spark, sf, "conversations").withColumnRenamed("turn", "version"), "conv_id", "version")


@query("a33_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a33(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# Windows, top-k, sets ---------------------------------------------------------------


@query("w02_ranks", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1 AS rank FROM embeddings")
def w02(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("s"))
    return ranking.ranked(e, "s", "vec_id", ["label"]).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("w04_top3", f"WITH {EVIDENCE} SELECT topic, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE strength WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, evidence_id) AS k FROM evidence) WHERE k <= 3")
def w04(spark, sf):
    place = F.when(F.col("strength") == "high", 0).when(F.col("strength") == "low", 2).otherwise(1)
    return store.first_n(evidence(spark, sf), ["topic"], [place, F.col("evidence_id")], 3).select("topic", "evidence_id")


@query("w05_budget", "SELECT conv_id, turn FROM (SELECT *, sum(length(text) // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s <= 1000")
def w05(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 2).alias("cost"))
    return ranking.within_budget(c, "cost", 1000, [F.asc("turn")], ["conv_id"]).select("conv_id", "turn")


@query("w10_overlap", r"SELECT conv_id, turn, md5(coalesce(array_to_string(list_filter(regexp_split_to_array(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '\s+'), lambda w: w <> '')[-5:], ' ') || ' ', '') || text) AS text FROM conversations")
def w10(spark, sf):
    before = text.words(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    tail = F.when(F.size(before) > 0, F.concat(F.array_join(F.slice(before, F.greatest(F.size(before) - 4, F.lit(1)), F.lit(5)), " "), F.lit(" "))).otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.concat(tail, F.col("text")).cast("binary")).alias("text"))


@query("w11_dual_column", "WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, length(unnest(x)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), p AS (SELECT doc_id, n, lead(n) OVER (PARTITION BY doc_id ORDER BY i) AS m FROM l) SELECT doc_id, round(avg((n < 140 AND m < 140 AND abs(n - m) < 60)::INT), 6) AS share FROM p WHERE m IS NOT NULL GROUP BY 1 HAVING count(*) > 3")
def w11(spark, sf):
    d = table(spark, sf, "documents").where(F.size(F.split("text", "\n")) > 4)
    return d.select("doc_id", F.round(measures.column_share(F.col("text")), 6).alias("share"))


@query("w12_inversions", "SELECT o_custkey, count(*) AS inversions FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE o_totalprice > b GROUP BY 1")
def w12(spark, sf):
    return measures.ascents(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("w13_versions", "SELECT conv_id, turn AS version, false AS current FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, true FROM conversations GROUP BY 1")
def w13(spark, sf):
    return measures.with_current(table(spark, sf, "conversations").withColumnRenamed("turn", "version"), "conv_id", "version")


@query("w14_latest", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1")
def w14(spark, sf):
    return store.first_of(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], [F.desc("turn")])


@query("t04_truncate_scope", "SELECT p_partkey AS paper_id, place FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 3 = 0 ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 20")
def t04(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), (F.col("p_partkey") % 3 == 0).alias("local"), "p_retailprice")
    return ranking.ranked(p, "p_retailprice", "paper_id", ["local"], most=20).select("paper_id", (F.col("rank") + 1).cast("long").alias("place"))


@query("t06_skeleton", "SELECT kind, id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS k FROM (SELECT 'limitation' AS kind, min(o_orderkey) AS id FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'gap', min(o_orderkey) FROM orders GROUP BY o_orderstatus)) WHERE k <= CASE kind WHEN 'limitation' THEN 5 ELSE 3 END")
def t06(spark, sf):
    o = table(spark, sf, "orders")
    each = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("id")).select(F.lit("limitation").alias("kind"), "id").union(o.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("id")).select(F.lit("gap").alias("kind"), "id"))
    most = F.when(F.col("kind") == "limitation", 5).otherwise(3)
    return ranking.ranked(each.withColumn("s", -F.col("id")), "s", "id", ["kind"]).where(F.col("rank") < most).select("kind", "id")


@query("t07_section_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS place FROM conversations")
def t07(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return measures.in_section_order(c, "conv_id", "role", "turn", ("system", "user")).drop("role")


@query("u01_union", "SELECT p_partkey AS id, 'part' AS source FROM part UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def u01(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("source")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source")))


@query("u02_intersect", "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u02(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("u03_except", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 50")
def u03(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).exceptAll(table(spark, sf, "lineitem").where("l_quantity >= 50").select("l_partkey").distinct())


@query("u04_keep_first", "SELECT min(p_partkey) AS id FROM part GROUP BY p_name")
def u04(spark, sf):
    return store.first_of(table(spark, sf, "part").select("p_name", F.col("p_partkey").alias("id")), ["p_name"], [F.asc("id")]).select("id")


@query("u05_widen", "WITH h AS (SELECT vec_id FROM embeddings WHERE label = 1) SELECT vec_id FROM embeddings WHERE (SELECT count(*) FROM h) < 100 UNION SELECT vec_id FROM h")
def u05(spark, sf):
    return scopes.widened(table(spark, sf, "embeddings").select("vec_id", "label"), F.col("label") == 1, 100).select("vec_id").distinct()


# Scopes, texts and designs ----------------------------------------------------------


@query("c04_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def c04(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("d03_final_score", f"WITH {SCORED} SELECT paper_id, round(0.55e0 * (paper_id % 100) / 100e0 + 0.25e0 * quality + 0.20e0 * (paper_id % 4 + 1) / 4e0, 8) AS score FROM scored WHERE 0.55e0 * (paper_id % 100) / 100e0 + 0.25e0 * quality + 0.20e0 * (paper_id % 4 + 1) / 4e0 >= 0.3e0")
def d03(spark, sf):
    s = 0.55 * (F.col("paper_id") % 100) / 100.0 + 0.25 * F.col("quality") + 0.20 * (F.col("paper_id") % 4 + 1) / 4.0
    return with_quality(spark, sf).withColumn("score", s).where("score >= 0.3").select("paper_id", F.round("score", 8).alias("score"))


@query("d04_lookups", "SELECT DISTINCT o_custkey FROM orders WHERE CAST(o_totalprice AS DOUBLE) > 300000 AND o_orderstatus = 'F'")
def d04(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("weft_orders")
    return spark.sql("SELECT DISTINCT o_custkey FROM weft_orders WHERE CAST(o_totalprice AS DOUBLE) > 300000 AND o_orderstatus = 'F'")


@query("d05_triples", "SELECT 'part:' || p_partkey AS s, p AS p, o FROM (SELECT p_partkey, unnest(['title', 'venue', 'topic']) AS p, unnest([p_name, p_brand, p_type]) AS o FROM part)")
def d05(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("s"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.col("p_type").alias("topic"))
    return p.unpivot("s", ["title", "venue", "topic"], "p", "o")
