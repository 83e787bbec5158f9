"""Graphs of parts, suppliers and brands; scopes over them; gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import evidence as evidence_ops
from weft.operators import graphs, leiden, measures, records, resolution, scopes, store
from weft.plans.registry import query, table
from weft.plans.tables import EVIDENCE, PAPERS, evidence, papers, vocabulary

#: Parts joined to the suppliers of their deliveries.
EDGES = "edges AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, 'SUPPLIED_BY' AS edge_type FROM lineitem), nodes AS (SELECT DISTINCT src AS node_id, 'part' AS node_type FROM edges UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier), adj AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)"


def sample_graph(spark, sf):
    line = table(spark, sf, "lineitem")
    e = line.select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("dst"), F.lit("SUPPLIED_BY").alias("edge_type")).distinct()
    n = e.select(F.col("src").alias("node_id")).distinct().withColumn("node_type", F.lit("part"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("node_id"), F.lit("supplier").alias("node_type"))
    return n.union(s), e


@query("g01_topic_nodes", f"WITH {EVIDENCE} SELECT 'topic:' || left(md5(topic), 10) AS node_id, topic AS label, count(DISTINCT paper_id) AS papers, count(DISTINCT evidence_id) AS evidence FROM evidence GROUP BY topic")
def g01(spark, sf):
    said = graphs.mentions(evidence(spark, sf), "topic", F.col("topic"), F.col("paper_id"), F.col("evidence_id"))
    return graphs.counted(said).drop("node_type")


@query("g02_method_edges", f"WITH {EVIDENCE} SELECT 'edge:USES_METHOD:' || left(md5('paper:' || paper_id), 10) || ':' || left(md5('method:' || left(md5(method), 10)), 10) AS edge_id, count(DISTINCT evidence_id) AS evidence FROM evidence WHERE strength = 'high' GROUP BY paper_id, method")
def g02(spark, sf):
    e = evidence(spark, sf).where("strength = 'high'")
    out = graphs.edge_mentions(e, "USES_METHOD", F.concat(F.lit("paper:"), F.col("paper_id")), graphs.node_id("method", F.col("method")), F.col("evidence_id"))
    return out.groupBy("edge_id").agg(F.count(F.lit(1)).alias("evidence"))


@query("g04_incremental", f"WITH {EVIDENCE} SELECT 'method:' || left(md5(method), 10) AS node_id, count(DISTINCT paper_id) AS papers FROM evidence GROUP BY method")
def g04(spark, sf):
    e = evidence(spark, sf)
    make = lambda d: graphs.mentions(d, "method", F.col("method"), F.col("paper_id"), F.col("evidence_id"))
    return graphs.counted(graphs.merge_graphs(make(e.where("paper_id % 2 = 0")), make(e.where("paper_id % 2 = 1")))).select("node_id", "papers")


@query("g05_neighbours", f"WITH {EDGES}, s AS (SELECT 'supplier:' || s_suppkey AS seed FROM supplier WHERE s_suppkey <= 5), h1 AS (SELECT DISTINCT seed, b AS node FROM s JOIN adj ON seed = a), h2 AS (SELECT DISTINCT seed, b AS node FROM h1 JOIN adj ON node = a) SELECT seed, node, min(hop) AS hop FROM (SELECT seed, seed AS node, 0 AS hop FROM s UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) GROUP BY seed, node")
def g05(spark, sf):
    n, e = sample_graph(spark, sf)
    seeds = table(spark, sf, "supplier").where("s_suppkey <= 5").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("node_id"))
    return graphs.neighbours(seeds, e, 2)


@query("g06_subgraph", f"WITH {EDGES}, s AS (SELECT 'supplier:' || s_suppkey AS seed FROM supplier WHERE s_suppkey <= 5), h1 AS (SELECT DISTINCT b AS node FROM s JOIN adj ON seed = a UNION SELECT seed FROM s) SELECT count(*) AS nodes, (SELECT count(*) FROM edges WHERE src IN (SELECT node FROM h1) AND dst IN (SELECT node FROM h1)) AS edges FROM h1")
def g06(spark, sf):
    n, e = sample_graph(spark, sf)
    seeds = table(spark, sf, "supplier").where("s_suppkey <= 5").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("node_id"))
    near = graphs.neighbours(seeds, e, 1).select("node").distinct()
    inside = e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return near.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(inside.agg(F.count(F.lit(1)).alias("edges")))


@query("g07_paths", f"WITH {EDGES}, p AS (SELECT 'supplier:' || s_suppkey AS src, 'supplier:' || (s_suppkey + 1) AS dst FROM supplier WHERE s_suppkey <= 8), x AS (SELECT p.src, p.dst, p.src || '>' || a1.b || '>' || a2.b AS path, a1.b AS mid FROM p JOIN adj a1 ON a1.a = p.src JOIN adj a2 ON a2.a = a1.b AND a2.b = p.dst) SELECT src, dst, path FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY mid) AS k FROM x) WHERE k <= 10")
def g07(spark, sf):
    _, e = sample_graph(spark, sf)
    s = F.col("s_suppkey")
    pairs = table(spark, sf, "supplier").where("s_suppkey <= 8").select(F.concat(F.lit("supplier:"), s).alias("src"), F.concat(F.lit("supplier:"), s + 1).alias("dst"))
    return graphs.paths(pairs, e, 3).select("src", "dst", F.array_join("path", ">").alias("path"))


@query("g08_remove_paper", f"WITH {EVIDENCE}, n AS (SELECT finding, count(DISTINCT paper_id) AS papers, bool_or(paper_id = 10) AS had FROM evidence GROUP BY finding) SELECT finding AS label, papers - had::INT AS papers FROM n WHERE papers - had::INT > 0")
def g08(spark, sf):
    e = evidence(spark, sf)
    said = graphs.mentions(e, "finding", F.col("finding"), F.col("paper_id"), F.col("evidence_id"), 80)
    kept, _ = graphs.without_paper(said, spark.createDataFrame([], "src string, dst string"), 10)
    return graphs.counted(kept).select("label", "papers")


@query("g09_merge_similar")
def g09(spark, sf):
    """Words merged into the earliest kept word at edit distance two or less; greedy in the order of the words."""
    v = vocabulary(spark, sf).select("w")
    return records.merged_into(v.select(F.col("w").alias("id")), records.edit_pairs(v))


@query("g10_leiden")
def g10(spark, sf):
    """Leiden communities of parts and suppliers; iterative. Tests hold their modularity, connectedness and known partitions."""
    return leiden.communities(*sample_graph(spark, sf))


@query("g11_label_propagation")
def g11(spark, sf):
    """Communities of parts and suppliers; iterative."""
    n, e = sample_graph(spark, sf)
    return graphs.label_propagation(n, e)


_METHOD = "m AS (SELECT o_custkey AS method, max(CAST(year(o_orderdate) AS INTEGER)) AS y, count(*) AS papers FROM orders GROUP BY 1)"


@query("g13_temporal_gaps", f"WITH {_METHOD} SELECT method, y AS last_year, 2002 - y AS idle FROM m WHERE papers >= 2 AND 2002 - y >= 3")
def g13(spark, sf):
    return evidence_ops.idle_since(table(spark, sf, "orders").withColumnRenamed("o_custkey", "method"), "method", F.year("o_orderdate"), 2002)


@query("j12_missing_pairs", f"WITH {EDGES}, l AS (SELECT DISTINCT dst AS l FROM edges), r AS (SELECT DISTINCT src AS r FROM edges) SELECT l, r, (SELECT count(*) FROM l, r) - (SELECT count(*) FROM edges) AS n_missing FROM l, r WHERE NOT EXISTS (SELECT 1 FROM edges WHERE dst = l AND src = r) ORDER BY l, r LIMIT 20")
def j12(spark, sf):
    _, e = sample_graph(spark, sf)
    t = e.select(F.col("dst").alias("l"), F.col("src").alias("r"))
    first, total = graphs.missing_pairs(t.select("l").distinct(), t.select("r").distinct(), t)
    return first.crossJoin(F.broadcast(total))


@query("j13_method_gap", f"WITH {_METHOD}, d AS (SELECT c_nationkey AS dataset, max(y) AS dy FROM m JOIN customer ON method = c_custkey WHERE y < 2000 GROUP BY 1) SELECT dataset, y AS method_year, count(*) AS methods FROM d JOIN m ON y - dy >= 2 GROUP BY ALL")
def j13(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("method")).agg(F.max(F.year("o_orderdate")).alias("y"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("method"), F.col("c_nationkey").alias("dataset"))
    d = m.where("y < 2000").join(c, "method").groupBy("dataset").agg(F.max("y").alias("dy"))
    # Methods are counted by year before they meet the datasets, so that pairs are of years.
    years = m.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(years), F.col("y") - F.col("dy") >= 2).groupBy("dataset", F.col("y").alias("method_year")).agg(F.sum("n").alias("methods"))


@query("g12_sparse_regions", f"WITH {EDGES} SELECT node_id, count(b) AS degree FROM nodes LEFT JOIN adj ON node_id = a GROUP BY 1 HAVING count(b) <= 1")
def g12(spark, sf):
    return graphs.degrees(*sample_graph(spark, sf)).where("degree <= 1").select("node_id", "degree")


@query("g14_innovation_tree", f"WITH {EDGES} SELECT DISTINCT s.a AS root, s.b AS mid, t.b AS leaf FROM adj s JOIN adj t ON s.b = t.a AND t.b <> s.a WHERE s.a IN ('supplier:1', 'supplier:2', 'supplier:3')")
def g14(spark, sf):
    _, e = sample_graph(spark, sf)
    adj = graphs.both_ways(e.select("src", "dst"))
    s, t = adj.where(F.col("a").isin("supplier:1", "supplier:2", "supplier:3")).alias("s"), adj.alias("t")
    return s.join(t, (F.col("s.b") == F.col("t.a")) & (F.col("t.b") != F.col("s.a"))).select(F.col("s.a").alias("root"), F.col("s.b").alias("mid"), F.col("t.b").alias("leaf")).distinct()


@query("g16_graph_context", f"WITH {EDGES} SELECT dst AS node, string_agg(src || ' -> ' || dst, chr(10) ORDER BY src) AS context, sum(length(src || ' -> ' || dst) // 2)::BIGINT AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM edges) WHERE k <= 20 GROUP BY dst")
def g16(spark, sf):
    _, e = sample_graph(spark, sf)
    line = F.concat("src", F.lit(" -> "), "dst")
    top = store.first_n(e, ["dst"], [F.asc("src")], 20).select("dst", line.alias("line"))
    return top.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("context"), F.sum(F.floor(F.length("line") / 2)).alias("tokens"))


@query("g18_get_node", f"WITH {EDGES} SELECT * FROM nodes WHERE node_id = 'supplier:7'")
def g18(spark, sf):
    return store.get(sample_graph(spark, sf)[0], "node_id", "supplier:7")


@query("a06_graph_stats", f"WITH {EDGES} SELECT 'node' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'isolated', 'all', count(*) FROM nodes WHERE node_id NOT IN (SELECT a FROM adj)")
def a06(spark, sf):
    return graphs.statistics(*sample_graph(spark, sf))


@query("a07_graph_quality", f"WITH {EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round(2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 6) AS average_degree, (SELECT count(DISTINCT node_type) FROM nodes) AS types")
def a07(spark, sf):
    return measures.graph_quality(*sample_graph(spark, sf))


@query("a08_graph_traceability", f"WITH {EDGES} SELECT 'missing_node' AS error, count(*) AS n FROM edges WHERE dst NOT IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 4 > 0) UNION ALL SELECT 'orphan', count(*) FROM nodes WHERE node_id NOT IN (SELECT a FROM adj)")
def a08(spark, sf):
    n, e = sample_graph(spark, sf)
    some = table(spark, sf, "supplier").where("s_suppkey % 4 > 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("dst"))
    bad = e.join(some, "dst", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_node").alias("error"), "n")
    return bad.union(graphs.degrees(n, e).agg(F.count_if(F.col("degree") == 0).alias("n")).select(F.lit("orphan").alias("error"), "n"))


@query("a09_graph_summary", f"WITH {EVIDENCE}, c AS (SELECT 'topic' AS kind, topic AS label, count(DISTINCT paper_id) AS papers FROM evidence GROUP BY 2 UNION ALL SELECT 'method', method, count(DISTINCT paper_id) FROM evidence GROUP BY 2) SELECT kind, label, papers FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY papers DESC, label) AS k FROM c) WHERE k <= 10")
def a09(spark, sf):
    long = evidence(spark, sf).select("paper_id", "topic", "method").unpivot("paper_id", ["topic", "method"], "kind", "label")
    c = long.groupBy("kind", "label").agg(F.count_distinct("paper_id").alias("papers"))
    return store.first_n(c, ["kind"], [F.desc("papers"), F.asc("label")], 10)


@query("a10_downstream", f"WITH {EDGES} SELECT round(count(DISTINCT a) * 1.0 / (SELECT count(*) FROM nodes), 3) AS usage FROM adj JOIN nodes ON a = node_id")
def a10(spark, sf):
    d = graphs.degrees(*sample_graph(spark, sf))
    return d.agg(F.round(F.count_if(F.col("degree") > 0) / F.count(F.lit(1)), 3).alias("usage"))


@query("a13_gap_clusters", f"WITH {EVIDENCE} SELECT limitation || '/' || topic AS label, count(DISTINCT paper_id) AS papers, max_by(finding, length(finding) * 1000000 - paper_id) AS statement FROM evidence GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT paper_id) >= 2")
def a13(spark, sf):
    return evidence_ops.gap_clusters(evidence(spark, sf), F.concat_ws("/", "limitation", "topic"), "finding")


@query("a19_communities", f"WITH {EVIDENCE} SELECT topic || ':' || strength AS community, count(DISTINCT method) AS members, count(DISTINCT paper_id) AS papers FROM evidence GROUP BY 1 HAVING count(DISTINCT method) >= 2")
def a19(spark, sf):
    return evidence_ops.communities(evidence(spark, sf), F.concat_ws(":", "topic", "strength"), "method")


@query("j14_adjacency", f"WITH {EDGES} SELECT a, count(*) AS n, min(b) AS first FROM adj GROUP BY a")
def j14(spark, sf):
    return graphs.both_ways(sample_graph(spark, sf)[1].select("src", "dst")).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("first"))


@query("j28_scope_context", f"WITH {EDGES} SELECT DISTINCT dst AS node FROM edges WHERE src IN ('part:1', 'part:2', 'part:3', 'part:5', 'part:8', 'part:13', 'part:21', 'part:34', 'part:55', 'part:89', 'part:144', 'part:233')")
def j28(spark, sf):
    scope = spark.createDataFrame([(f"part:{k}",) for k in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233)], "src string")
    return sample_graph(spark, sf)[1].join(F.broadcast(scope), "src", "left_semi").select(F.col("dst").alias("node")).distinct()


@query("p29_graph_page", f"WITH {EDGES} SELECT src, dst FROM edges WHERE contains(src, '7') AND dst IN (SELECT node_id FROM nodes WHERE contains(node_id, '1'))")
def p29(spark, sf):
    return scopes.graph_page(*sample_graph(spark, sf), "7", "1")


# Scopes -----------------------------------------------------------------------------


@query("p13_scope_all", "SELECT DISTINCT p_partkey AS paper_id FROM part WHERE p_size <> 7")
def p13(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "paper_id")
    return scopes.all_papers(p, F.col("p_size") == 7)


@query("p14_scope_selected", "SELECT k AS paper_id, CASE WHEN p_partkey IS NULL THEN 'not_found' WHEN p_brand NOT LIKE 'Brand#1%' THEN 'project_mismatch' WHEN p_size = 7 THEN 'excluded' ELSE 'valid' END AS reason FROM (SELECT DISTINCT l_partkey * 3 AS k FROM lineitem) LEFT JOIN part ON k = p_partkey")
def p14(spark, sf):
    wanted = table(spark, sf, "lineitem").select((F.col("l_partkey") * 3).alias("paper_id"))
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "paper_id")
    return scopes.selected(wanted, p, F.col("p_brand").startswith("Brand#1"), F.col("p_size") == 7)


@query("p15_scope_topics", f"WITH {EVIDENCE} SELECT DISTINCT paper_id FROM evidence WHERE contains(lower(topic), 'econom') OR contains(lower(topic), 'promo')")
def p15(spark, sf):
    return scopes.by_topics(evidence(spark, sf), ["Econom", "promo"])


@query("p16_scope_methods", "SELECT DISTINCT l_partkey AS paper_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (1, 2, 3)")
def p16(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("l_suppkey"))
    return scopes.by_methods(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "paper_id"), s, "l_suppkey")


@query("p17_scope_graph", f"WITH {EDGES} SELECT DISTINCT src AS node FROM edges WHERE dst IN ('supplier:1', 'supplier:2')")
def p17(spark, sf):
    seeds = spark.createDataFrame([("supplier:1",), ("supplier:2",)], "node_id string")
    return scopes.by_graph(seeds, sample_graph(spark, sf)[1], "part:")


@query("p18_scope_years", f"WITH {PAPERS} SELECT paper_id FROM papers WHERE year BETWEEN 1999 AND 2000")
def p18(spark, sf):
    return scopes.by_years(papers(spark, sf), "2000", "1999")


@query("p12_scope", f"WITH {EVIDENCE}, {PAPERS} SELECT DISTINCT paper_id FROM evidence JOIN papers USING (paper_id) WHERE evidence.topic = 'PROMO' AND method LIKE '%1' AND year >= 2000")
def p12(spark, sf):
    e = evidence(spark, sf)
    return scopes.in_all(scopes.by_years(papers(spark, sf), 2000, None), scopes.scope_of(e.where((F.col("topic") == "PROMO") & F.col("method").endswith("1"))))


#: A request of every type from the nations, some of which find nothing, narrow each other, or ask for more hops than there may be.
_REQUESTS = """requests AS (SELECT n_nationkey AS request_id, ['all_project', 'selected_papers', 'topic_group', 'method_group', 'graph_subgraph', 'year_range'][n_nationkey % 6 + 1] AS type,
  [n_nationkey * 7 + 1, n_nationkey * 7 + 2, n_nationkey * 7 + 3, -n_nationkey] AS paper_ids,
  CASE WHEN n_nationkey >= 20 THEN ['zzz'] WHEN n_nationkey % 6 = 2 OR n_nationkey >= 12 THEN ['promo', 'SMA'] END AS topics,
  CASE WHEN n_nationkey % 6 = 3 OR n_nationkey = 16 THEN [s_name] END AS methods, ['supplier:' || (n_nationkey + 1), 'part:' || (n_nationkey + 2)] AS nodes, CAST(n_nationkey % 4 AS INTEGER) AS hops,
  CASE WHEN n_nationkey IN (5, 12, 13) THEN 2001 END AS first_year, CASE WHEN n_nationkey IN (5, 11, 13) THEN 2000 END AS last_year FROM nation JOIN supplier ON s_suppkey = n_nationkey % 5 + 1)"""


@query("p12_resolved", f"""WITH {EDGES}, {EVIDENCE}, {PAPERS}, {_REQUESTS},
inside AS (SELECT paper_id, year FROM papers JOIN part ON p_partkey = paper_id WHERE p_size % 10 <> 0),
tp AS (SELECT DISTINCT request_id, paper_id FROM requests JOIN evidence e ON list_has_any([contains(lower(e.topic), lower(x)) for x in topics], [true])),
mp AS (SELECT DISTINCT request_id, paper_id FROM requests JOIN evidence ON list_contains(methods, method)),
yp AS (SELECT request_id, paper_id FROM requests JOIN inside ON year >= coalesce(least(first_year, CASE WHEN first_year IS NOT NULL THEN last_year END), year) AND year <= coalesce(greatest(last_year, CASE WHEN last_year IS NOT NULL THEN first_year END), year) WHERE first_year IS NOT NULL OR last_year IS NOT NULL),
sd AS (SELECT request_id, unnest(nodes) AS seed, least(hops, 2) AS most FROM requests WHERE type = 'graph_subgraph'),
g0 AS (SELECT request_id, seed AS node, most FROM sd), g1 AS (SELECT * FROM g0 UNION SELECT request_id, b, most FROM g0 JOIN adj ON a = node WHERE most >= 1), g2 AS (SELECT * FROM g1 UNION SELECT request_id, b, most FROM g1 JOIN adj ON a = node WHERE most >= 2),
st AS (SELECT request_id, type, paper_id FROM requests, inside WHERE type = 'all_project'
  UNION ALL SELECT request_id, type, paper_id FROM (SELECT request_id, type, unnest(paper_ids) AS paper_id FROM requests WHERE type = 'selected_papers') JOIN inside USING (paper_id)
  UNION ALL SELECT request_id, type, paper_id FROM tp JOIN requests USING (request_id) JOIN inside USING (paper_id) WHERE type = 'topic_group'
  UNION ALL SELECT request_id, type, paper_id FROM mp JOIN requests USING (request_id) JOIN inside USING (paper_id) WHERE type = 'method_group'
  UNION ALL SELECT DISTINCT request_id, 'graph_subgraph', paper_id FROM g2 JOIN inside ON node = 'part:' || paper_id
  UNION ALL SELECT request_id, type, paper_id FROM yp JOIN requests USING (request_id) WHERE type = 'year_range' AND first_year IS NOT NULL AND last_year IS NOT NULL),
sc AS (SELECT st.request_id, st.paper_id FROM st JOIN requests r USING (request_id) WHERE (r.topics IS NULL OR r.type = 'topic_group' OR (st.request_id, st.paper_id) IN (SELECT request_id, paper_id FROM tp))
  AND (r.methods IS NULL OR r.type = 'method_group' OR (st.request_id, st.paper_id) IN (SELECT request_id, paper_id FROM mp))
  AND ((r.first_year IS NULL AND r.last_year IS NULL) OR r.type = 'year_range' OR (st.request_id, st.paper_id) IN (SELECT request_id, paper_id FROM yp))),
ev AS (SELECT request_id, count(*) AS evidence FROM sc JOIN (SELECT DISTINCT evidence_id, paper_id FROM evidence) USING (paper_id) GROUP BY 1), np AS (SELECT request_id, count(*) AS papers FROM sc GROUP BY 1), ns AS (SELECT request_id, count(*) AS started FROM st GROUP BY 1),
iv AS (SELECT request_id, count(*) AS invalid FROM (SELECT request_id, unnest(paper_ids) AS paper_id FROM requests WHERE type = 'selected_papers') x WHERE paper_id NOT IN (SELECT paper_id FROM inside) GROUP BY 1)
SELECT request_id, type, coalesce(papers, 0) AS papers, coalesce(evidence, 0) AS evidence, CASE WHEN started IS NOT NULL THEN NULL WHEN type = 'year_range' AND (first_year IS NULL OR last_year IS NULL) THEN 'invalid_time_range'
  ELSE ['no_included_papers', 'no_valid_selected_papers', 'no_matching_topic', 'no_matching_method', 'no_matching_graph_subgraph', 'no_papers_after_year_filter'][request_id % 6 + 1] END AS empty_reason,
  CASE WHEN type = 'graph_subgraph' AND hops > 2 THEN 1 ELSE 0 END AS warnings, coalesce(invalid, 0) AS invalid
FROM requests LEFT JOIN np USING (request_id) LEFT JOIN ev USING (request_id) LEFT JOIN ns USING (request_id) LEFT JOIN iv USING (request_id)""")
def p12_resolved(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    k, kind = F.col("n_nationkey").cast("long"), F.col("n_nationkey") % 6
    asked = n.join(s, s["s_suppkey"] == k % 5 + 1).select(
        k.alias("request_id"), F.get(F.array(*map(F.lit, resolution.EMPTY)), kind.cast("int")).alias("type"), F.array(k * 7 + 1, k * 7 + 2, k * 7 + 3, -k).alias("paper_ids"),
        F.when(k >= 20, F.array(F.lit("zzz"))).when((kind == 2) | (k >= 12), F.array(F.lit("promo"), F.lit("SMA"))).alias("topics"), F.when((kind == 3) | (k == 16), F.array("s_name")).alias("methods"),
        F.array(F.concat(F.lit("supplier:"), k + 1), F.concat(F.lit("part:"), k + 2)).alias("nodes"), (k % 4).cast("int").alias("hops"), F.when(k.isin(5, 12, 13), 2001).alias("first_year"), F.when(k.isin(5, 11, 13), 2000).alias("last_year"),
    )
    p = papers(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), (F.col("p_size") % 10 != 0).alias("included")), "paper_id")
    r = resolution.resolve(asked, p, evidence(spark, sf).withColumn("quote", F.col("finding")), sample_graph(spark, sf)[1], "part:").report
    return r.select("request_id", "type", "papers", "evidence", "empty_reason", F.size("warnings").alias("warnings"), F.coalesce(F.size("invalid"), F.lit(0)).alias("invalid"))


@query("p19_cross_filter", f"WITH {EVIDENCE} SELECT p_partkey AS paper_id FROM part WHERE p_partkey IN (SELECT paper_id FROM evidence WHERE topic = 'SMALL') AND p_partkey IN (SELECT paper_id FROM evidence WHERE strength = 'low')")
def p19(spark, sf):
    e, p = evidence(spark, sf), table(spark, sf, "part")
    return scopes.in_all(scopes.scope_of(p, "p_partkey"), e.where("topic = 'SMALL'"), e.where("strength = 'low'"))


@query("p20_scope_evidence", f"WITH {EVIDENCE} SELECT evidence_id FROM evidence WHERE paper_id IN (SELECT p_partkey FROM part WHERE p_size = 5) AND strength = 'high'")
def p20(spark, sf):
    scope = scopes.scope_of(table(spark, sf, "part").where("p_size = 5"), "p_partkey")
    return scopes.evidence_within(evidence(spark, sf), scope, F.col("strength") == "high").select("evidence_id")


@query("p22_scope_guard", "SELECT l_suppkey AS answer, count(*) FILTER (p_size > 25) AS violations, round(greatest(0, 1 - 0.1 * count(*) FILTER (p_size > 25)), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def p22(spark, sf):
    cited = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("answer"), F.col("l_partkey").alias("paper_id"))
    return scopes.violations(cited, scopes.scope_of(table(spark, sf, "part").where("p_size <= 25"), "p_partkey"))


@query("p23_evidence_query", f"WITH {EVIDENCE} SELECT evidence_id FROM evidence WHERE paper_id IN (1, 2, 3, 5, 8) AND strength = 'medium'")
def p23(spark, sf):
    return store.select_where(evidence(spark, sf), {"paper_id": [1, 2, 3, 5, 8], "strength": "medium"}).select("evidence_id")


@query("p24_lists", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 ORDER BY o_totalprice DESC")
def p24(spark, sf):
    return store.select_where(table(spark, sf, "orders"), {"o_custkey": 10}).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"))
