"""What is kept instead of rows: sketches, summaries of communities, cached answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import communities, sketches
from weft.plans.graph import EDGES, sample_graph
from weft.plans.registry import query, table
from weft.plans.retrieval import events_in, scratch
from weft.streaming import cache


def monthly(spark, sf):
    line = table(spark, sf, "lineitem").select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), "l_partkey", "l_extendedprice")
    return sketches.sketched(line, ["l_returnflag", "month"], F.col("l_partkey"), F.col("l_extendedprice"))


@query("a33_sketch_rollup")
def a33_rollup(spark, sf):
    """Parts and prices by flag, month and in all, merged from the sketches of flags within months; estimates, so no SQL."""
    kept = sketches.estimated(sketches.rolled_up_all(monthly(spark, sf), [["l_returnflag"], ["month"], []]))
    return kept.select("level", "l_returnflag", "month", "n", "distinct", F.col("amounts")[0].alias("median"), F.col("amounts")[1].alias("p90"))


@query("a33_sketch_audit", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, true AS parts_ok, true AS median_ok FROM lineitem GROUP BY 1")
def a33_audit(spark, sf):
    """Whether the merged sketches of a flag are within their stated errors (twice that of ranks, which holds for 99 %) of what is counted exactly."""
    kept = sketches.estimated(sketches.rolled_up(monthly(spark, sf), ["l_returnflag"]), (0.5,)).select("l_returnflag", "distinct", F.col("amounts")[0].alias("median"))
    line = table(spark, sf, "lineitem").join(F.broadcast(kept), "l_returnflag")
    exact = line.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.first("distinct").alias("distinct"), F.avg((F.col("l_extendedprice").cast("double") < F.col("median")).cast("int")).alias("below")
    )
    ok = F.abs(F.col("distinct") - F.col("parts")) <= sketches.DISTINCT_ERROR * F.col("parts")
    return exact.select("l_returnflag", "n", "parts", ok.alias("parts_ok"), (F.abs(F.col("below") - 0.5) <= 2 * sketches.RANK_ERROR).alias("median_ok"))


@query("a33_sketch_overlap")
def a33_overlap(spark, sf):
    """How many parts the flags share, from the theta sketches of months; estimates, so no SQL."""
    flags = sketches.rolled_up(monthly(spark, sf), ["l_returnflag"])
    names = table(spark, sf, "lineitem").select("l_returnflag").distinct()
    pairs = names.select(F.col("l_returnflag").alias("a")).join(names.select(F.col("l_returnflag").alias("b")), F.col("a") < F.col("b"))
    return sketches.overlaps(flags, pairs, "l_returnflag").withColumns({c: F.round(c).cast("long") for c in ("both", "either", "only_a")})


#: Communities of documents by language and source, told by their most central sentences.
_SENTENCES = r"""m AS (SELECT DISTINCT lang || ':' || source AS community, doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
  raw AS (SELECT community, trim(unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]+(?:\s|$)|\n'))) AS sentence FROM m JOIN documents USING (doc_id)),
  said AS (SELECT community, sentence, count(*) AS times FROM raw WHERE sentence <> '' GROUP BY ALL),
  word AS (SELECT community, sentence, times, len(t) AS size, unnest(t) AS term FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '[^\p{L}\p{N}]+'), lambda w: length(w) > 2)) AS t FROM said)),
  centre AS (SELECT community, term, sum(times) AS have FROM word GROUP BY ALL), spread AS (SELECT term, count(*) AS spread FROM centre GROUP BY term), total AS (SELECT community, sum(times) AS total FROM said GROUP BY ALL),
  weigh AS (SELECT community, term, round(have / total * ln(1 + (SELECT count(*) FROM total) / spread), 9) AS w FROM centre JOIN spread USING (term) JOIN total USING (community)),
  score AS (SELECT community, sentence, sum(w) / sqrt(any_value(size)) AS score FROM word JOIN weigh USING (community, term) GROUP BY ALL),
  best AS (SELECT community, sentence, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY community ORDER BY round(coalesce(score, 0), 6) DESC, sentence) - 1 AS rank FROM said LEFT JOIN score USING (community, sentence) QUALIFY rank < 3),
  told AS (SELECT community, (SELECT count(*) FROM m WHERE m.community = b.community) AS members, string_agg(sentence, '. ' ORDER BY rank) || '.' AS summary FROM best b GROUP BY community)"""


def told(spark, sf):
    d = table(spark, sf, "documents")
    return communities.summaries(d.select(F.concat("lang", F.lit(":"), "source").alias("community"), F.col("doc_id").alias("node_id"), "text"))


@query("g17_community_summaries", f"WITH {_SENTENCES} SELECT * FROM told")
def g17_summaries(spark, sf):
    return told(spark, sf)


@query("g17_global_search", rf"""WITH {_SENTENCES}, terms AS (SELECT item_id AS query_id, len(t) AS size, unnest(t) AS term FROM (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2)) AS t FROM benchmark)),
  held AS (SELECT DISTINCT community, unnest(list_filter(regexp_split_to_array(lower(summary), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2)) AS term FROM told),
  hit AS (SELECT query_id, community, row_number() OVER (PARTITION BY query_id ORDER BY round(count(*) / any_value(size), 6) DESC, community) AS place FROM terms JOIN held USING (term) GROUP BY query_id, community QUALIFY place <= 10),
  answered AS (SELECT query_id, string_agg('[Community ' || place || ' (' || members || ')]' || chr(10) || summary, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS answer, list(community ORDER BY place) AS sources FROM hit JOIN told USING (community) GROUP BY query_id)
  SELECT item_id AS query_id, coalesce(answer, '') AS answer, coalesce(sources, []) AS sources FROM benchmark LEFT JOIN answered ON query_id = item_id""")
def g17_global(spark, sf):
    """Every benchmark text asked of all communities."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return communities.global_search(q, told(spark, sf))


def part_graph(spark, sf):
    """(nodes (node_id, node_type, label), edges, mentions) of parts, suppliers and brands; a supplier is a gap node that rests on what customers return."""
    n, e = sample_graph(spark, sf)
    names = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("node_id"), F.col("s_name").alias("name"))
    n = n.join(names, "node_id", "left").select("node_id", "node_type", F.coalesce("name", "node_id").alias("label"))
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    evidence = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id")
    said = line.where("l_returnflag = 'N'").select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("node_id"), F.col("l_partkey").alias("paper_id"), evidence)
    support = line.where("l_returnflag = 'R'").select(F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("node_id"), F.col("l_partkey").alias("paper_id"), evidence)
    return n, e, said, support


@query("g15_graph_scopes", f"""WITH {EDGES}, asked AS (SELECT n_nationkey AS request_id, ['supplier:' || (n_nationkey + 1), 'part:' || (n_nationkey * 3 + 1), 'part:none'] AS picks, n_nationkey % 4 AS hops FROM nation),
  picked AS (SELECT request_id, pos, picks[pos] AS node, least(hops, 2) AS most FROM (SELECT *, unnest([1, 2, 3]) AS pos FROM asked) WHERE picks[pos] IN (SELECT node_id FROM nodes)),
  h1 AS (SELECT DISTINCT request_id, b AS node FROM picked JOIN adj ON node = a WHERE most >= 1), h2 AS (SELECT DISTINCT request_id, b AS node FROM (SELECT p.request_id, j.b AS mid FROM picked p JOIN adj j ON p.node = j.a WHERE most = 2) JOIN adj ON mid = a),
  near AS (SELECT request_id, node FROM picked UNION SELECT * FROM h1 UNION SELECT * FROM h2), found AS (SELECT request_id, l_partkey AS paper_id, l_orderkey * 10 + l_linenumber AS evidence_id FROM near JOIN lineitem ON node = 'part:' || l_partkey WHERE l_returnflag = 'N' UNION ALL SELECT request_id, l_partkey, l_orderkey * 10 + l_linenumber FROM picked JOIN lineitem ON node = 'supplier:' || l_suppkey WHERE l_returnflag = 'R'),
  nn AS (SELECT request_id, count(*) AS nodes FROM near GROUP BY 1), ee AS (SELECT n.request_id, count(*) AS edges FROM near n JOIN edges ON n.node = src JOIN near o ON o.request_id = n.request_id AND o.node = dst GROUP BY 1),
  ff AS (SELECT request_id, count(DISTINCT paper_id) AS papers, count(DISTINCT evidence_id) AS evidence FROM found GROUP BY 1), ll AS (SELECT request_id, list(coalesce(s_name, node) ORDER BY pos) AS labels FROM picked LEFT JOIN supplier ON node = 'supplier:' || s_suppkey GROUP BY 1)
  SELECT request_id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(papers, 0) AS papers, coalesce(evidence, 0) AS evidence, coalesce(labels, []) AS labels,
    list_filter([CASE WHEN papers IS NULL THEN 'scope_no_papers' END, CASE WHEN evidence IS NULL THEN 'scope_no_evidence' END, CASE WHEN hops > 2 THEN 'hops_truncated' END], lambda x: x IS NOT NULL) AS warnings
  FROM asked LEFT JOIN nn USING (request_id) LEFT JOIN ee USING (request_id) LEFT JOIN ff USING (request_id) LEFT JOIN ll USING (request_id)""")
def g15_scopes(spark, sf):
    """A scope for each nation: a supplier, a part and an unknown node, with 0 to 3 hops."""
    k = F.col("n_nationkey")
    picks = F.array(F.concat(F.lit("supplier:"), k + 1), F.concat(F.lit("part:"), k * 3 + 1), F.lit("part:none"))
    asked = table(spark, sf, "nation").select(k.cast("long").alias("request_id"), picks.alias("nodes"), (k % 4).cast("int").alias("hops"))
    return communities.graph_scopes(asked, *part_graph(spark, sf)).report


@query("g17_local_search")
def g17_local(spark, sf):
    """Answers around each nation's supplier; the communities are brands and their parts, told by the parts' names. The order of many lines is tested on a small graph instead of SQL."""
    n, e, said, _ = part_graph(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_brand").alias("community"), F.concat(F.lit("part:"), F.col("p_partkey")).alias("node_id"), F.col("p_name").alias("text"))
    q = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("question"), F.array(F.concat(F.lit("supplier:"), F.col("n_nationkey") + 1)).alias("nodes"), F.lit(1).alias("hops"))
    return communities.local_search(q, n, e, p, communities.summaries(p), said)


@query("st4_cache", """WITH e AS (SELECT event_id, user_id AS owner, event_type AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  p AS (SELECT *, lag(us) OVER w AS prior, lag(i) OVER w AS j FROM e WINDOW w AS (PARTITION BY owner, key ORDER BY i)),
  s AS (SELECT a.event_id, count(DISTINCT b.key) FILTER (b.i > a.j AND b.i < a.i) AS between_, count(DISTINCT b.key) FILTER (a.us - b.us <= 86400000000) AS live FROM p a JOIN p b ON b.owner = a.owner AND b.i <= a.i GROUP BY a.event_id)
  SELECT owner, event_id, key, coalesce(us - prior <= 86400000000 AND between_ < 3, false) AS hit, CASE WHEN us - prior <= 86400000000 AND between_ < 3 THEN (us - prior) / 1000000 END AS age, CAST(least(3, live) AS INTEGER) AS held FROM p JOIN s USING (event_id)""")
def st4(spark, sf):
    """What of each user's events a cache of three kinds for a day, renewed by use, would have served; kept in a stream's state."""
    requests = events_in(spark, sf).select(F.col("user_id").alias("owner"), "event_id", F.col("event_type").alias("key"), "ts")
    return cache.run(cache.served(requests, 86400, 3, renew=True), scratch(spark))
