"""Scalar functions over the documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import rules, scores, text
from weft.operators import edits, records
from weft.plans.registry import query, table

WS = r"'^\s+|\s+$', '', 'g'"


@query("f01_normalize_doi", "SELECT doc_id, '10.1/a' || doc_id || CASE WHEN doc_id % 3 = 2 THEN 'b' ELSE '' END AS doi FROM documents")
def f01(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" https://doi.org/10.1/A"), i)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("DOI:10.1/a"), i, F.lit(" "))).otherwise(F.concat(F.lit("10.1/A"), i, F.lit("B")))
    return d.select("doc_id", text.normalize_doi(raw).alias("doi"))


@query("f02_normalize_arxiv", "SELECT doc_id, '2101.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS arxiv_id FROM documents")
def f02(spark, sf):
    d, i = table(spark, sf, "documents"), F.lpad(F.col("doc_id").cast("string"), 5, "0")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/2101."), i, F.lit("v2"))).otherwise(F.concat(F.lit(" 2101."), i))
    return d.select("doc_id", text.normalize_arxiv_id(raw).alias("arxiv_id"))


TITLE = r"regexp_replace(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')"


def first_line(c="text"):
    return F.split_part(F.col(c), F.lit("\n"), F.lit(1))


@query("f03_normalize_title", f"SELECT doc_id, {TITLE} AS title FROM documents")
def f03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_title(first_line()).alias("title"))


@query("f04_normalize_author", "SELECT p_partkey AS paper_id, lower(list_extract(w, -1)) || ' ' || lower(list_aggregate(list_transform(w[1:-2], lambda x: left(x, 1)), 'string_agg', '')) AS plain, lower(list_extract(w, -1)) || ' ' || lower(list_aggregate(list_transform(w[1:-2], lambda x: left(x, 1)), 'string_agg', '')) AS turned FROM (SELECT p_partkey, string_split(p_name || ' ' || p_brand, ' ') AS w FROM part)")
def f04(spark, sf):
    name = F.concat_ws(" ", "p_name", "p_brand")
    w = F.split(name, " ")
    turned = F.concat(F.element_at(w, -1), F.lit(", "), F.array_join(F.slice(w, 1, F.size(w) - 1), " "))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), text.normalize_author(name).alias("plain"), text.normalize_author(turned).alias("turned"))


@query("f05_dedup_key", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'doi:10.5/' || doc_id WHEN doc_id % 5 = 1 THEN 'arxiv:2001.' || doc_id WHEN {TITLE} = '' THEN NULL WHEN doc_id % 5 = 2 THEN 'tya:' || {TITLE} || '|2001|doe j' WHEN doc_id % 5 = 3 THEN 'title_year:' || {TITLE} || '|2001' ELSE 'title:' || {TITLE} END AS dedup_key FROM documents")
def f05(spark, sf):
    i, s = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    key = text.dedup_key(F.when(i == 0, F.concat(F.lit("10.5/"), s)), F.when(i == 1, F.concat(F.lit("2001."), s, F.lit("v3"))), first_line(), F.when(i < 4, 2001), F.when(i == 2, F.array(F.lit("Jane Doe"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf, "documents").select("doc_id", key.alias("dedup_key"))


@query("f06_pool_id", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'doi_10_5_' || doc_id WHEN 1 THEN 'arxiv_2001_' || doc_id WHEN 2 THEN 'oa_W' || doc_id WHEN 3 THEN 's2_' || doc_id ELSE 'title_' || left(md5(lower(text)), 12) END AS pool_id FROM documents")
def f06(spark, sf):
    i, s = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    put = lambda k, before: F.when(i == k, F.concat(F.lit(before), s))
    return table(spark, sf, "documents").select("doc_id", text.pool_id(put(0, "10.5/"), put(1, "2001."), put(2, "W"), put(3, ""), F.col("text")).alias("pool_id"))


@query("f07_normalize_label", r"SELECT p_partkey AS paper_id, CASE WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END AS label FROM (SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(lower(p_name || '_' || p_type || 's.'), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g')), '[.,;:]+$', '') AS t FROM part)")
def f07(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), text.normalize_label(F.concat(F.col("p_name"), F.lit("_"), F.col("p_type"), F.lit("s.")), rules.ALIASES).alias("label"))


@query("f08_resolve_alias", "SELECT p_partkey AS paper_id, CASE p_partkey % 4 WHEN 0 THEN 'gnn' WHEN 1 THEN 'question answering' WHEN 2 THEN 'cifar' ELSE p_name END AS label FROM part")
def f08(spark, sf):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "graph neural network").when(k == 1, "qa").when(k == 2, "cifar10").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), text.resolve_alias(raw, rules.ALIASES).alias("label"))


@query("f09_split_values", "SELECT p_partkey AS paper_id, array_to_string(list_filter([p_brand, p_type, CASE WHEN p_partkey % 2 = 0 THEN p_name END], lambda x: x IS NOT NULL), '|') AS listed FROM part")
def f09(spark, sf):
    raw = F.concat(F.col("p_brand"), F.lit("; "), F.col("p_type"), F.lit(" 、 unknown ,"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("unknown"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.array_join(text.split_values(raw), "|").alias("listed"))


@query("f10_stable_hash", "SELECT doc_id, left(md5(text), 10) AS hash10, left(md5(text), 12) AS hash12 FROM documents")
def f10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.short_hash(F.col("text")).alias("hash10"), text.short_hash(F.col("text"), 12).alias("hash12"))


@query("f11_redact", r"SELECT doc_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '...[' || length(text) || 'chars]' ELSE t END AS redacted FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, 'token\s*=\s*\"[^\"]*\"', 'token=[REDACTED]', 'g'), 'sk-[a-zA-Z0-9]{20,}', '[REDACTED_API_KEY]', 'g'), '/home/[^\s]+', '[REDACTED_PATH]', 'g') AS t FROM documents)")
def f11(spark, sf):
    patterns = ((r'token\s*=\s*"[^"]*"', "token=[REDACTED]"), *text.SENSITIVE)
    return table(spark, sf, "documents").select("doc_id", text.redact(F.col("text"), 200, patterns).alias("redacted"))


@query("f12_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS shown, CASE WHEN doc_id % 2 = 0 THEN '***' ELSE source END AS masked FROM documents")
def f12(spark, sf):
    d = table(spark, sf, "documents")
    held = F.create_map(F.when(F.col("doc_id") % 2 == 0, "token").otherwise("origin"), F.col("source"))
    masked = F.map_values(F.transform_values(held, lambda k, v: F.when(k.isin("token", "api_key", "password", "secret"), "***").otherwise(v)))[0]
    return d.select("doc_id", F.when(F.length("text") > 80, F.concat(F.left("text", F.lit(80)), F.lit("..."))).otherwise(F.col("text")).alias("shown"), masked.alias("masked"))


@query("f13_jaccard", "SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS x FROM documents) a JOIN (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS y FROM documents) b ON b.doc_id = a.doc_id + 1")
def f13(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    a, b = d.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), d.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("f14_levenshtein", "SELECT s_suppkey AS a, c_custkey AS b, levenshtein(s_name, c_name) AS distance FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def f14(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return edits.distances(c, s).select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")


@query("f15_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f15(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", F.round(scores.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("f16_sparse_dot", "WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 3))) AS w FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS dot FROM t a JOIN t b ON a.w = b.w AND b.doc_id = a.doc_id + 1 GROUP BY ALL")
def f16(spark, sf):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 3))
    t = table(spark, sf, "documents").select("doc_id", F.explode(w).alias("w"))
    b = t.select((F.col("doc_id") - 1).alias("a"), "w")
    return t.withColumnRenamed("doc_id", "a").join(b, ["a", "w"]).groupBy("a").agg(F.count(F.lit(1)).alias("dot")).select("a", (F.col("a") + 1).alias("b"), "dot")


@query("f17_fuzzy_match", r"WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS q FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS w FROM documents), u AS (SELECT item_id, len(q) AS n, unnest(q) AS w FROM q) SELECT item_id, doc_id, round(count(*) * 1.0 / any_value(n), 6) AS share FROM u JOIN d USING (w) GROUP BY item_id, doc_id HAVING count(*) >= 0.6 * any_value(n)")
def f17(spark, sf):
    """Every quote in every document; the expression for one pair is :func:`text.fuzzy_match`."""
    w = text.words(F.lower("text"))
    held = records.quotes_held(table(spark, sf, "benchmark"), "item_id", w, table(spark, sf, "documents"), "doc_id", w)
    return held.withColumn("share", F.round("share", 6))


@query("f18_tokens", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def f18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


REPAIR = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9)''’])([A-Z])', '\1 \2', 'g'), '([a-z])(\()', '\1 \2', 'g'), '(\))([a-zA-Z])', '\1 \2', 'g'), '([,;])([a-zA-Z])', '\1 \2', 'g'), '([\p{L}\p{N}_]+)-[ \t]*\n[ \t]*([\p{L}\p{N}_]+)', '\1\2', 'g'), '([\p{L}\p{N}_])\s+\[(\d+(?:,\s*\d+)*)\]', '\1[\2]', 'g')"""


@query("f19_repair", rf"SELECT doc_id, md5(array_to_string(list_filter(string_split({REPAIR}, chr(10)), lambda x: NOT regexp_matches(trim(x), '^[-–—]?\s*\d{{1,4}}\s*[-–—]?$')), chr(10))) AS repaired FROM documents")
def f19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.repaired(F.col("text")).cast("binary")).alias("repaired"))


@query("f23_garbled", r"SELECT doc_id, length(regexp_replace(text, '[\x{00}-\x{7f}\p{L}\p{N}\p{P}\s]', '', 'g')) > 0.3 * length(text) AS garbled FROM documents")
def f23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_garbled(F.col("text")).alias("garbled"))


@query("f24_poor_spacing", r"SELECT doc_id, len(list_filter(string_split(text, chr(10))[1:200], lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: length(w) > 12)) > 0.3 * len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')))) > 0 AS poor FROM documents")
def f24(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_poorly_spaced(F.col("text"), longest=12).alias("poor"))


@query("f29_limitation_type", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'licence' WHEN contains(lower(text), ' and ') THEN 'conjunction' WHEN contains(lower(text), ' der ') OR contains(lower(text), ' die ') THEN 'article' ELSE 'unknown' END AS kind FROM documents")
def f29(spark, sf):
    cues = {"licence": ["license"], "conjunction": [" and "], "article": [" der ", " die "]}
    return table(spark, sf, "documents").select("doc_id", text.first_match(F.col("text"), cues, "unknown").alias("kind"))


@query("f30_intent", "SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'limitation_analysis' WHEN 1 THEN 'method_compare' WHEN 2 THEN 'gap_analysis' ELSE 'summary' END AS intent FROM conversations")
def f30(spark, sf):
    k = (F.col("conv_id") + F.col("turn")) % 4
    q = F.when(k == 0, "Which Limitation?").when(k == 1, "Compare the method").when(k == 2, "a GAP").otherwise("tell me")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.first_match(q, rules.INTENTS, "summary").alias("intent"))


@query("f31_gap_confidence", "SELECT o_orderkey AS id, round(least(1.0, 0.3 + CASE WHEN o_orderkey % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE 0 END + CASE WHEN o_custkey % 5 >= 2 THEN 0.1 ELSE 0 END + CASE WHEN o_totalprice > 100000 THEN 0.1 ELSE 0 END), 6) AS confidence FROM orders")
def f31(spark, sf):
    kinds = F.filter(F.array(F.when(F.col("o_orderkey") % 2 == 0, "future_work"), F.when(F.col("o_orderkey") % 3 == 0, "possible_gap")), lambda x: x.isNotNull())
    c = scores.gap_confidence(kinds, F.when(F.col("o_orderstatus") == "F", "high").otherwise("low"), F.col("o_custkey") % 5, F.col("o_totalprice") > 100000)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(c, 6).alias("confidence"))


@query("f32_generic", "SELECT doc_id, contains(lower(text), 'that the') OR contains(lower(text), 'von der') AS generic FROM documents")
def f32(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.holds_any(F.col("text"), ["that the", "von der"]).alias("generic"))


@query("f33_explicit_gaps", "SELECT o_orderkey AS id, f AS field, v AS statement FROM (SELECT o_orderkey, unnest(['limitation', 'future_work']) AS f, unnest([o_orderpriority, o_orderstatus]) AS v FROM orders) WHERE contains(lower(v), 'urgent') OR contains(lower(v), 'p')")
def f33(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("limitation"), F.col("o_orderstatus").alias("future_work"))
    long = o.unpivot("id", ["limitation", "future_work"], "field", "statement")
    return long.where(text.holds_any(F.col("statement"), ["urgent", "p"]))


@query("f34_evidence_type", "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_returnflag <> 'N' THEN 'finding' WHEN l_linestatus = 'O' THEN 'limitation' ELSE '' END AS kind FROM lineitem")
def f34(spark, sf):
    known = lambda c: (text.clean(c) != "") & (c != "unknown")
    finding, limitation = F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.col("l_returnflag")), F.when(F.col("l_linestatus") == "O", "O")
    kind = F.when(known(finding), "finding").when(known(limitation), "limitation").otherwise("")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), kind.alias("kind"))


_P = "SELECT p_partkey, p_name, p_brand, 1990 + p_size AS y, [p_name, 'Ann Lee', 'B. C. Doe', 'Max'][1:1 + p_partkey % 4] AS a FROM part"


@query("f35_citations", f"""WITH p AS ({_P}) SELECT p_partkey AS paper_id,
 '[' || p_partkey || '] ' || array_to_string(a[1:3], ', ') || ' (' || y || '). ' || p_name || '.' AS simple,
 array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ', et al' ELSE '' END || '. ' || p_name || '[J]. ' || p_brand || ', ' || y || '.' AS gbt7714,
 array_to_string(list_transform(a, lambda s: CASE WHEN len(string_split(s, ' ')) >= 2 THEN list_extract(string_split(s, ' '), -1) || ', ' || array_to_string(list_transform(string_split(s, ' ')[1:-2], lambda x: left(x, 1) || '.'), '') ELSE s END), ', ') || ' (' || y || '). ' || p_name || '. ' || p_brand || '.' AS apa,
 '@article{{' || lower(list_extract(string_split(p_name, ' '), -1)) || y || ',' || chr(10) || '  title = {{' || p_name || '}},' || chr(10) || '  author = {{' || array_to_string(a, ' and ') || '}},' || chr(10) || '  year = {{' || y || '}},' || chr(10) || '  journal = {{' || p_brand || '}},' || chr(10) || '}}' AS bibtex FROM p""")
def f35(spark, sf):
    p = table(spark, sf, "part")
    a = F.slice(F.array(F.col("p_name"), F.lit("Ann Lee"), F.lit("B. C. Doe"), F.lit("Max")), F.lit(1), (1 + F.col("p_partkey") % 4).cast("int"))
    args = (F.col("p_partkey").cast("string"), F.col("p_name"), a, 1990 + F.col("p_size"), F.col("p_brand"), F.lit(None).cast("string"))
    return p.select(F.col("p_partkey").alias("paper_id"), *[scores.citation(s, *args).alias(s) for s in ("simple", "apa", "gbt7714", "bibtex")])


@query("f36_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f36(spark, sf):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here: ```json\n"), F.col("props"), F.lit("\n``` ok"))).otherwise(F.concat(F.lit("so "), F.regexp_replace(F.col("props"), r"\}$", ",}"), F.lit(" end")))
    return table(spark, sf, "events").select("event_id", F.get_json_object(text.parsed_json(said), "$.k").cast("long").alias("k"))


@query("f37_truncate_query", "SELECT doc_id, CASE WHEN length(text) <= 250 THEN text WHEN contains(left(text, 250), ' ') AND 250 - instr(reverse(left(text, 250)), ' ') > 200 THEN left(text, CAST(250 - instr(reverse(left(text, 250)), ' ') AS INTEGER)) ELSE left(text, 250) END AS q FROM documents")
def f37(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncated_query(F.col("text")).alias("q"))


@query("f38_extract", "SELECT doc_id, '2101.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS arxiv_id, CAST(1990 + doc_id % 30 AS INTEGER) AS year FROM documents")
def f38(spark, sf):
    i = F.lpad(F.col("doc_id").cast("string"), 5, "0")
    url = F.concat(F.lit("http://arxiv.org/abs/2101."), i, F.lit("v1"))
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract(url, r"abs/([^v]+)", 1).alias("arxiv_id"), F.regexp_extract(F.concat((1990 + F.col("doc_id") % 30).cast("string"), F.lit("-05-01T00:00:00Z")), r"^(\d{4})", 1).cast("int").alias("year"))


@query("f39_context", "SELECT doc_id, md5('This chunk is from \"' || source || '\" by ' || lang || ', x. Section: body.' || chr(10) || text) AS chunk FROM documents")
def f39(spark, sf):
    c = text.with_context(F.col("text"), F.col("source"), F.array("lang", F.lit("x")), F.lit("body"))
    return table(spark, sf, "documents").select("doc_id", F.md5(c.cast("binary")).alias("chunk"))


@query("f40_cue_sentences", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: (contains(lower(x), ' and ') OR contains(lower(x), ' und ')) AND length(x) > 10 AND length(x) < 500)[1:3], '|') AS found FROM documents")
def f40(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.cue_sentences(F.col("text"), [" and ", " und "]), "|").alias("found"))


@query("f43_age", "SELECT o_orderkey AS id, 2002 - CAST(year(o_orderdate) AS INTEGER) AS age FROM orders")
def f43(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (2002 - F.year("o_orderdate")).alias("age"))


@query("f44_parse_score", "SELECT doc_id, 100 - CASE WHEN length(text) < 200 THEN 40 WHEN length(text) < 1000 THEN 20 ELSE 0 END - CASE WHEN len(string_split(text, chr(10))) < 3 THEN 20 ELSE 0 END AS score FROM documents")
def f44(spark, sf):
    n, lines = F.length("text"), F.size(F.split("text", "\n"))
    return table(spark, sf, "documents").select("doc_id", (100 - F.when(n < 200, 40).when(n < 1000, 20).otherwise(0) - F.when(lines < 3, 20).otherwise(0)).alias("score"))


@query("p02_abstract", r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS abstract FROM documents WHERE regexp_matches(text, '\S')")
def p02(spark, sf):
    d = table(spark, sf, "documents")
    w = d.select("doc_id", F.posexplode(text.words(F.col("text"))).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = w.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("i"))
    return index.select("doc_id", text.abstract_of(F.col("i")).alias("abstract"))


_TOK = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query("c08_chunk_quality", rf"""WITH d AS (SELECT doc_id, text, {_TOK} AS w, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS lw, string_split(text, chr(10)) AS ln FROM documents), s AS (SELECT doc_id,
 CASE WHEN len(w) < 30 THEN 0.2 WHEN len(w) < 50 THEN 0.5 WHEN len(w) <= 1000 THEN 1.0 WHEN len(w) <= 1500 THEN 0.8 ELSE 0.5 END AS a,
 CASE WHEN len(lw) = 0 THEN 0 ELSE least(1.0, (CAST(len(list_distinct(lw)) AS DOUBLE) / len(lw) * 0.5 + CAST(len(list_filter(lw, lambda x: NOT list_contains(['the','a','an','is','are','was','were','in','on','at','to','for','of','with','and','or','but','not'], x))) AS DOUBLE) / len(lw) * 0.5) * 1.5) END AS b,
 least(1.0, 0.5 + CASE WHEN regexp_matches(text, '[.!?。！？]\s') THEN 0.3 ELSE 0 END + CASE WHEN contains(text, chr(10) || chr(10)) OR len(ln) - 1 > 3 THEN 0.2 ELSE 0 END) AS c,
 CASE WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) = 0 THEN 0.0 ELSE 1.0 END AS e,
 greatest(0.0, 1.0 - CAST(len(list_filter(list_transform(ln, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND (regexp_matches(replace(x, ' ', ''), '^[0-9]+$') OR (length(x) < 5 AND NOT regexp_matches(x, '^\d+\.'))))) AS DOUBLE) / len(ln) * 3) AS f FROM d)
 SELECT doc_id, round(CAST(0.25 * a + 0.25 * b + 0.2 * c + 0.15 * e + 0.15 * f AS DOUBLE), 3) AS quality FROM s""")
def c08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scores.chunk_quality(F.col("text"))["quality"].alias("quality"))
