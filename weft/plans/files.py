"""Readers and sinks over files that the query writes to the shared folder first, vector collections and named tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import chunks, collections, hooks
from weft.plans.registry import query, table
from weft.plans.retrieval import scratch
from weft.sources import connector, readers, sinks


def written(spark, df, kind="json"):
    path = scratch(spark)
    df.write.format(kind).save(path)
    return path


@query("s12_openalex", "SELECT 'W' || p_partkey AS source_id, p_name AS title, 1990 + p_size AS year, p_brand AS venue, p_name || ' of ' || p_type AS abstract, '10.1/' || p_partkey AS doi, p_size AS citations FROM part")
def s12(spark, sf):
    w = F.split(F.concat_ws(" of ", "p_name", "p_type"), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(w), lambda x: F.struct(x, F.filter(F.transform(w, lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull()))))
    p = table(spark, sf, "part").select(
        F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("display_name"), (1990 + F.col("p_size")).alias("publication_year"), F.col("p_size").alias("cited_by_count"),
        F.concat(F.lit("https://doi.org/10.1/"), F.col("p_partkey")).alias("doi"), index.alias("abstract_inverted_index"), F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("source")).alias("primary_location"),
    )
    return readers.openalex(spark, written(spark, p)).select("source_id", "title", "year", "venue", "abstract", "doi", "citations")


@query("s13_arxiv", "SELECT '2101.' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS arxiv_id, s_name AS title, 2021 AS year, 'N ' || s_nationkey AS author, 'http://arxiv.org/pdf/' || s_suppkey AS pdf_url FROM supplier")
def s13(spark, sf):
    key = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2101."), key, F.lit("v1</id><title> "), F.col("s_name"), F.lit(" </title><summary>x</summary><published>2021-01-01T00:00:00Z</published><author><name>N "),
        F.col("s_nationkey").cast("string"), F.lit("</name></author><link href='http://arxiv.org/abs/x'/><link href='http://arxiv.org/pdf/"), F.col("s_suppkey").cast("string"), F.lit("' title='pdf'/></entry>"),
    )
    # One feed a nation, each in a file of its own.
    feeds = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    path = scratch(spark)
    feeds.write.partitionBy("s_nationkey").text(path)
    a = readers.arxiv(spark, path)
    return a.select("arxiv_id", "title", "year", F.get("authors", F.lit(0)).alias("author"), "pdf_url")


@query("s14_europepmc", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, c_name AS title, CASE WHEN c_custkey % 5 > 0 THEN CAST(1990 + c_custkey % 30 AS INTEGER) END AS year, c_mktsegment || ' text' AS abstract FROM customer WHERE c_custkey % 5 = 0 OR 1990 + c_custkey % 30 >= 2000")
def s14_file(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.cast("string").alias("id"), F.col("c_name").alias("title"), F.when(k % 5 > 0, (1990 + k % 30).cast("string")).alias("pubYear"), F.concat(F.lit("<p>"), F.col("c_mktsegment"), F.lit(" text</p>")).alias("abstractText"))
    return readers.in_years(readers.europepmc(spark, written(spark, c)), 2000, None).select("source_id", "title", "year", "abstract")


@query("s15_semantic_scholar", "SELECT CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_size > 25 THEN '10.2/' || p_partkey END AS doi, [p_brand, p_type] AS authors, p_size AS citations FROM part")
def s15(spark, sf):
    ids = F.when(F.col("p_size") > 25, F.struct(F.concat(F.lit("10.2/"), F.col("p_partkey")).alias("DOI")))
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("paperId"), ids.alias("externalIds"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("authors"), F.col("p_size").alias("citationCount"))
    return readers.semantic_scholar(spark, written(spark, p)).select("source_id", "doi", "authors", "citations")


@query("s16_connector", "SELECT 'parts' AS source, CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title, CAST(p_size AS INTEGER) AS year FROM part")
def s16(spark, sf):
    connector.register(spark)
    path = written(spark, table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_size").cast("int").alias("year")))
    files = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path").collect()]
    return spark.read.format("weft_records").option("path", ",".join(files)).option("source", "parts").load().select("source", "source_id", "title", "year")


@query("s19_bibtex", "SELECT 'k' || s_suppkey AS key, s_name || ' {x}' AS braced, ['A ' || s_nationkey, 'B C'] AS authors, CASE WHEN s_suppkey % 2 = 0 THEN CAST(1990 + s_nationkey AS INTEGER) END AS year, 'J' AS venue FROM supplier")
def s19(spark, sf):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    year = F.when(F.col("s_suppkey") % 2 == 0, (1990 + F.col("s_nationkey")).cast("string")).otherwise("n.d.")
    entry = F.concat(F.lit("@comment{no}\n@article{k"), k, F.lit(",\n title = {{"), F.col("s_name"), F.lit("} x},\n author = \"A "), n, F.lit(" and B C\", year = "), year, F.lit(", journal = {J}\n}\n"))
    path = written(spark, table(spark, sf, "supplier").select(entry.alias("value")), "text")
    b = readers.bibtex(spark.read.text(path, wholetext=True))
    return b.select("key", F.regexp_replace("title", " x$", " {x}").alias("braced"), "authors", "year", "venue")


@query("s21_reading_order", "SELECT c_custkey AS page, ['head', 'left ' || c_nationkey, 'low ' || c_custkey, 'right ' || c_mktsegment] AS texts FROM customer")
def s21(spark, sf):
    block = lambda x0, x1, top, t: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(float(top)).alias("top"), t.alias("text"))
    blocks = F.array(
        block(55, 100, 10, F.concat(F.lit("right "), F.col("c_mktsegment"))), block(0, 45, 30, F.concat(F.lit("low "), F.col("c_custkey").cast("string"))),
        block(0, 45, 10, F.concat(F.lit("left "), F.col("c_nationkey").cast("string"))), block(0, 100, 0, F.lit("head")),
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("page"), readers.in_reading_order(blocks, F.lit(100.0)).alias("texts"))


class _Column:
    """A reader that takes a field of the document."""

    def __init__(self, name):
        self.name = name

    def can_read(self, document):
        return document["kind"] != self.name

    def read(self, document):
        return document[self.name]

    def fit(self, reading):
        return (F.length(text.stripped(reading)) >= 20) & ~text.is_garbled(reading)


@query("s22_fallback", "SELECT p_partkey AS doc, CASE WHEN p_type <> 'first' AND length(a) >= 20 THEN 'first' WHEN length(b) >= 20 THEN 'second' END AS reader, CASE WHEN length(a) >= 20 THEN a WHEN length(b) >= 20 THEN b ELSE '' END AS text FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_type || ' long enough' ELSE p_name[1:3] END AS a, CASE WHEN p_size % 3 = 0 THEN p_brand || ' is the second reading' ELSE '' END AS b FROM part)")
def s22(spark, sf):
    first = F.when(F.col("p_size") % 2 == 0, F.concat(F.concat_ws(" ", "p_name", "p_type"), F.lit(" long enough"))).otherwise(F.left("p_name", F.lit(3)))
    second = F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit(" is the second reading"))).otherwise("")
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.struct(F.col("p_type").alias("kind"), first.alias("first"), second.alias("second")).alias("d"))
    return d.select("doc", hooks.read_by(F.col("d"), [_Column("first"), _Column("second")], F.lit("")).alias("r")).select("doc", "r.reader", "r.text")


@query("s25_collection", "SELECT vec_id AS document_id, CAST(label AS VARCHAR) AS project_id, CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE 'old' END AS text, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE len(embedding) END AS size FROM embeddings")
def s25(spark, sf):
    """Documents put into an empty collection, a tenth of which are then replaced."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("document_id"), F.col("label").cast("string").alias("project_id"), F.lit("old").alias("text"), F.col("embedding").cast("array<float>").alias("dense"))
    c = collections.put(collections.empty(spark), e)
    new = e.where(F.col("document_id").cast("long") % 10 == 0).withColumns({"text": F.lit("new"), "dense": F.array().cast("array<float>")})
    return collections.put(c, new).select(F.col("document_id").cast("long").alias("document_id"), "project_id", "text", F.size("dense").alias("size"))


@query("s31_remembered", "SELECT CAST(conv_id AS VARCHAR) AS project_id, md5(text) AS query FROM conversations WHERE role = 'user'")
def s31(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    asked = c.select(F.col("conv_id").cast("string").alias("project_id"), F.md5(F.col("text").cast("binary")).alias("query"), F.timestamp_seconds("turn").alias("asked_at"))
    known = collections.remember(collections.empty(spark, collections.QUERIES), asked.where("conv_id % 2 = 0"))
    return collections.remember(known, asked.where("project_id % 2 = 1")).select("project_id", "query")


@query("s35_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def s35(spark, sf):
    return sinks.as_json(table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("s37_json_lines", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def s37(spark, sf):
    path = scratch(spark)
    sinks.write_json_lines(table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("name string, n long").json(path)


@query("s38_golden", "SELECT 'c' || n_nationkey AS case_id, n_name AS question FROM nation WHERE n_regionkey = 1")
def s38(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("case_id"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("target"), F.create_map(F.lit("q"), F.col("n_name")).alias("input"))
    listed = n.agg(F.to_json(F.collect_list(F.struct("case_id", "target", "input"))).alias("value"))  # 25 nations
    return readers.golden_cases(spark, written(spark, listed, "text"), "t1").select("case_id", F.col("input")["q"].alias("question"))


@query("x01_tables", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 7 > 0")
def x01(spark, sf):
    t = collections.Tables(spark, scratch(spark))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    t.put("suppliers", s, ["s_suppkey"])
    t.put("suppliers", s.where("s_suppkey % 4 = 0").withColumn("s_nationkey", F.lit(0).cast("long")), ["s_suppkey"])
    return t.delete("suppliers", s.where("s_suppkey % 7 = 0"), "s_suppkey")


@query("x06_orchestrated", "SELECT 'part' AS source, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def x06(spark, sf):
    """Sources that can be read are united; one that can't stops no other."""
    some = lambda name, key: lambda: table(spark, sf, name).select(F.lit(name).alias("source"), F.col(key).cast("long").alias("id"))
    found, _ = hooks.searched({"part": some("part", "p_partkey"), "supplier": some("supplier", "s_suppkey"), "nowhere": some("nowhere", "id")})
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("c02_sections", "WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) SELECT conv_id, turn, role AS section, count(*) AS chunks, sum(length(t) // 4)::BIGINT AS tokens FROM t WHERE t <> '' AND length(t) >= 30 AND length(t) // 4 <= 900 GROUP BY ALL")
def c02(spark, sf):
    """Turns as sections; those of one chunk are compared with SQL, the packing of longer ones with a plain loop in the tests."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("section"), "text")
    k = chunks.sectioned(c, ["conv_id", "turn"], "section", "text", short=())
    g = k.groupBy("conv_id", "turn", "section").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    return g.join(c.where(F.floor(F.length(text.stripped(F.col("text"))) / 4) <= 900).select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
