"""Scopes of selected graph nodes, and search over communities: summaries of central sentences, answers for each, put together.

Everything is done for a table of requests or questions at once; a model is a hook, without which the rule's text stands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from weft.operators import graphs, ranking, store
from weft.operators.hooks import Writer
from weft.operators.lineage import cut
from weft.operators.structured import asked

#: Fixed value: what a model answers where a summary says nothing about a question.
NOTHING = "NO_RELEVANCE"


@dataclass(frozen=True)
class GraphScope:
    """``papers`` (request_id, paper_id), ``evidence`` (request_id, evidence_id) and ``report``, a row for each request:
    nodes, edges, papers and evidence (numbers of them), labels (of the first five selected nodes that exist) and warnings."""

    papers: DataFrame
    evidence: DataFrame
    report: DataFrame


def _near(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(selected nodes (key, node, pos, label) that exist, (key, node) within the hops of each request)."""
    known = nodes.groupBy(F.col("node_id").alias("node")).agg(F.min("label").alias("label"))
    picked = wanted.select(key, F.posexplode("nodes").alias("pos", "node"), F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce("hops", F.lit(1)))).alias("most"))
    picked = picked.groupBy(key, "node").agg(F.min("pos").alias("pos"), F.max("most").alias("most")).join(known, "node")
    around = graphs.neighbours(picked.select(F.col("node").alias("node_id")), edges, 2)
    near = around.join(picked.select(key, F.col("node").alias("seed"), "most"), "seed").where("hop <= most").select(key, "node").distinct()
    return picked, cut(near.join(known.select("node"), "node", "left_semi"))  # several results come from it


def _inside(near: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, edge_type) of the different edges both of whose ends a request has."""
    e = edges.select("src", "dst", "edge_type").distinct().join(near.withColumnRenamed("node", "src"), "src")
    return e.join(near.withColumnRenamed("node", "dst"), [key, "dst"]).select(key, "src", "dst", "edge_type")


def graph_scopes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, said: DataFrame, support: DataFrame) -> GraphScope:
    """What the selected nodes of each request (request_id, nodes array, hops) and those around them are said in.

    ``nodes`` is (node_id, label), ``edges`` (src, dst, edge_type), ``said`` the mentions (node_id, paper_id, evidence_id), ``support`` what gap nodes rest on
    in the same form, which counts where the gap itself is selected. Hops are 0 to 2, null is 1; more is cut, with a
    warning. Unknown and null nodes are passed over, repeated ones and repeated rows count once, null papers and evidence are none.
    An empty graph warns as well; every request with an id has its row.
    """
    wanted = requests.where("request_id is not null").dropDuplicates(["request_id"])
    picked, near = _near(wanted, nodes, edges, "request_id")
    found = near.join(said.withColumnRenamed("node_id", "node"), "node").select("request_id", "paper_id", "evidence_id")
    rests = picked.select("request_id", "node").join(support.withColumnRenamed("node_id", "node"), "node").select("request_id", "paper_id", "evidence_id")
    every = found.union(rests)
    papers, evidence = (every.select("request_id", c).where(F.col(c).isNotNull()).distinct() for c in ("paper_id", "evidence_id"))
    count = lambda rows, name: rows.groupBy("request_id").agg(F.count(F.lit(1)).alias(name))
    first = store.first_n(picked, ["request_id"], [F.asc("pos")], 5)
    names = first.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label")))["label"].alias("labels"))
    report = wanted.select("request_id", "hops")
    for more in (count(near, "n"), count(_inside(near, edges, "request_id"), "e"), count(papers, "p"), count(evidence, "v"), names):
        report = report.join(more, "request_id", "left")
    report = report.crossJoin(F.broadcast(nodes.limit(1).agg(F.count(F.lit(1)).alias("some"))))
    n = {c: F.coalesce(c, F.lit(0)) for c in "nepv"}
    warn = [F.when(F.col("some") == 0, "graph_not_found"), F.when(n["p"] == 0, "scope_no_papers"), F.when(n["v"] == 0, "scope_no_evidence"), F.when(F.col("hops") > 2, "hops_truncated")]
    out = report.select(
        "request_id", n["n"].alias("nodes"), n["e"].alias("edges"), n["p"].alias("papers"), n["v"].alias("evidence"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.array_compact(F.array(*warn)).alias("warnings")
    )
    return GraphScope(papers, evidence, out)


def sentences(text: Column) -> Column:
    """The sentences of a text without their end marks; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[.!?]+(?:\s|$)|\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def terms(text: Column) -> Column:
    """The different words of three letters or digits and more, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 2))


#: Words of all centres up to which they are broadcast; more meet the texts' words in a shuffle.
FEW = 250_000


def _said(rows: DataFrame) -> DataFrame:
    """(community, sentence, one, two, size, words): every sentence of (community, text) with its identity of 96 bits and its different words."""
    s = rows.where("community is not null").select("community", F.explode(sentences(F.col("text"))).alias("sentence"))
    s = s.select("community", "sentence", F.xxhash64("sentence").alias("one"), (F.crc32(F.encode("sentence", "UTF-8")) - (1 << 31)).cast("int").alias("two"), terms(F.col("sentence")).alias("words"))
    return s.withColumn("size", F.size("words"))


def central_sentences(rows: DataFrame, most: int = 3, centre: int | None = None) -> DataFrame:
    """(community, rank, sentence, score): of the texts (community, text), the ``most`` sentences of each community that are most like all of its sentences.

    A word weighs by the share of the community's sentences that have it, and more the fewer communities do (ln(1 + communities / those with the word)); all words count, or with ``centre`` that many of
    greatest weight. A sentence's score is the sum of its words' weights by the root of their number: its mean similarity to all sentences, had from
    the words of the centre instead of from pairs. Texts aren't shuffled: words are counted, and sentences known by hashes summed, before they meet; the
    words of the centres are joined to all words, by a broadcast where they are counted as few enough. Sentences count as often as they occur and are one in the result; the least of ties comes first. Null communities and texts without sentences add nothing.
    """
    said = _said(rows)
    have = said.select("community", F.explode("words").alias("term")).groupBy("community", "term").agg(F.count(F.lit(1)).alias("have"))
    have = have.withColumn("spread", F.count(F.lit(1)).over(Window.partitionBy("term")))
    total = said.groupBy("community").agg(F.count(F.lit(1)).alias("total"))
    all_ = total.agg(F.count(F.lit(1)).alias("communities"))
    # Rounded before ranking, here and below: sums of floating numbers depend on their order.
    weight = F.round(F.col("have") / F.col("total") * F.ln(1 + F.col("communities") / F.col("spread")), 9)
    weighed = have.join(total, "community").crossJoin(F.broadcast(all_)).select("community", "term", weight.alias("w"))
    weighed = cut(weighed if centre is None else ranking.ranked(weighed, "w", "term", ["community"], most=centre).select("community", "term", "w"))
    few = weighed.count() <= FEW
    word = said.select("community", "one", "two", "size", F.explode_outer("words").alias("term")).join(F.broadcast(weighed) if few else weighed, ["community", "term"], "left")
    sums = word.groupBy("community", "one", "two").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("w"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    times = F.col("n") / F.greatest("size", F.lit(1))
    score = F.round(F.col("w") / times / F.sqrt(F.greatest("size", F.lit(1))), 6)
    place = Window.partitionBy("community").orderBy(F.desc("score"))
    top = sums.select("community", "one", "two", score.alias("score")).withColumn("_p", F.rank().over(place)).where(F.col("_p") <= most).drop("_p")
    # All that share the last score are in; their texts decide.
    text = said.join(top, ["community", "one", "two"]).groupBy("community", "one", "two").agg(F.min("sentence").alias("sentence"), F.first("score").alias("score"))
    return ranking.ranked(text, "score", "sentence", ["community"], most=most).select("community", "rank", "sentence", "score")


def summaries(rows: DataFrame, most: int = 3, write: Writer | None = None) -> DataFrame:
    """(community, members, summary) of texts (community, node_id, text): the :func:`central_sentences` of each community, or what a model makes of them.

    Members are the different nodes. A community without any sentence has an empty summary, and no model is asked for it.
    """
    size = rows.where("community is not null and node_id is not null").groupBy("community").agg(F.count_distinct("node_id").alias("members"))
    top = central_sentences(rows, most).groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rank", "sentence")))["sentence"].alias("s"))
    out = size.join(top, "community", "left").withColumn("rule", F.coalesce(F.concat(F.array_join("s", ". "), F.lit(".")), F.lit("")))
    prompt = F.when(F.col("rule") != "", F.concat(F.lit("Summarize this community in 2 or 3 sentences. Members: "), F.col("members"), F.lit("\n"), F.col("rule")))
    return out.select("community", "members", _written(prompt, write, F.col("rule")).alias("summary"))


def _written(prompt: Column, write: Writer | None, fallback: Column) -> Column:
    """A model's text for the prompts that aren't null; the rule's where there is no model or it says nothing."""
    return fallback if write is None else F.coalesce(F.nullif(asked(write)(prompt), F.lit("")), fallback)


def global_search(questions: DataFrame, told: DataFrame, most: int = 10, write: Writer | None = None) -> DataFrame:
    """(query_id, answer, sources): each question (query_id, question) answered from the summaries (community, members, summary).

    The ``most`` communities whose summaries share most of the question's words answer it, each by its
    summary or by what a model draws from that; those of which the model says that it holds nothing are left out. A model may put the answers
    together; the rule sets them below each other. A question that no community answers has an empty answer and no sources. Questions meet summaries word by
    word in an equi-join; null ids are left out, of repeated ids the least question stays.
    """
    q = questions.where("query_id is not null").groupBy("query_id").agg(F.min("question").alias("question"))
    words = q.select("query_id", terms(F.col("question")).alias("_t")).select("query_id", F.size("_t").alias("size"), F.explode("_t").alias("term"))
    told = cut(told)  # a row a community, which is read twice
    held = told.select("community", F.explode(terms(F.col("summary"))).alias("term"))
    hits = words.join(held, "term").groupBy("query_id", "community").agg((F.count(F.lit(1)) / F.first("size")).alias("score"))
    best = ranking.ranked(hits.withColumn("score", F.round("score", 6)), "score", "community", ["query_id"], most=most)
    best = best.join(told, "community").join(q, "query_id")
    ask = F.concat(F.lit(f"Answer the question from this summary of a community; say {NOTHING} where it holds nothing about it.\n"), F.col("summary"), F.lit("\nQuestion: "), F.col("question"))
    answers = best.withColumn("said", F.trim(_written(ask, write, F.col("summary")))).where(~F.contains(F.col("said"), F.lit(NOTHING)) & (F.col("said") != ""))
    per = answers.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "community", "members", "said"))).alias("a"))
    block = F.transform("a", lambda x, i: F.concat(F.lit("[Community "), i + 1, F.lit(" ("), x["members"], F.lit(")]\n"), x["said"]))
    out = q.join(per, "query_id", "left").withColumn("rule", F.coalesce(F.array_join(block, "\n\n---\n\n"), F.lit("")))
    whole = F.when(F.col("rule") != "", F.concat(F.lit("Put these answers together; name what agrees, contradicts and is missing.\n"), F.col("rule"), F.lit("\nQuestion: "), F.col("question")))
    return out.select("query_id", F.trim(_written(whole, write, F.col("rule"))).alias("answer"), F.coalesce(F.col("a.community"), F.array().cast(ArrayType(told.schema["community"].dataType))).alias("sources"))


def _first(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key with their place."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_place") <= most)


def _joined(rows: DataFrame, key: str, order: list[Column], line: Column, most: int, name: str) -> DataFrame:
    top = _first(rows, key, order, most).select(key, "_place", line.alias("_line"))
    return top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_place", "_line")))["_line"].alias(name))


def local_search(questions: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, told: DataFrame, said: DataFrame, write: Writer | None = None) -> DataFrame:
    """(query_id, context, answer, sources, context_nodes): questions (query_id, question, nodes array, hops) answered around their nodes.

    The context has the first 20 of the nodes around (papers apart) with their types, 20 of the relations among them, and the summaries of the three communities with most of
    these nodes. ``nodes`` is (node_id, node_type, label), ``said`` the mentions; sources are the first ten papers said there. The answer
    is a model's, else the context. A question around which nothing is has an empty context and answer.
    """
    q = questions.where("query_id is not null").dropDuplicates(["query_id"])
    _, near = _near(q, nodes, edges, "query_id")
    known = nodes.groupBy(F.col("node_id").alias("node")).agg(F.min("node_type").alias("node_type"), F.min("label").alias("label"))
    around = near.join(known, "node")
    entities = _joined(around.where("node_type <> 'paper'"), "query_id", [F.asc("node")], F.concat(F.lit("  "), F.col("node_type"), F.lit(": "), F.left("label", F.lit(40))), 20, "entities")
    e = _first(_inside(near, edges, "query_id"), "query_id", [F.asc("src"), F.asc("dst"), F.asc("edge_type")], 20).drop("_place")
    ends = lambda end: known.select(F.col("node").alias(end), F.left("label", F.lit(30)).alias(f"_{end}"))
    relations = _joined(e.join(ends("src"), "src").join(ends("dst"), "dst"), "query_id", [F.asc("src"), F.asc("dst"), F.asc("edge_type")], F.concat(F.lit("  "), F.col("_src"), F.lit(" --"), F.col("edge_type"), F.lit("--> "), F.col("_dst")), 20, "relations")
    of = near.join(members.select("community", F.col("node_id").alias("node")).distinct(), "node").groupBy("query_id", "community").agg(F.count(F.lit(1)).alias("n"))
    communities = _joined(of.join(told.where("summary <> ''"), "community"), "query_id", [F.desc("n"), F.asc("community")], F.concat(F.lit("  "), F.left("summary", F.lit(200))), 3, "communities")
    papers = near.join(said.select(F.col("node_id").alias("node"), "paper_id"), "node").where("paper_id is not null").select("query_id", "paper_id").distinct()
    sources = _joined(papers, "query_id", [F.asc("paper_id")], F.col("paper_id"), 10, "sources")
    shown = _joined(around.where("node_type <> 'paper'"), "query_id", [F.asc("node")], F.col("node"), 10, "context_nodes")
    out = q.select("query_id", "question")
    for more in (entities, relations, communities, sources, shown):
        out = out.join(more, "query_id", "left")
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"[{head}]\n"), F.array_join(c, "\n")))
    out = out.withColumn("context", F.concat_ws("\n", part("entities", "entities"), part("relations", "relations"), part("communities", "communities")))
    prompt = F.when(F.col("context") != "", F.concat(F.lit("Answer from this context; name the entities and relations used.\n"), F.col("context"), F.lit("\nQuestion: "), F.col("question")))
    return out.select("query_id", "context", _written(prompt, write, F.col("context")).alias("answer"), F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources"), F.coalesce("context_nodes", F.array().cast("array<string>")).alias("context_nodes"))
