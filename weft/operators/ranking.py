"""Ranked lists: ranks, fusion, thresholds with a fallback, retrieval by vectors and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import scores
from weft.operators import dense


def ranked(df: DataFrame, score: str, tie: str, within: list[str] | None = None, name: str = "rank", most: int | None = None) -> DataFrame:
    """With the place of each row by falling score, from 0; ``tie`` decides between equal ones.

    With ``within`` each group has its own ranks. Without, all rows have one order: ``most`` then
    bounds the rows that are ranked, by a distributed top-k, so that only those meet in one task.
    """
    if not within and most is not None:
        df = df.orderBy(F.desc(score), F.asc(tie)).limit(most)
    w = Window.partitionBy(*(within or [])).orderBy(F.desc(score), F.asc(tie))
    out = df.withColumn(name, F.row_number().over(w) - 1)
    return out.where(F.col(name) < most) if within and most is not None else out


def fuse(lists: list[DataFrame], key: list[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: (key, rrf) over lists that have key and rank."""
    every = lists[0].select(*key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(*key, "rank"))
    return every.groupBy(*key).agg(F.sum(scores.reciprocal_rank(F.col("rank"), k)).alias("rrf"))


def fuse_pair(a: DataFrame, b: DataFrame, key: list[str], group: list[str], k: int = 60) -> DataFrame:
    """Fusion of two lists where whoever is missing from one has the rank after the last of list a."""
    size = a.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else a.agg(F.count(F.lit(1)).alias("_n"))
    both = a.select(*key, F.col("rank").alias("_a")).join(b.select(*key, F.col("rank").alias("_b")), key, "full")
    both = both.join(size, group, "left") if group else both.crossJoin(F.broadcast(size))
    n = F.coalesce("_n", F.lit(0))
    return both.select(*key, (scores.reciprocal_rank(F.coalesce("_a", n), k) + scores.reciprocal_rank(F.coalesce("_b", n), k)).alias("rrf"))


def intersect_ranks(a: DataFrame, b: DataFrame, key: list[str], top_k: int) -> DataFrame:
    """(key, score): what both lists have, by 1 - (rank a + rank b) / 2k with the first rank of each."""
    first = lambda x, n: x.groupBy(*key).agg(F.min("rank").alias(n))
    return first(a, "_a").join(first(b, "_b"), key).select(*key, (1 - (F.col("_a") + F.col("_b")) / (2.0 * top_k)).alias("score"))


def at_least(df: DataFrame, score: str, threshold: float, least: int, order: list[Column], within: list[str]) -> DataFrame:
    """Rows with the score; where fewer than ``least`` have it in a group with more, the first ``least`` by ``order`` instead."""
    g = Window.partitionBy(*within)
    out = df.withColumn("_ok", F.coalesce(F.col(score) >= threshold, F.lit(False)))
    out = out.withColumns({"_good": F.sum(F.col("_ok").cast("int")).over(g), "_n": F.count(F.lit(1)).over(g), "_place": F.row_number().over(g.orderBy(*order))})
    few = (F.col("_good") < least) & (F.col("_n") > least)
    return out.where((few & (F.col("_place") <= least)) | (~few & F.col("_ok"))).drop("_ok", "_good", "_n", "_place")


def within_budget(df: DataFrame, cost: str, budget: int, order: list[Column], within: list[str]) -> DataFrame:
    """The rows of each group before the first at which the running cost exceeds the budget."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_sum", F.sum(cost).over(w))
    return out.withColumn("_over", F.max((F.col("_sum") > budget).cast("int")).over(w)).where("_over = 0").drop("_sum", "_over")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", vector: str = "vector", block: int = 16384, within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest of ``corpus`` by cosine for each of a stated set of queries; with ``within`` of those with the query's value of this column.

    At most ``block`` queries are sent to the corpus at a time, which is dealt to the tasks
    once for each such block; each task keeps its own best ``k`` before they meet. Vectors that are null or zero, hold nulls or
    are not as long as the query's have a score of 0. Ids are whole numbers; null ones are left out.
    """
    kinds = dict(queries.dtypes)[query_id], dict(corpus.dtypes)[id_col]
    group = F.col(within) if within else F.lit(0)
    of = lambda df, key, name: df.select(F.col(key).cast("long").alias(name), group.alias("grp"), F.col(vector).alias("vector"))
    found = dense.nearest(of(queries, query_id, "query_id"), of(corpus, id_col, "id"), k, block)
    return ranked(found.select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("id").cast(kinds[1]).alias("id"), "score"), "score", "id", ["query_id"], most=k)


def postings(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, tf, size)."""
    each = docs.select(F.col(id_col).alias("id"), terms.alias("_t")).select("id", F.size("_t").alias("size"), F.explode("_t").alias("term"))
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))


def field_postings(docs: DataFrame, id_col: str, fields: list[tuple[Column, float]], queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (id, term, tf, size) of the terms that ``queries`` (query_id, term) ask for, one row with n and avg of all sizes).

    Each field is an array of terms with a weight, by which its terms and its length count. Sizes
    come with the row, so that only asked terms are shuffled. A document without terms counts for nothing;
    null fields are empty; repeated rows of one id are one document.
    """
    empty = F.array().cast("array<string>")
    size = sum((F.size(F.coalesce(t, empty)) * w for t, w in fields), F.lit(0.0))
    weighed = lambda w: lambda x: F.struct(x.alias("term"), F.lit(float(w)).alias("w"))
    each = F.concat(*[F.transform(F.coalesce(t, empty), weighed(w)) for t, w in fields])
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), each.alias("_t")).where("size > 0")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg"))
    flat = rows.select("id", "size", F.explode("_t").alias("t")).select("id", "size", "t.term", "t.w")
    wanted = flat.join(queries.select("term").distinct(), "term", "left_semi")
    return wanted.groupBy("id", "term").agg(F.sum("w").alias("tf"), F.first("size").alias("size")), stats


def asked_postings(docs: DataFrame, id_col: str, terms: Column, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`field_postings` of one field of weight 1."""
    return field_postings(docs, id_col, [(terms, 1.0)], queries)


def phrase_bonus(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, id_col: str, points: dict[str, float]) -> DataFrame:
    """(query_id, id_col, bonus): for each phrase of two or three words of a query the ``points`` of every field that has it.

    Words are runs of letters and digits in lower case. Phrases meet in an equi-join, each once a query and a field,
    so no text is looked through for another's. Null texts have no phrases.
    """

    def phrases(rows: DataFrame, c: str, key: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        w = rows.select(F.col(key), words.alias("_w"))  # a column, so that it is split once
        n = F.size("_w")
        two = F.transform("_w", lambda x, i: F.concat_ws(" ", x, F.get("_w", i + 1)))
        three = F.transform("_w", lambda x, i: F.concat_ws(" ", x, F.get("_w", i + 1), F.get("_w", i + 2)))
        first = lambda a, k: F.slice(a, F.lit(1), F.greatest(n - k, F.lit(0)))
        return w.select(key, F.explode(F.concat(first(two, 1), first(three, 2))).alias("phrase"))

    asked = phrases(queries, query_text, query_id).distinct()
    wanted = asked.select("phrase").distinct()
    found = None
    for field, value in points.items():
        mine = phrases(docs, field, id_col).join(wanted, "phrase", "left_semi").distinct().withColumn("p", F.lit(float(value)))
        found = mine if found is None else found.union(mine)
    return asked.join(found, "phrase").groupBy(query_id, id_col).agg(F.sum("p").alias("bonus"))


def tf_idf(p: DataFrame, n_docs: DataFrame, most_features: int = 10_000) -> DataFrame:
    """(id, term, weight): sublinear term frequency, smooth inverse document frequency, unit length; the most frequent terms only."""
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    vocab = df.orderBy(F.desc("total"), F.asc("term")).limit(most_features)
    idf = vocab.crossJoin(F.broadcast(n_docs)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = p.join(F.broadcast(idf), "term").select("id", "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_matches(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, score): dot products over shared terms, by an equi-join of postings (query_id, term, weight) and (id, term, weight)."""
    q = queries.select("query_id", "term", F.col("weight").alias("_w"))
    return corpus.join(q, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("_w")).alias("score"))


def bm25(queries: DataFrame, p: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.4) -> DataFrame:
    """(query_id, id, score) of Okapi BM25; queries are (query_id, term), postings and ``stats`` those of :func:`field_postings`."""
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", "avg", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hit = p.join(idf, "term").select("id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg")))).alias("s"))
    return hit.join(queries, "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def distribution_scores(df: DataFrame, score: str, within: list[str]) -> DataFrame:
    """Scores scaled by mean and three standard deviations of their list, cut to 0..1."""
    g = Window.partitionBy(*within)
    m, s = F.avg(score).over(g), F.coalesce(F.stddev_pop(score).over(g), F.lit(0.0))
    x = F.coalesce(F.try_divide(F.col(score) - (m - 3 * s), 6 * s), F.lit(0.5))
    return df.withColumn("scaled", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
