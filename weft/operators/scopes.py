"""Scopes: which papers a question may use, and what of an answer lies outside.

A scope is a table with one column ``paper_id``, without nulls or repeated rows. Scopes meet by semi-joins, so none is
sent through the driver; a small one is broadcast by the optimizer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import graphs


def scope_of(rows: DataFrame, paper: Column | str = "paper_id") -> DataFrame:
    """The papers of ``rows``, each once; null papers are left out."""
    c = F.col(paper) if isinstance(paper, str) else paper
    return rows.select(c.alias("paper_id")).where("paper_id is not null").distinct()


def all_papers(papers: DataFrame, excluded: Column) -> DataFrame:
    """Every paper but the excluded ones; where the condition is null, a paper is not excluded."""
    return scope_of(papers.where(~F.coalesce(excluded, F.lit(False))))


def selected(wanted: DataFrame, papers: DataFrame, in_project: Column, excluded: Column) -> DataFrame:
    """(paper_id, reason): each wanted paper once, as valid, not_found, project_mismatch or excluded, the first that is true."""
    known = papers.select("paper_id", F.coalesce(in_project, F.lit(False)).alias("_in"), F.coalesce(excluded, F.lit(False)).alias("_out"), F.lit(True).alias("_known"))
    j = scope_of(wanted).join(known, "paper_id", "left")
    reason = F.when(F.col("_known").isNull(), "not_found").when(~F.col("_in"), "project_mismatch").when(F.col("_out"), "excluded").otherwise("valid")
    return j.select("paper_id", reason.alias("reason"))


def by_topics(evidence: DataFrame, topics: list[str], column: str = "topic") -> DataFrame:
    """Papers with evidence whose topic holds one of ``topics``, in any case; none for an empty list."""
    hit = reduce(Column.__or__, [F.contains(F.lower(column), F.lit(t.lower())) for t in topics], F.lit(False))
    return scope_of(evidence.where(hit))


def by_methods(evidence: DataFrame, methods: DataFrame, on: str) -> DataFrame:
    """Papers with evidence of one of ``methods``, a table of keys."""
    return scope_of(evidence.join(methods.select(on), on, "left_semi"))


def by_graph(seeds: DataFrame, edges: DataFrame, prefix: str, hops: int = 1) -> DataFrame:
    """(node): nodes whose id begins with ``prefix`` within ``hops`` of the seeds (node_id)."""
    return graphs.neighbours(seeds, edges, hops).where(F.col("node").startswith(prefix)).select("node").distinct()


def by_years(papers: DataFrame, first: int | str | None, last: int | str | None) -> DataFrame:
    """Papers of the years between both, in whichever order they are given. What is no number is no bound; papers without a year are left out."""
    given = [int(x) for x in (first, last) if x is not None and str(x).strip().lstrip("-").isdigit()]
    out = papers.where("year is not null")
    if len(given) == 2:
        out = out.where(F.col("year").between(min(given), max(given)))
    elif first is not None and given:
        out = out.where(F.col("year") >= given[0])
    elif given:
        out = out.where(F.col("year") <= given[0])
    return scope_of(out)


def in_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Papers of the first scope that are in every other one as well."""
    return reduce(lambda a, b: a.join(b.select("paper_id"), "paper_id", "left_semi"), others, first).select("paper_id")


def evidence_within(evidence: DataFrame, scope: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows of ``evidence`` whose paper is in the scope and that satisfy the condition."""
    rows = evidence if condition is None else evidence.where(condition)
    return rows.join(scope.select("paper_id"), "paper_id", "left_semi")


def violations(cited: DataFrame, scope: DataFrame, answer: str = "answer") -> DataFrame:
    """(answer, violations, score): citations of each answer outside of the scope, and 1 less a tenth for each, 0 at least."""
    inside = scope.select("paper_id", F.lit(True).alias("_in"))
    g = cited.join(inside, "paper_id", "left").groupBy(answer).agg(F.count_if(F.col("_in").isNull()).alias("violations"))
    return g.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 0.1 * F.col("violations")), 6))


def kept_within(answers: DataFrame, scope: DataFrame, answer: str, confidence: float, penalty: float = 0.3) -> DataFrame:
    """(answer, kept, confidence): citations inside of the scope, and a confidence less ``penalty``, 0.1 at least, where one is outside."""
    inside = scope.select("paper_id", F.lit(True).alias("_in"))
    g = answers.join(inside, "paper_id", "left").groupBy(answer).agg(F.count("_in").alias("kept"), F.count_if(F.col("_in").isNull()).alias("_out"))
    return g.select(answer, "kept", F.when(F.col("_out") > 0, F.round(F.greatest(F.lit(0.1), F.lit(confidence - penalty)), 6)).otherwise(F.lit(confidence)).alias("confidence"))


def dropped_by_cause(candidates: DataFrame, scope: DataFrame, cause: str) -> DataFrame:
    """(cause, dropped): candidates whose paper is not in the scope, counted by cause."""
    return candidates.join(scope.select("paper_id"), "paper_id", "left_anti").groupBy(cause).agg(F.count(F.lit(1)).alias("dropped"))


def graph_page(nodes: DataFrame, edges: DataFrame, source_holds: str, target_holds: str) -> DataFrame:
    """(src, dst): edges between nodes whose ids hold the two texts; edges with an end that is no node are left out."""
    ids = lambda text, end: nodes.where(F.contains("node_id", F.lit(text))).select(F.col("node_id").alias(end))
    return edges.join(ids(source_holds, "src"), "src", "left_semi").join(ids(target_holds, "dst"), "dst", "left_semi").select("src", "dst")


def widened(rows: DataFrame, narrow: Column, least: int) -> DataFrame:
    """Rows that satisfy ``narrow``; all rows where fewer than ``least`` do."""
    few = rows.where(narrow).limit(least).agg((F.count(F.lit(1)) < least).alias("_few"))
    return rows.crossJoin(F.broadcast(few)).where(F.coalesce(narrow, F.lit(False)) | F.col("_few")).drop("_few")
