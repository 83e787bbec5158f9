"""Answers and reports: scoring evidence, verifying candidates, comparing versions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.functions import rules
from weft.functions.text import clean, fuzzy_match


def known(c: Column) -> Column:
    return (clean(c) != "") & (c != "unknown")


def evidence_score(question_words: Column, intent: str, fields: dict[str, Column], strength: Column, quote: Column, status: Column | None = None) -> Column:
    """Points of a piece of evidence for a question: preferred fields, words in fields, a quote, strength and review."""
    points = F.lit(0.0)
    for f in rules.INTENT_FIELDS.get(intent, ["finding", "topic"]):
        if f in fields:
            points = points + F.when(known(fields[f]), 4).otherwise(0)
    hits = lambda c: F.size(F.filter(question_words, lambda w: F.contains(F.lower(c), w)))
    for f in ("finding", "limitation", "future_work"):
        if f in fields:
            points = points + F.when(known(fields[f]), F.least(hits(fields[f]), F.lit(3))).otherwise(0)
    for f in ("topic", "method"):
        if f in fields:
            points = points + F.when(known(fields[f]) & (hits(fields[f]) > 0), 2).otherwise(0)
    points = points + F.when(clean(quote) != "", 1).otherwise(0) + F.when(strength == "high", 1).when(strength == "low", -2).otherwise(0)
    return points if status is None else points + F.when(status == "low", -2).otherwise(0)


def candidate_score(novelty: Column, evidence: Column, feasibility: Column, risk: Column, specificity: Column, counters: Column, verdict: Column) -> Column:
    total = 0.25 * novelty + 0.25 * evidence + 0.2 * feasibility + 0.1 * risk + 0.2 * specificity
    total = total - F.least(F.lit(0.3), 0.1 * counters)
    return total + F.when(verdict == "verified", 0.05).when(verdict == "contradicted", -0.15).otherwise(0.0)


def validated_spans(spans: DataFrame, known: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """``spans`` (key, quote, ...) with ``status``: missing if no text of ``known`` (key, text) has the key, held if it has the quote, fuzzy if a share ``least`` of its words, else unheld.

    A quote is looked for in the text that it names, whole and in lower case, so that the join is on the key. An empty or null quote is held.
    """
    j = spans.join(known.select(key, F.lower("text").alias("_text")), key, "left")
    quote = F.lower(F.coalesce(F.col("quote"), F.lit("")))
    status = F.when(F.col("_text").isNull(), "missing").when(F.contains("_text", quote), "held").when(fuzzy_match(quote, F.col("_text")) >= least, "fuzzy").otherwise("unheld")
    return j.withColumn("status", status).drop("_text")


def verdicts(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, verdict): contradicted if any outcome is, verified if all are, else unverified."""
    c = F.col(outcome)
    v = F.when(F.bool_or(c == "contradicted"), "contradicted").when(F.bool_and(c == "verified"), "verified").otherwise("unverified")
    return df.groupBy(key).agg(v.alias("verdict"))


_DIFF = StructType([StructField(n, LongType()) for n in ("added", "removed", "changed", "kept")])


@F.pandas_udf(_DIFF)
def paragraph_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Paragraphs added, removed, changed and kept from one text to another."""
    rows = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        x, y = ([p for p in t.split("\n") if p.strip()] for t in (x, y))
        n = {"insert": 0, "delete": 0, "replace": 0, "equal": 0}
        for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            n[tag] += max(j - i, m - k)
        rows.append((n["insert"], n["delete"], n["replace"], n["equal"]))
    return pd.DataFrame(rows, columns=["added", "removed", "changed", "kept"])


def restored(versions: DataFrame, key: str, number: str, wanted: DataFrame, content: str = "content") -> DataFrame:
    """New versions with the content of the wanted ones (key, number), numbered after the last; ``expected`` in ``wanted`` must be the last number, others are left out."""
    last = versions.groupBy(key).agg(F.max(number).alias("_last"))
    w = wanted.join(last, key).where(F.col("expected") == F.col("_last"))
    return w.join(versions, [key, number]).select(key, (F.col("_last") + 1).alias(number), content)
