"""Scores of records, chunks, evidence and vectors, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import rules
from weft.functions.text import clean, stripped, words


def quality(citations: Column, year: Column, most: Column, as_of_year: int) -> Column:
    """Citations against the batch's most, citations a year, and recency."""
    c, top = F.coalesce(citations, F.lit(0)), F.greatest(most, F.lit(1))
    norm = F.when(c > 0, F.sqrt(c) / F.sqrt(top)).otherwise(0.0)
    known = F.coalesce(year != 0, F.lit(False))
    age = F.lit(as_of_year) - year
    speed = F.least(F.lit(1.0), F.ln(1 + c / F.greatest(age, F.lit(1))) / F.ln(1 + top))
    velocity = F.when(c <= 0, 0.0).when(known, speed).otherwise(norm)
    recency = F.when(known, F.exp(-0.08 * F.greatest(age, F.lit(0)))).otherwise(0.3)
    return 0.75 * norm + 0.10 * velocity + 0.15 * recency


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunk_quality(text: Column) -> dict[str, Column]:
    """Parts of a chunk's quality and their weighted sum."""
    t = clean(text)
    length = once(F.size(words(t)), lambda n: F.when(n < 30, 0.2).when(n < 50, 0.5).when(n <= 1000, 1.0).when(n <= 1500, 0.8).otherwise(0.5))

    def dense(low: Column) -> Column:
        spread = F.try_divide(F.size(F.array_distinct(low)).cast("double"), F.size(low))
        content = F.try_divide(F.size(F.filter(low, lambda x: ~x.isin(rules.STOPWORDS))).cast("double"), F.size(low))
        return F.coalesce(F.least(F.lit(1.0), (spread * 0.5 + content * 0.5) * 1.5), F.lit(0.0))

    density = once(words(F.lower(t)), dense)
    sentence = F.rlike(t, F.lit(r"[.!?。！？]\s"))
    paragraphs = F.contains(t, F.lit("\n\n")) | (F.length(t) - F.length(F.replace(t, F.lit("\n"))) > 3)
    structure = F.least(F.lit(1.0), 0.5 + F.when(sentence, 0.3).otherwise(0.0) + F.when(paragraphs, 0.2).otherwise(0.0))
    cn = F.length(F.regexp_replace(t, r"[^\x{4e00}-\x{9fff}]+", ""))
    en = F.length(F.regexp_replace(t, "[^a-zA-Z]+", ""))
    language = once(F.struct(cn.alias("a"), en.alias("b")), lambda x: F.coalesce(F.try_divide(F.greatest(x["a"], x["b"]).cast("double"), x["a"] + x["b"]), F.lit(0.0)))

    def noisy(line: Column) -> Column:
        def judged(s: Column) -> Column:
            # The blocks that the signs are in are looked for first, as few lines have any.
            signs = F.when(F.rlike(s, F.lit(r"[±×÷\x{3b1}-\x{3b8}\x{2200}-\x{22ff}]")), F.length(F.regexp_replace(s, f"[^{rules.FORMULA_SIGNS}]+", ""))).otherwise(0)
            return (s != "") & ((signs > 0.2 * F.length(s)) | F.rlike(s, F.lit("^[0-9][0-9 ]*$")) | ((F.length(s) < 5) & ~F.rlike(s, F.lit(r"^\d+\."))))

        return once(stripped(line), judged)

    noise = once(F.split(t, "\n"), lambda lines: F.greatest(F.lit(0.0), 1.0 - F.size(F.filter(lines, noisy)) / F.greatest(F.size(lines), F.lit(1)) * 3))
    parts = {"length": length, "density": density, "structure": structure, "language": language, "noise": noise}
    total = sum((parts[k] * x for k, x in rules.CHUNK_WEIGHTS.items()), F.lit(0.0))
    return parts | {"quality": F.round(total, 3)}


def gap_confidence(source_types: Column, strength: Column, papers: Column, has_quote: Column) -> Column:
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    has = lambda s: F.array_contains(source_types, s)
    total = 0.3 + plus(has("future_work"), 0.2) + plus(has("possible_gap"), 0.2) + plus(strength == "high", 0.1) + plus(papers >= 2, 0.1) + plus(has_quote, 0.1)
    return F.least(F.lit(1.0), total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 beside a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Of a rank counted from 0."""
    return 1.0 / (k + rank + 1)


def citation(style: str, paper_id: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column) -> Column:
    """One of the styles simple, apa, gbt7714 and bibtex."""
    y = year.cast("string")
    dated = F.coalesce(y, F.lit("n.d."))
    head = F.coalesce(title, F.lit("N/A"))
    has = lambda c: clean(c) != ""
    opt = lambda c, before, after: F.when(has(c), F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    first3 = F.array_join(F.slice(authors, 1, 3), ", ")
    if style == "apa":

        def apa(a: Column) -> Column:
            p = F.split(F.trim(a), r"\s+")
            initials = F.array_join(F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: F.concat(F.left(x, F.lit(1)), F.lit("."))), "")
            return F.when(F.size(p) >= 2, F.concat(F.element_at(p, -1), F.lit(", "), initials)).otherwise(a)

        listed = F.transform(F.slice(authors, 1, 7), apa)
        listed = F.when(F.size(authors) > 7, F.concat(listed, F.array(F.concat(F.lit("... "), apa(F.element_at(authors, -1)))))).otherwise(listed)
        return F.concat(F.array_join(listed, ", "), F.lit(" ("), dated, F.lit("). "), head, F.lit("."), opt(venue, " ", "."), opt(doi, " https://doi.org/", ""))
    if style == "gbt7714":
        cjk = F.coalesce(F.rlike(authors[0], F.lit(r"[\x{4e00}-\x{9fff}]")), F.lit(False))
        more = F.when(F.size(authors) <= 3, "").when(cjk, "等").otherwise(", et al")
        return F.concat(first3, more, F.lit(". "), head, F.lit("[J]."), opt(venue, " ", ","), opt(y, " ", "."), opt(doi, " DOI: ", "."))
    if style == "bibtex":
        last = F.lower(F.element_at(F.split(F.trim(authors[0]), r"\s+"), -1))
        key = F.when(F.size(authors) > 0, F.concat(F.when(has(authors[0]), last).otherwise("unknown"), F.coalesce(y, F.lit("nd")))).otherwise(F.replace(paper_id, F.lit(":"), F.lit("_")))
        names = F.when(F.size(authors) > 0, F.array_join(authors, " and ")).otherwise("Unknown")
        return F.concat(
            F.lit("@article{"), key, F.lit(",\n  title = {"), head, F.lit("},\n  author = {"), names, F.lit("},\n"),
            opt(y, "  year = {", "},\n"), opt(venue, "  journal = {", "},\n"), opt(doi, "  doi = {", "},\n"), F.lit("}"),
        )
    return F.concat(F.lit("["), paper_id, F.lit("] "), first3, F.lit(" ("), dated, F.lit("). "), head, F.lit("."), opt(doi, " DOI: ", ""))
