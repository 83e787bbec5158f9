"""What lines and pages look like: headings, formulas, references, title and authors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import rules
from weft.functions.text import clean, is_garbled, stripped


def heading(line: Column, headings: dict[str, list[str]] | None = None) -> Column:
    """The section that a line opens, null if it is no heading.

    After a number a heading may go on; without one the line is the heading alone and starts with a capital or an ideograph.
    """
    s = stripped(line)
    low = F.lower(s)
    rest = F.when(F.rlike(s, F.lit(r"^\d+[.)]?\s+")), stripped(F.regexp_replace(low, r"^\d+[.)]?\s+", "")))
    out = None
    for section, names in (headings or rules.HEADINGS).items():
        alone = low.isin(names) & (F.length(s) < 30) & F.rlike(s, F.lit(r"^[\p{Lu}\x{4e00}-\x{9fff}]"))
        after = F.lit(False)
        for n in names:
            after = after | (rest == n) | rest.startswith(n + " ")
        hit = alone | F.coalesce(after & (F.length(rest) <= 60), F.lit(False))
        out = F.when(hit, section) if out is None else out.when(hit, section)
    return F.when((s != "") & (F.length(s) <= 100), out)


def is_formula(line: Column, signs: str = rules.FORMULA_SIGNS + "=+") -> Column:
    n = F.length(line)
    math = F.length(F.regexp_replace(line, f"[^{signs}]", ""))
    long_words = F.regexp_count(line, F.lit("[a-zA-Z]{4,}"))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    some = ((math >= 2) & (long_words < 5)) | ((math >= 1) & (long_words < 2) & (n < 30)) | ((math > 0.2 * n) & (long_words < 3)) | ((letters < 0.2 * n) & (math >= 1))
    return (n >= 3) & some


def axis_labels_end(lines: Column, start: Column, most: int = 20) -> Column:
    """The end of a block of axis labels that begins at ``start`` (from 0), or ``start``: short lines, most of them numbers or single signs."""
    part = F.transform(F.slice(lines, start + 1, F.lit(most)), stripped)
    stop = F.array_position(F.transform(part, lambda x: (F.length(x) > 30) | F.rlike(x, F.lit(r"(?i)^(figure|table|fig\.)\s+\d+"))), F.lit(True))
    size = F.when(stop > 0, stop - 1).otherwise(F.size(part)).cast("int")
    block = F.filter(F.slice(part, F.lit(1), size), lambda x: x != "")
    small = F.size(F.filter(block, lambda x: F.rlike(x, F.lit(r"^[\d.±\-+]+$")) | (F.length(x) <= 2)))
    return F.when((size >= 5) & (F.size(block) >= 5) & (small > 0.5 * F.size(block)), start + size).otherwise(start)


def page_flags(pages: Column) -> Column:
    """What is wrong with a document, from the texts of its pages."""
    chars = F.aggregate(pages, F.lit(0), lambda s, p: s + F.length(p))
    empty = F.size(F.filter(pages, lambda p: stripped(p) == ""))
    lines = F.flatten(F.transform(pages, lambda p: F.split(p, "\n")))
    short = F.size(F.filter(lines, lambda x: F.length(stripped(x)).between(1, 19)))
    flags = [
        F.when(chars < 100, "empty_pdf").when(chars < 500, "low_text_coverage"),
        F.when(empty > 0.5 * F.size(pages), "scanned_pdf_suspected"),
        F.when((F.size(lines) > 10) & (short > 0.6 * F.size(lines)), "too_many_short_lines"),
        F.when(is_garbled(F.array_join(pages, "\n")), "garbled_text"),
    ]
    return F.array_compact(F.array(*flags))


def references(text: Column) -> Column:
    """Entries of a list of references: by [n], by n., by starts with an author and a year, by empty lines, or the text as one."""
    t = clean(text)
    fit = lambda parts: F.filter(F.transform(parts, stripped), lambda p: p != "")
    bracket, number, blank = F.split(t, r"(?:^|\n)\s*\[\d+\]\s*"), F.split(t, r"(?:^|\n)\s*\d+\.\s+"), F.split(t, r"\n\s*\n")
    named = F.filter(fit(F.split(t, r"(?:^|\n)(?=\p{Lu}[\p{L}'-]+,\s[^\n]*\(\d{4}[a-z]?\))")), lambda p: F.length(p) > 10)
    return F.when(F.size(bracket) > 2, fit(bracket)).when(F.size(number) > 2, fit(number)).when(F.size(named) > 2, named).when(F.size(blank) > 1, fit(blank)).otherwise(fit(F.array(t)))


def reference_fields(raw: Column) -> dict[str, Column]:
    """doi, year, title and authors of one entry, as far as they can be told."""
    body = F.regexp_replace(F.regexp_replace(stripped(raw), r"^\[\d+\]\s*", ""), r"^\d+\.\s+", "")
    quotes = r"""^["'‘’“”]+|["'‘’“”]+$"""
    trim = lambda c: F.left(F.regexp_replace(stripped(c), quotes, ""), F.lit(200))
    after = F.regexp_extract(body, r"\(\s*\d{4}[a-z]?\s*\)\.\s*(.*)$", 1)
    dated = trim(F.coalesce(F.nullif(F.regexp_extract(after, r"^(.+?)\.\s+\p{Lu}", 1), F.lit("")), F.split_part(after, F.lit("."), F.lit(1))))
    second = trim(F.split_part(body, F.lit("."), F.lit(2)))
    first = F.split_part(body, F.lit("."), F.lit(1))
    first = stripped(F.regexp_replace(F.regexp_replace(first, r"\s*\(\s*\d{4}\s*\)\s*$", ""), r"\s+\d{4}\s*$", ""))
    names = F.filter(F.transform(F.split(first, r",\s*(?:and\s+)?|\s+and\s+"), stripped), lambda a: (a != "") & (F.length(a) < 60) & ~F.lower(a).isin("et al", "eds", "eds.", "vol", "no", "pp", "p"))
    return {
        "doi": F.regexp_replace(F.regexp_extract(raw, r"(10\.\d{4,}/[^\s,;]+)", 1), r"\.$", ""),
        "year": F.try_to_number(F.nullif(F.regexp_extract(raw, r"\b((?:19|20)\d{2})\b", 1), F.lit("")), F.lit("9999")).cast("int"),
        "title": F.when((after != "") & (F.length(dated) > 5), dated).when(F.length(second) > 5, second).otherwise(""),
        "authors": F.when((first != "") & (F.length(first) <= 200), names).otherwise(F.array().cast("array<string>")),
    }


_PLACES = r"(?i)\b(university|institute|department|laborator|school of|college|academy)"


def first_lines(text: Column, n: int = 10) -> Column:
    return F.slice(F.filter(F.transform(F.split(clean(text), "\n"), stripped), lambda x: x != ""), 1, n)


def guessed_title(text: Column) -> Column:
    """The first of the first lines that can be a title; empty if none can."""
    bad = lambda x: F.rlike(x, F.lit(r"^\d|@|(?i)abstract|introduction|copyright|proceedings")) | F.rlike(x, F.lit(_PLACES))
    ok = F.filter(first_lines(text), lambda x: F.length(x).between(10, 200) & ~bad(x))
    return F.coalesce(F.regexp_replace(F.get(ok, F.lit(0)), r"\s+", " "), F.lit(""))


def guessed_authors(text: Column) -> Column:
    """Names of the first line that lists two to twenty; marks and figures beside them go."""

    def names(line: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(line, r"[*†‡§¶\d]", ""), ","), stripped)
        word_ok = lambda p: F.forall(F.split(p, r"\s+"), lambda w: F.length(w).between(2, 20)) & F.size(F.split(p, r"\s+")).between(1, 5)
        return F.filter(parts, lambda p: (p != "") & word_ok(p))

    lists = F.transform(F.filter(first_lines(text), lambda x: F.length(x).between(5, 150) & ~F.rlike(x, F.lit(r"^\d")) & ~F.rlike(x, F.lit(_PLACES))), names)
    return F.coalesce(F.get(F.filter(lists, lambda n: F.size(n).between(2, 20)), F.lit(0)), F.array().cast("array<string>"))


def summary(section: Column, parts: dict[str, tuple[Column, int]], text: Column) -> Column:
    """A section's summary from what was extracted (name -> list and how many of it), else its beginning."""
    told = F.array_compact(F.array(*[F.when(F.size(a) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(a, 1, n), ", "))) for name, (a, n) in parts.items()]))
    head = F.concat(F.lit("["), section, F.lit("] "))
    start = stripped(F.left(clean(text), F.lit(300)))
    return F.when(F.size(told) > 0, F.concat(head, F.array_join(told, ". "))).when(start != "", F.concat(head, start)).otherwise("")
