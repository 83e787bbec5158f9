"""Normalisation, hashing, matching and extraction of text, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters, digits and underscore of any script: Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"


def clean(c: Column) -> Column:
    """A missing string is an empty one."""
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(clean(c), F.lit(" \t\n\x0b\f\r"))


def normalize_doi(c: Column) -> Column:
    return stripped(F.regexp_replace(F.lower(stripped(c)), r"^(https?://doi\.org/|doi:)", ""))


def normalize_arxiv_id(c: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(c), r"^https?://arxiv\.org/abs/", ""), r"v\d+$", ""))


def normalize_title(c: Column) -> Column:
    """Lower case, words and single spaces only; a space where signs stood at an end stays."""
    return F.regexp_replace(F.regexp_replace(stripped(F.lower(clean(c))), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")


def _initials(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.left(F.lower(p), F.lit(1))), "")


def normalize_author(c: Column) -> Column:
    """'Last, First M' and 'First M Last' both become 'last fm'."""
    a = stripped(c)
    comma = F.trim(F.concat(F.lower(stripped(F.split_part(a, F.lit(","), F.lit(1)))), F.lit(" "), _initials(F.split(stripped(F.regexp_replace(a, r"^[^,]*,", "")), r"\s+"))))
    parts = F.split(a, r"\s+")
    plain = F.trim(F.concat(F.lower(F.element_at(parts, -1)), F.lit(" "), _initials(F.slice(parts, 1, F.size(parts) - 1))))
    return F.when(F.contains(a, F.lit(",")), comma).when(a == "", "").otherwise(plain)


def first_author(authors: Column) -> Column:
    return F.when(F.size(authors) > 0, normalize_author(authors[0])).otherwise("")


def dedup_key(doi: Column, arxiv_id: Column, title: Column, year: Column, authors: Column) -> Column:
    """The strongest identity that a record has, with its kind in front; null without any."""
    d, a, t, fa = normalize_doi(doi), normalize_arxiv_id(arxiv_id), normalize_title(title), first_author(authors)
    y = year.cast("string")
    dated = (t != "") & F.coalesce(year != 0, F.lit(False))
    return (
        F.when(d != "", F.concat(F.lit("doi:"), d))
        .when(a != "", F.concat(F.lit("arxiv:"), a))
        .when(dated & (fa != ""), F.concat(F.lit("tya:"), t, F.lit("|"), y, F.lit("|"), fa))
        .when(dated, F.concat(F.lit("title_year:"), t, F.lit("|"), y))
        .when(t != "", F.concat(F.lit("title:"), t))
    )


def short_hash(c: Column, n: int = 10) -> Column:
    return F.left(F.md5(c.cast("binary")), F.lit(n))


def pool_id(doi: Column, arxiv_id: Column, openalex_id: Column, s2_id: Column, title: Column) -> Column:
    has = lambda c: clean(c) != ""
    return (
        F.when(has(doi), F.concat(F.lit("doi_"), F.translate(normalize_doi(doi), "/.", "__")))
        .when(has(arxiv_id), F.concat(F.lit("arxiv_"), F.translate(normalize_arxiv_id(arxiv_id), ".", "_")))
        .when(has(openalex_id), F.concat(F.lit("oa_"), openalex_id))
        .when(has(s2_id), F.concat(F.lit("s2_"), s2_id))
        .otherwise(F.concat(F.lit("title_"), short_hash(F.lower(clean(title)), 12)))
    )


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility composition; Spark has no function for it."""
    return _nfkc(c)


def normalize_label(c: Column, aliases: dict[str, str] | None = None, compose: bool = True) -> Column:
    """One spelling of a label: case, signs, spaces and a plain plural are evened out, then aliases are looked up."""
    t = F.lower(stripped(c))
    t = nfkc(t) if compose else t
    t = F.regexp_replace(t, "[，。；：！？、（）【】「」『』]", " ")
    t = F.regexp_replace(t, r"[_\-]+", " ")
    t = stripped(F.regexp_replace(t, r"[\s\x{3000}]+", " "))
    t = F.regexp_replace(t, r"[.,;:]+$", "")
    t = F.when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3), F.left(t, F.length(t) - 1)).otherwise(t)
    return resolve_alias(t, aliases) if aliases else t


def resolve_alias(c: Column, aliases: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def split_values(c: Column) -> Column:
    """Values of a field that lists several; unknown ones are left out."""
    parts = F.transform(F.split(clean(c), "[,;、/]"), stripped)
    return F.filter(parts, lambda p: ~F.lower(p).isin("", "unknown", "n/a"))


#: What is hidden in logs, and by what.
SENSITIVE = (
    (r"sk-[a-zA-Z0-9]{20,}", "[REDACTED_API_KEY]"),
    (r"(?i)Bearer\s+[a-zA-Z0-9\-._~+/]+=*", "Bearer [REDACTED_TOKEN]"),
    (r"(?i)(api_key|apikey|authorization|cookie)\s*[:=]\s*\S+", "$1=[REDACTED]"),
    (r"[A-Z]:\\Users\\[^\s]+", "[REDACTED_PATH]"),
    (r"/home/[^\s]+", "[REDACTED_PATH]"),
)


def redact(c: Column, most: int = 200, patterns: tuple[tuple[str, str], ...] = SENSITIVE) -> Column:
    t = c
    for pattern, by in patterns:
        t = F.regexp_replace(t, pattern, by)
    size = F.length(c).cast("string")
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("...["), size, F.lit("chars]"))).otherwise(t)


def words(c: Column) -> Column:
    return F.filter(F.split(clean(c), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the word sets of two texts; 0 if either has none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(x) + F.size(y) - both)), F.lit(0.0))


def fuzzy_match(quote: Column, text: Column) -> Column:
    """Share of a quote's distinct words that a text has."""
    q = F.array_distinct(words(F.lower(quote)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(F.lower(text)))).cast("double"), F.size(q)), F.lit(0.0))


_CJK = r"[^\x{4e00}-\x{9fff}]+"


def estimated_tokens(c: Column) -> Column:
    """Two CJK characters or four others to a token."""
    cjk = F.length(F.regexp_replace(clean(c), _CJK, ""))
    return F.floor(cjk / 2).cast("int") + F.floor((F.length(clean(c)) - cjk) / 4).cast("int")


#: Ligatures and what they stand for.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def repaired(c: Column) -> Column:
    """Text from a page layout with its usual damage undone: glyph codes, ligatures, lost spaces, hyphens at line ends, loose citations, page numbers."""
    t = F.regexp_replace(clean(c), r"\(cid:\d+\)", "")
    for a, b in LIGATURES:
        t = F.replace(t, F.lit(a), F.lit(b))
    for pattern in (r"([a-z0-9)'’])([A-Z])", r"([a-z])(\()", r"(\))([a-zA-Z])", r"([,;])([a-zA-Z])"):
        t = F.regexp_replace(t, pattern, "$1 $2")
    t = F.regexp_replace(t, rf"({WORD}+)-[ \t]*\n[ \t]*({WORD}+)", "$1$2")
    t = F.regexp_replace(t, rf"({WORD})\s+\[(\d+(?:,\s*\d+)*)\]", r"$1\[$2\]")
    lines = F.filter(F.split(t, "\n"), lambda x: ~F.rlike(stripped(x), F.lit(r"^[-–—]?\s*\d{1,4}\s*[-–—]?$")))
    return F.array_join(lines, "\n")


def is_garbled(c: Column) -> Column:
    """Control characters, box glyphs, rare ideographs or too many odd signs."""
    n = F.length(c)
    share = lambda kept: F.coalesce(F.try_divide(F.length(F.regexp_replace(c, f"{kept}+", "")).cast("double"), n), F.lit(0.0))
    control = share(r"[^\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]")
    box = share(r"[^\x{25a0}\x{25a1}\x{fffd}]")
    odd = share(r"[\x{00}-\x{7f}\p{L}\p{N}\p{P}\s]")
    return (control > 0.05) | (box > 0.02) | F.rlike(c, F.lit(r"[\x{20000}-\x{2a6df}]{3,}")) | (odd > 0.3)


def is_poorly_spaced(c: Column, lines: int = 200, share: float = 0.3, longest: int = 20) -> Column:
    """One of the first lines consists of overlong words to more than a share."""
    long_share = lambda x: F.coalesce(F.try_divide(F.size(F.filter(words(x), lambda w: F.length(w) > longest)).cast("double"), F.size(words(x))), F.lit(0.0))
    return F.exists(F.slice(F.split(clean(c), "\n"), 1, lines), lambda x: long_share(x) > share)


def first_match(c: Column, rules: dict[str, list[str]], otherwise: str) -> Column:
    """The first rule one of whose keywords the lower-cased text holds."""
    t, out = F.lower(clean(c)), None
    for name, keywords in rules.items():
        hit = None
        for k in keywords:
            one = F.contains(t, F.lit(k))
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def holds_any(c: Column, phrases: list[str]) -> Column:
    t = F.lower(clean(c))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(t, F.lit(p.lower()))
    return out


def truncated_query(c: Column, most: int = 250) -> Column:
    """At most ``most`` characters, back to the last space if that keeps four fifths."""
    head = F.left(c, F.lit(most))
    space = F.lit(most) - F.instr(F.reverse(head), " ") + 1
    return F.when(F.length(c) <= most, c).when((F.instr(head, " ") > 0) & (space - 1 > 0.8 * most), F.left(head, space - 1)).otherwise(head)


def with_context(text: Column, title: Column, authors: Column, section: Column) -> Column:
    """A chunk with a sentence in front of where it is from."""
    by = F.when(F.size(authors) > 0, F.concat(F.lit(" by "), F.array_join(F.slice(authors, 1, 3), ", "))).otherwise("")
    part = F.when(clean(section) != "", F.concat(F.lit(" Section: "), section, F.lit("."))).otherwise("")
    return F.concat(F.lit('This chunk is from "'), clean(title), F.lit('"'), by, F.lit("."), part, F.lit("\n"), clean(text))


def cue_sentences(c: Column, cues: list[str], low: int = 10, high: int = 500, most: int = 3) -> Column:
    """The first sentences that hold a cue, of a sensible length."""
    s = F.transform(F.split(clean(c), r"\."), stripped)
    return F.slice(F.filter(s, lambda x: holds_any(x, cues) & (F.length(x) > low) & (F.length(x) < high)), 1, most)


def abstract_of(index: Column) -> Column:
    """A text from the positions of its words: map<string, array<int>>."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " ")


def parsed_json(c: Column) -> Column:
    """The first of the text, a fenced block, the outermost braces, and these without trailing commas and with straight quotes, that is JSON; as a string."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(F.regexp_replace(braces, r",\s*([}\]])", "$1"), "'", '"')
    tries = [F.when(x != "", F.try_parse_json(x)) for x in (c, fenced, braces, fixed)]
    return F.to_json(F.coalesce(*tries))
