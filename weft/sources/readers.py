"""Records of bibliographic services, replayed from files, and other inputs; one flat schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import abstract_of, normalize_arxiv_id, stripped

#: Columns of a search result.
RESULT = "source string, source_id string, title string, authors array<string>, year int, venue string, abstract string, doi string, arxiv_id string, url string, pdf_url string, citations int"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
#: Adapters by source: what each can search by.
FIELDS = {"openalex": ("all", "title"), "arxiv": ("all", "title", "author", "abstract"), "europepmc": ("all", "title", "author"), "semantic_scholar": ("all",)}


def supported(source: str, field: str) -> str:
    """The field, or all where the source can't search by it."""
    return field if field in FIELDS.get(source, ("all",)) else "all"


def _flat(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    kinds = dict(c.split(" ", 1) for c in RESULT.split(", "))
    put = {"source": F.lit(source)} | columns
    return df.select(*[put.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


_OPENALEX = "id string, display_name string, publication_year int, cited_by_count int, doi string, abstract_inverted_index map<string,array<int>>, primary_location struct<source:struct<display_name:string>,pdf_url:string,landing_page_url:string>, authorships array<struct<author:struct<display_name:string>>>"


def openalex(spark: SparkSession, path: str) -> DataFrame:
    """Works, one JSON object a line."""
    w = spark.read.schema(_OPENALEX).json(path)
    place = F.col("primary_location")
    return _flat(
        w, "openalex", source_id=F.regexp_replace("id", "^https://openalex.org/", ""), title=F.col("display_name"),
        authors=F.transform("authorships", lambda a: a["author"]["display_name"]), year=F.col("publication_year"), venue=place["source"]["display_name"],
        abstract=abstract_of(F.col("abstract_inverted_index")), doi=F.regexp_replace("doi", "^https?://doi.org/", ""), url=place["landing_page_url"], pdf_url=place["pdf_url"], citations=F.col("cited_by_count"),
    )


_EUROPEPMC = "id string, title string, authorString string, pubYear string, journalTitle string, abstractText string, doi string, citedByCount int"


def europepmc(spark: SparkSession, path: str) -> DataFrame:
    """Results, one JSON object a line; markup in abstracts goes."""
    r = spark.read.schema(_EUROPEPMC).json(path)
    return _flat(
        r, "europepmc", source_id=F.col("id"), title=F.col("title"), authors=F.filter(F.transform(F.split(F.rtrim("authorString"), ","), lambda a: F.regexp_replace(stripped(a), r"\.$", "")), lambda a: a != ""),
        year=F.try_to_number("pubYear", F.lit("9999")), venue=F.col("journalTitle"), abstract=F.regexp_replace("abstractText", "<[^>]+>", ""), doi=F.col("doi"), citations=F.col("citedByCount"),
    )


_S2 = "paperId string, title string, year int, venue string, abstract string, citationCount int, url string, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string>, openAccessPdf struct<url:string>"


def semantic_scholar(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.schema(_S2).json(path)
    return _flat(
        p, "semantic_scholar", source_id=F.col("paperId"), title=F.col("title"), authors=F.transform("authors", lambda a: a["name"]), year=F.col("year"), venue=F.col("venue"), abstract=F.col("abstract"),
        doi=F.col("externalIds.DOI"), arxiv_id=F.col("externalIds.ArXiv"), url=F.col("url"), pdf_url=F.col("openAccessPdf.url"), citations=F.col("citationCount"),
    )


_ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string,_title:string>>"


def arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds."""
    e = spark.read.schema(_ATOM).option("rowTag", "entry").format("xml").load(path)
    one_space = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    key = normalize_arxiv_id(F.regexp_replace("id", "^http:", "https:"))
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    return _flat(
        e, "arxiv", source_id=key, arxiv_id=key, title=one_space("title"), abstract=one_space("summary"), authors=F.transform("author", lambda a: a["name"]),
        year=F.left("published", F.lit(4)), url=F.col("id"), pdf_url=pdf,
    )


def in_years(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Records between the years, either of which may be open; those without a year stay."""
    c = F.lit(True)
    c = c & (F.col("year") >= low) if low else c
    c = c & (F.col("year") <= high) if high else c
    return df.where(F.col("year").isNull() | c)


def parse_bibtex(text: str | None) -> list[dict]:
    """Entries of a BibTeX file with braces in balance; comments, preambles and strings are passed over."""
    out, at, text = [], 0, text or ""
    while (m := re.compile(r"@(\w+)\s*\{").search(text, at)) is not None:
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        at = end
        if m[1].lower() in ("comment", "preamble", "string") or depth:
            continue
        body, fields = text[m.end() : end - 1], {}
        key, _, body = body.partition(",")
        i = 0
        while (f := re.compile(r"\s*([\w-]+)\s*=\s*").match(body, i)) is not None:
            i = f.end()
            if i < len(body) and body[i] == "{":
                j, d = i + 1, 1
                while j < len(body) and d:
                    d += {"{": 1, "}": -1}.get(body[j], 0)
                    j += 1
                value, i = body[i + 1 : j - 1], j
            elif i < len(body) and body[i] == '"':
                j = body.find('"', i + 1)
                j = len(body) if j < 0 else j
                value, i = body[i + 1 : j], j + 1
            else:
                j = body.find(",", i)
                j = len(body) if j < 0 else j
                value, i = body[i:j], j
            fields[f[1].lower()] = " ".join(re.sub(r"[{}]", "", value).split())
            while i < len(body) and body[i] in ", \t\r\n":
                i += 1
        year = fields.get("year", "")
        out.append(
            {
                "key": key.strip(), "kind": m[1].lower(), "title": fields.get("title", ""), "authors": [a for a in re.split(r"\s+and\s+", fields.get("author", "")) if a],
                "year": int(year) if year.isdigit() else None, "venue": fields.get("journal") or fields.get("booktitle") or "", "doi": fields.get("doi", ""), "url": fields.get("url", ""), "abstract": fields.get("abstract", ""),
            }
        )
    return out


BIBTEX = "array<struct<key:string,kind:string,title:string,authors:array<string>,year:int,venue:string,doi:string,url:string,abstract:string>>"


def bibtex(files: DataFrame, text_col: str = "value") -> DataFrame:
    """One row for each entry of the files, whose texts are in ``text_col``."""
    parse = F.udf(parse_bibtex, BIBTEX, useArrow=True)
    return files.select(F.inline(parse(F.col(text_col))))


def golden_cases(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    df = spark.read.schema("case_id string, target string, description string, input map<string,string>, expected map<string,string>, tags array<string>").option("multiLine", True).json(path)
    return df if target is None else df.where(F.col("target") == target)


def best_reading(candidates: list[Column], ok: list[Column], otherwise: Column) -> Column:
    """The first of several readings of a document that is fit for use."""
    return F.coalesce(*[F.when(good, c) for c, good in zip(candidates, ok, strict=True)], otherwise)


def in_reading_order(blocks: Column, width: Column, least_gap: float = 0.03) -> Column:
    """Texts of a page's blocks (x0, x1, top, text): full-width ones, then the left, then the right column, by the middle gap.

    Without a gap around the middle the order is from top to bottom.
    """
    mid = width / 2
    full = F.filter(blocks, lambda b: (b["x0"] < mid * 0.8) & (b["x1"] > mid * 1.2))
    left = F.filter(blocks, lambda b: (b["x1"] <= mid * 1.2) & (b["x0"] < mid * 0.8))
    right = F.filter(blocks, lambda b: b["x0"] >= mid * 0.8)
    edge = lambda a, f, key: F.aggregate(a, F.lit(None).cast("double"), lambda s, b: f(F.coalesce(s, b[key].cast("double")), b[key].cast("double")))
    gap = edge(right, F.least, "x0") - edge(left, F.greatest, "x1")
    down = lambda a: F.transform(F.array_sort(F.transform(a, lambda b: F.struct(b["top"].alias("top"), b["x0"].alias("x0"), b["text"].alias("text")))), lambda b: b["text"])
    return F.when(F.coalesce(gap > least_gap * width, F.lit(False)), F.concat(down(full), down(left), down(right))).otherwise(down(blocks))
