"""Chunks of parsed pages: a scan of a document's lines that keeps sections apart, as a table function with state.

    SELECT * FROM section_chunks(TABLE(lines))

after ``register(spark)``, or :func:`scanned` for a table of pages. A document is a partition of the
function's input, sorted by page and line, and goes by as a stream of rows; no more than the text of the chunk at hand is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from weft.functions import rules
from weft.functions.layout import heading

#: Estimated tokens from which a chunk is closed, that one holds at most, and that one holds at most with the words repeated before it.
CLOSED, MOST, WITH_TAIL = 800, 900, 1000
#: Words repeated from the text before, and the fewest characters of a chunk.
TAIL, LEAST = 80, 30
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_CJK = re.compile("[一-鿿]")


def tokens(text: str) -> int:
    """Two CJK characters or four others to a token."""
    cjk = len(_CJK.findall(text))
    return cjk // 2 + (len(text) - cjk) // 4


def packed(units: list[str], most: int = MOST) -> Iterator[str]:
    """Units joined by spaces in order while they have at most ``most`` tokens; a longer one stays whole."""
    now = ""
    for u in units:
        longer = f"{now} {u}" if now else u
        if now and tokens(longer) > most:
            yield now
            now = u
        else:
            now = longer
    if now:
        yield now


class _Open:
    """The text at hand of one document."""

    def __init__(self) -> None:
        self.section, self.lines, self.cjk, self.other = "", [], 0, 0
        self.first = self.last = None
        self.index, self.at, self.tail = 0, 0, ""

    def add(self, line: str, page: int | None) -> None:
        if not self.lines:
            self.first = page if self.first is None else self.first
        cjk = len(_CJK.findall(line))
        self.lines.append(line + "\n")
        self.cjk += cjk
        self.other += len(line) + 1 - cjk
        self.last = page

    def full(self) -> bool:
        return self.cjk // 2 + self.other // 4 >= CLOSED

    def close(self, page: int | None) -> list[tuple]:
        """Chunks of the text at hand, which is empty then; the next one's pages begin with ``page``."""
        whole = "".join(self.lines)
        text = whole.strip()
        kind = self.section if self.section in rules.OWN_KIND else "body"
        out: list[tuple] = []
        if len(text) >= LEAST or (text and self.section in rules.SHORT_SECTIONS):
            if tokens(text) <= MOST:
                joined = f"{self.tail} {text}" if self.tail and kind == "body" else text
                texts = [joined if tokens(joined) <= WITH_TAIL else text]
            else:
                units = [p for p in map(str.strip, text.split("\n\n")) if p]
                texts = list(packed(units if len(units) > 1 else [s for s in map(str.strip, _SENTENCE.split(text)) if s]))
            start = self.at
            for t in texts:
                out.append((self.index + len(out), self.section, kind, t, tokens(t), start, start + len(t), self.first, self.last))
                start += len(t) + 1
            words = text.split()
            self.tail = " ".join(words[-TAIL:]) if len(words) > TAIL else text
            self.index += len(out)
            self.at += len(whole)
        self.lines, self.cjk, self.other, self.first = [], 0, 0, page
        return out


class SectionChunks:
    """Rows (doc, page, line_no, line, section) of a document in, its chunks out."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType().add("doc", lines.dataType["doc"].dataType).add("chunk_index", IntegerType())
        for name in ("section", "kind", "text"):
            schema = schema.add(name, StringType())
        schema = schema.add("tokens", IntegerType()).add("start_char", LongType()).add("end_char", LongType()).add("page_start", IntegerType()).add("page_end", IntegerType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("page", True, True), OrderingColumn("line_no")])

    def __init__(self) -> None:
        self.doc, self.open = None, _Open()

    def eval(self, row: Row) -> Iterator[tuple]:
        self.doc = row["doc"]
        if row["section"]:
            for c in self.open.close(row["page"]):
                yield (self.doc, *c)
            self.open.section = row["section"]
            return
        self.open.add(row["line"], row["page"])
        if self.open.full():
            for c in self.open.close(row["page"]):
                yield (self.doc, *c)

    def terminate(self) -> Iterator[tuple]:
        for c in self.open.close(None):
            yield (self.doc, *c)


def register(spark: SparkSession) -> None:
    """Make ``section_chunks`` known to SQL."""
    spark.udtf.register("section_chunks", F.udtf(SectionChunks))


def lines_of(pages: DataFrame, doc: str, page: str, text: str, headings: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc, page, line_no, line, section): the lines of each page, and the section that a heading opens."""
    each = pages.select(F.col(doc).alias("doc"), F.col(page).cast("int").alias("page"), F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")).alias("line_no", "line"))
    section: Column = heading(F.col("line"), headings)
    return each.withColumn("section", section)


def scanned(pages: DataFrame, doc: str, page: str, text: str, headings: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc, chunk_index, section, kind, text, tokens, start_char, end_char, page_start, page_end): the chunks of every document.

    Lines are read by page (nulls first) and place. A heading opens a section and closes the chunk before it; otherwise a chunk closes at ``CLOSED``
    estimated tokens. One of more than ``MOST`` is cut between paragraphs, or between sentences if it is one paragraph. A chunk of running text
    begins with the last ``TAIL`` words of the text before it where both have room. What has under ``LEAST`` characters goes, but for titles and abstracts.
    Pages run from where the chunk was opened to its last line.

    Null texts are empty pages; pages with a null doc are one document; pages of one number follow each other in
    no set order, so number them apart. Other columns are not read. An empty table gives an empty result.
    """
    return F.udtf(SectionChunks)(lines_of(pages, doc, page, text, headings).asTable())
