"""Measures of runs, reports and texts: summaries, coverage, gates, versions, layout of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import rules


def summaries(events: DataFrame, name: str, value: str) -> DataFrame:
    """(name, n, low, high, mean, total) of each measure; nulls count in n only."""
    v = F.col(value)
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 4).alias("mean"), F.round(F.sum(v), 2).alias("total"))


def repeated_lines(docs: DataFrame, group: str, id_col: str, text_col: str, most_chars: int = 50, least: int = 2) -> DataFrame:
    """(group, line, n): short lines that occur in ``least`` or more documents of a group, as headers and footers do. Nulls have no lines."""
    lines = docs.select(id_col, group, F.explode(F.split(text_col, "\n")).alias("line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & (F.length("line") < most_chars))
    return lines.groupBy(group, "line").agg(F.count_distinct(id_col).alias("n")).where(F.col("n") >= least)


def watermarked(docs: DataFrame, group: str, text_col: str, signs: list[str], most_chars: int = 19, least: int = 3) -> DataFrame:
    """(group, watermark): whether a line has one of the signs, or a short line is there ``least`` times."""
    lines = docs.select(group, F.explode(F.split(text_col, "\n")).alias("line")).withColumn("line", F.trim("line"))
    often = lines.groupBy(group, "line").agg(F.count(F.lit(1)).alias("n"))
    sign = F.lit(False)
    for s in signs:
        sign = sign | F.contains(F.lower("line"), F.lit(s))
    short = F.max(F.when(F.length("line").between(1, most_chars), F.col("n")).otherwise(0))
    return often.groupBy(group).agg((F.bool_or(sign) | (short >= least)).alias("watermark"))


def matched_fields(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, n): how many rows satisfy each field's condition; fields that none satisfies are left out."""
    hit = F.array_compact(F.array(*[F.when(c, name) for name, c in fields.items()]))
    return rows.select(F.explode(hit).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def explained(fields: dict[str, Column], separator: str = "; ") -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, name) for name, c in fields.items()])), separator)


def project_stats(docs: DataFrame, project: str, parsed: Column, kind: str) -> DataFrame:
    """(project, papers, parsed, kinds) of each project."""
    return docs.groupBy(project).agg(F.count(F.lit(1)).alias("papers"), F.count_if(parsed).alias("parsed"), F.count_distinct(kind).alias("kinds"))


def coverage(rows: DataFrame, by: str, cited: Column, least: float = 0.5) -> DataFrame:
    """(by, coverage, passed): the share of rows that are cited and whether it is ``least`` or more; a null condition is not cited."""
    share = F.avg(F.coalesce(cited, F.lit(False)).cast("double"))
    return rows.groupBy(by).agg(F.round(share, 6).alias("coverage"), (share >= least).alias("passed"))


def to_revise(rows: DataFrame, by: str, faulty: Column, above: float = 0.1) -> DataFrame:
    """(by, ratio, revise): the share of faulty rows and whether it is more than ``above``."""
    share = F.avg(F.coalesce(faulty, F.lit(False)).cast("double"))
    return rows.groupBy(by).agg(F.round(share, 6).alias("ratio"), (share > above).alias("revise"))


def described(rows: DataFrame, name: Column, kind: str, description: str, separator: str = "; ") -> DataFrame:
    """(name, kind, description): entities of one name and kind with all that is said of them, each thing once and in order."""
    return rows.groupBy(name.alias("name"), F.col(kind).alias("kind")).agg(F.array_join(F.array_sort(F.collect_set(description)), separator).alias("description"))


def rates(docs: DataFrame, shares: dict[str, Column]) -> DataFrame:
    """(name, score): the share of documents that satisfy each condition, in one pass; null conditions don't count."""
    return docs.agg(*[F.avg(c.cast("int")).alias(name) for name, c in shares.items()]).unpivot([], list(shares), "name", "score")


def quality_gates(evaluations: DataFrame, gates: list[tuple] | None = None) -> DataFrame:
    """(name, required, passed) of each gate (name, expected, operator, required); one without an evaluation (name, score) passes only if it isn't required."""
    g = evaluations.sparkSession.createDataFrame(gates or rules.GATES, "name string, expected double, operator string, required boolean")
    s, x = F.col("score"), F.col("expected")
    by = F.when(F.col("operator") == ">=", s >= x).when(F.col("operator") == "<=", s <= x).when(F.col("operator") == "==", s == x).when(F.col("operator") == ">", s > x).when(F.col("operator") == "<", s < x).otherwise(False)
    return g.join(evaluations, "name", "left").select("name", "required", F.when(s.isNull(), ~F.col("required")).otherwise(by).alias("passed"))


def next_versions(versions: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number): the number that the next version of each key gets."""
    return versions.groupBy(key).agg((F.max(number) + 1).alias(number))


def with_current(versions: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number, current): all versions, and one more of each key that is the current one."""
    return versions.select(key, number, F.lit(False).alias("current")).unionByName(next_versions(versions, key, number).withColumn("current", F.lit(True)))


def ascents(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, inversions): how often the value is greater than in the row before, of keys where it ever is."""
    before = rows.withColumn("_before", F.lag(value).over(Window.partitionBy(key).orderBy(order)))
    return before.where(F.col(value) > F.col("_before")).groupBy(key).agg(F.count(F.lit(1)).alias("inversions"))


def column_share(text: Column, width: int = 140, apart: int = 60) -> Column:
    """Share of neighbouring lines of which both are shorter than ``width`` and about as long, as in two columns; null for one line."""
    n = F.transform(F.split(text, "\n"), F.length)
    pairs = F.zip_with(F.slice(n, F.lit(1), F.size(n) - 1), F.slice(n, F.lit(2), F.size(n) - 1), lambda a, b: ((a < width) & (b < width) & (F.abs(a - b) < apart)).cast("int"))
    return F.try_divide(F.aggregate(pairs, F.lit(0), lambda s, x: s + x), F.size(pairs))


def scanned(docs: DataFrame, group: str, chars: str, few: int = 400, many: int = 5000) -> DataFrame:
    """(group, scanned): whether over a fifth of the pages have little text and under three tenths have much."""
    d = docs.groupBy(group).agg(F.avg((F.col(chars) < few).cast("double")).alias("_few"), F.avg((F.col(chars) > many).cast("double")).alias("_many"))
    return d.select(group, ((F.col("_few") > 0.2) & (F.col("_many") < 0.3)).alias("scanned"))


def in_section_order(rows: DataFrame, within: str, section: str, order: str, first: tuple[str, ...]) -> DataFrame:
    """With ``place``, from 1: sections in the stated order, others after them, rows of a section by ``order``."""
    places = F.create_map(*[F.lit(x) for k, s in enumerate(first) for x in (s, k)])
    w = Window.partitionBy(within).orderBy(F.coalesce(F.element_at(places, F.col(section)), F.lit(len(first))), order)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def graph_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, average_degree, types); no nodes have degree 0."""
    both = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node_type").alias("types")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    return both.select("nodes", "edges", F.round(F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes")), F.lit(0.0)), 6).alias("average_degree"), "types")


def schema_check(rows: DataFrame, kind: str, known: tuple[str, ...]) -> DataFrame:
    """(kind, valid, n): kinds that occur, whether they are known, and how often. A null kind is not valid."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).select(kind, F.coalesce(F.col(kind).isin(list(known)), F.lit(False)).alias("valid"), "n")
