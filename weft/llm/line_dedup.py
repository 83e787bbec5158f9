"""Cross-site boilerplate lines by distinct-site spread; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import sent


def _key(line: Column) -> Column:
    """128 bits: a second hash with the first as its seed."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def spread_lines(
    docs: DataFrame,
    site_col: str = "source",
    text_col: str = "text",
    min_sites: int = 8,
    lg_k: int = 12,
    band: float = 0.1,
) -> DataFrame:
    """(key, n_sites): hashes of the lines that occur on at least ``min_sites`` distinct sites.

    Each line hash has a HyperLogLog sketch of its sites, merged map-side and
    after the shuffle. Estimates further than ``band`` (six standard errors at
    lg_k 12), plus one site, from ``min_sites`` decide at once; ``n_sites`` is then the
    rounded estimate. The lines between are counted exactly. A null site counts
    for nothing; lines of white space are never returned.
    """
    rows = docs.where(F.col(site_col).isNotNull()).select(
        F.col(site_col).cast("string").alias("site"), F.explode(_lines(text_col)).alias("line")
    )
    rows = rows.select("site", _trimmed(F.col("line")).alias("line")).where("line <> ''").select("site", _key(F.col("line")).alias("key"))
    sketched = rows.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    estimate = sketched.select("key", F.hll_sketch_estimate("sketch").alias("n"))
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    candidates = estimate.where(F.col("n") >= low)
    near = candidates.where(F.col("n") <= high)
    exact = rows.join(near.select("key"), "key", "left_semi").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_sites"))
    return candidates.where(F.col("n") > high).select("key", F.col("n").alias("n_sites")).union(exact.where(F.col("n_sites") >= min_sites))


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    site_col: str = "source",
    text_col: str = "text",
    min_sites: int = 8,
    keep_whole: bool = False,
    lg_k: int = 12,
) -> DataFrame:
    """``docs`` without the lines that :func:`spread_lines` finds, plus n_lines, n_spread and n_removed (long).

    ``text_col`` becomes the remaining lines joined by a newline. With ``keep_whole`` a document in which
    no line but white space would remain stays as it is: it is a copy as a whole, which is
    left to near-duplicate removal. No row is dropped. A null
    text stays null and counts 0 lines; an empty one has 1 line. Null ids and
    repeated rows are handled as any other; columns of the input called n_lines,
    n_spread or n_removed are replaced, all others kept.
    """
    spread = sent(spread_lines(docs, site_col, text_col, min_sites, lg_k).select("key"))
    text = F.xxhash64(text_col)
    mine = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.posexplode(_lines(text_col)).alias("at", "line"))
    mine = mine.select("_id", "_text", "at", _key(_trimmed(F.col("line"))).alias("key"))
    hit = mine.join(spread, "key", "left_semi").groupBy("_id", "_text").agg(F.collect_list("at").alias("_spread"))
    out = docs.drop("n_lines", "n_spread", "n_removed")
    out = out.join(hit, out[id_col].eqNullSafe(hit["_id"]) & (F.xxhash64(out[text_col]) == hit["_text"]), "left").drop("_id", "_text")
    # The lines are a column, split once; places are told apart by a hash set, so that a long document costs no more than its lines.
    out, lines = out.withColumn("_lines", _lines(text_col)), F.col("_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_spread"))
    own = F.transform(left, lambda i: F.get(lines, i))
    out = out.withColumn("_own", F.when(F.col("_spread").isNotNull(), own))
    stays = F.col("_own").isNull()
    if keep_whole:
        stays = stays | ~F.exists("_own", lambda x: _trimmed(x) != "")
    return out.select(
        *[c for c in docs.columns if c not in (text_col, "n_lines", "n_spread", "n_removed")],
        F.when(stays, F.col(text_col)).otherwise(F.array_join("_own", "\n")).alias(text_col),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("_own"), F.lit(0)).cast("long").alias("n_spread"),
        F.when(stays, 0).otherwise(F.size(lines) - F.size("_own")).cast("long").alias("n_removed"),
    )


#: The same in DuckDB's SQL, with exact counts of sites for all lines.
SQL = """
WITH l AS (
  SELECT doc_id, source, text, u.i AS i, u.x AS line, trim(u.x, ' ' || chr(9) || chr(13)) AS t
  FROM (SELECT doc_id, source, text, unnest(list_zip(range(len(string_split(coalesce(text, ''), chr(10)))), string_split(coalesce(text, ''), chr(10)))) AS z FROM documents) d,
       LATERAL (SELECT z[1] AS i, z[2] AS x) u),
spread AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {min_sites}),
marked AS (SELECT l.*, s.t IS NOT NULL AS gone FROM l LEFT JOIN spread s ON l.t = s.t),
per AS (
  SELECT doc_id, any_value(text) AS text, CASE WHEN any_value(text) IS NULL THEN 0 ELSE count(*) END AS n_lines,
    count(*) FILTER (gone) AS n_spread,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS own
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_spread, n_spread AS n_removed, sha256(CASE WHEN n_spread = 0 THEN text ELSE own END) AS kept_sha256
FROM per
"""
