"""Aggregates kept as mergeable sketches: coarser groups, other periods and overlaps are had from them without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three standard errors of a distinct count (1.04 / sqrt(4096) for the sketches of 2^12 registers) and of its theta form (1 / sqrt(4096)).
DISTINCT_ERROR, THETA_ERROR = 3 * 1.04 / 64, 3 / 64
#: What ranks of the quantile sketch, at its k of 200, may be off by (99 %).
RANK_ERROR = 0.0133
_PARTS = ("n", "distinct", "members", "amounts")


def sketched(rows: DataFrame, by: list[str], distinct: Column, amount: Column) -> DataFrame:
    """(by..., n, distinct, members, amounts): for each group its rows, HyperLogLog and theta sketches of ``distinct``, and a KLL sketch of ``amount``.

    A sketch takes a few KB whatever the group's size, and is built before the shuffle, so a hot group costs no more than another one. Nulls are
    in no sketch but count in n; null groups are groups. Columns of the four names are no groups. An empty table has no groups.
    """
    if set(by) & set(_PARTS):
        raise ValueError(f"groups can't be called {', '.join(_PARTS)}")
    of = rows.select(*by, distinct.cast("string").alias("_d"), amount.cast("double").alias("_a"))
    return of.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_d", F.lit(12)).alias("distinct"), F.theta_sketch_agg("_d", 12).alias("members"), F.kll_sketch_agg_double("_a").alias("amounts")
    )


def rolled_up(kept: DataFrame, by: list[str]) -> DataFrame:
    """Kept sketches merged to the coarser groups ``by``; one row for all with none."""
    return kept.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.theta_union_agg("members", 12).alias("members"), F.kll_merge_agg_double("amounts").alias("amounts")
    )


def rolled_up_all(kept: DataFrame, levels: list[list[str]]) -> DataFrame:
    """(level, every group column, ...) of several roll-ups; columns that a level lacks are null, ``level`` names those it has."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    out = None
    for level in levels:
        one = rolled_up(kept, level)
        at = [F.col(c) if c in level else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in names]
        one = one.select(F.lit(",".join(level)).alias("level"), *at, *_PARTS)
        out = one if out is None else out.unionByName(one)
    return out


def estimated(kept: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Sketches read: ``distinct`` becomes a count, ``amounts`` an array with a value for each quantile (null where a group has no amount); ``members`` goes."""
    some = F.kll_sketch_get_n_double("amounts") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_double("amounts", F.lit(q))) for q in quantiles]
    return kept.withColumns({"distinct": F.hll_sketch_estimate("distinct"), "amounts": F.array(*at)}).drop("members")


def overlaps(kept: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """(a, b, both, either, only_a): for each of the stated pairs (a, b) of groups how many members they share, have together, and only a has.

    ``kept`` has one row a group (see :func:`rolled_up`). Pairs with an unknown or null group are left out.
    """
    side = lambda c: kept.select(F.col(group).alias(c), F.col("members").alias(f"_{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    size = F.theta_sketch_estimate
    return both.select("a", "b", size(F.theta_intersection("_a", "_b")).alias("both"), size(F.theta_union("_a", "_b", 12)).alias("either"), size(F.theta_difference("_a", "_b")).alias("only_a"))
