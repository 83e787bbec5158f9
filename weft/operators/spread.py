"""Joins of many rows to a key, dealt evenly whatever the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key of the left side are dealt to; the right side's are copied to each.
PARTS = 32


def spread_join(left: DataFrame, right: DataFrame, on: list[str], deal: str, parts: int = PARTS) -> DataFrame:
    """Inner join on the columns ``on``, by sorting, where few keys have many rows on both sides: rows of a key of ``left`` are dealt to ``parts`` by the hash of the column ``deal``."""
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(deal), F.lit(parts)).cast("int"))
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copied.hint("merge"), [*on, "_part"]).drop("_part")
