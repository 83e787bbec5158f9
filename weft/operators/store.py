"""Keyed tables: reading with filters, paging, merging, deleting, cascades."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(df: DataFrame, filters: Mapping[str, object]) -> Column:
    """All of the filters: a value is equality, a list membership (an empty one nothing), {"$contains": v} an array's or map's member.

    Operators that are not known are passed over.
    """
    out = F.lit(True)
    for name, want in filters.items():
        c = df[name]
        if isinstance(want, Mapping):
            if "$contains" in want:
                is_map = df.schema[name].dataType.typeName() == "map"
                out = out & (F.map_contains_key(c, F.lit(want["$contains"])) if is_map else F.array_contains(c, F.lit(want["$contains"])))
            elif "$eq" in want:
                out = out & (c == F.lit(want["$eq"]))
        elif isinstance(want, list | tuple | set):
            out = out & (c.isin(list(want)) if want else F.lit(False))
        else:
            out = out & (c == F.lit(want))
    return out


def get(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(df[key] == F.lit(value)).limit(1)


def select_where(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    return df.where(condition(df, filters))


def page(df: DataFrame, number: int, size: int, filters: Mapping[str, object], order_by: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with their total); pages count from 1 and hold 1 to 100 rows. Top-k without a full sort for early pages."""
    kept = select_where(df, filters)
    number, size = max(number, 1), min(max(size, 1), 100)
    return kept.orderBy(*order_by).offset((number - 1) * size).limit(size), kept.agg(F.count(F.lit(1)).alias("total"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key: columns that ``new`` has replace, others stay; unknown columns are dropped.

    One full join on the keys. ``new`` has one row a key.
    """
    known = [c for c in new.columns if c in old.columns]
    n = new.select(*[F.col(c).alias(f"_new_{c}") for c in known], F.lit(True).alias("_put"))
    on = None
    for k in keys:
        one = old[k] == n[f"_new_{k}"]
        on = one if on is None else on & one
    joined = old.join(n, on, "full")
    return joined.select(*[F.when(F.col("_put"), F.col(f"_new_{c}")).otherwise(old[c]).alias(c) if c in known else old[c] for c in old.columns])


def delete(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def cascade(tables: Mapping[str, tuple[DataFrame, str]], key: DataFrame, column: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without rows that refer to ``key``, (name, deleted)): each table comes with the column that refers."""
    kept, counts = {}, None
    for name, (df, ref) in tables.items():
        keys = key.select(F.col(column).alias(ref)).distinct()
        kept[name] = df.join(keys, ref, "left_anti")
        one = df.join(keys, ref, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("name"), "deleted")
        counts = one if counts is None else counts.union(one)
    return kept, counts


def keep_earliest(df: DataFrame, name: str, created: str) -> DataFrame:
    """Of rows with the same name those with the earliest time, all of ties. A name that is null is no name."""
    first = df.groupBy(name).agg(F.min(created).alias("_first"))
    return df.join(first, name, "left").where(F.col(name).isNull() | F.col(created).isNull() | (F.col(created) <= F.col("_first"))).select(*df.columns)


def evolved(df: DataFrame, add: Mapping[str, str], drop: list[str]) -> DataFrame:
    """Columns added with nulls, of the given types, and dropped."""
    for name, kind in add.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.drop(*drop)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
