"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.lineage import cut


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    The folder is the session's ``spark.checkpoint.dir``.
    """
    return cut(df)


#: Rows of a few longs that are sent to all tasks at most; more are joined by a shuffle.
SENT = 250_000


def sent(few: DataFrame) -> DataFrame:
    """``few``, checkpointed, and marked for a broadcast if it is counted to have at most ``SENT`` rows."""
    few = checkpointed(few)
    return F.broadcast(few) if few.limit(SENT + 1).count() <= SENT else few


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a task turns to Python strings at a time.
LOT = 4 << 20


def lots(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Successive rows of a batch with about ``most`` bytes or items in ``column``, one row at least."""
    c = batch.column(column)
    n = pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)
    size = np.cumsum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which
    need a logarithmic number of rounds in practice. Every round is two
    aggregations with map-side combining and two joins, so a hub costs no more
    than its edges, and each result is checkpointed. Rows with a null end are
    ignored; an empty input gives an empty result.
    """
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = checkpointed(e)
    state = _state(e)
    while state[0]:
        # Large star: every larger neighbour of u is tied to the least node around u.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )


def _state(e: DataFrame) -> tuple:
    row = e.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 32) - 1))).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]
