"""Distributed difference-cover suffix sort (Kärkkäinen and Sanders, 2003) of a table of symbols: one row for each suffix.

Each level sorts the triples of the suffixes at 1 and 2 modulo 3 by range, names them, recurses on the names, and merges the others
by counting. A level deals some ten rows of about 40 bytes for each symbol, three levels' worth in all, which is the whole method
and is why :mod:`weft.llm.suffixes` brings together first what can be equal at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import checkpointed


def ordered(rows: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the order of the keys (longs, not null), ``name``, the number of different keys before, and ``flagged``, that of rows before with the flag.

    Sorted by range; each task counts, and only the tasks' totals go through the driver.
    """
    extra = [F.col(flag).cast("int").alias("_flag")] if flag else [F.lit(0).alias("_flag")]
    dealt = rows.select("*", *extra).repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = [*rows.columns, "_part", "place", "name", "flagged"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, named, flagged, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys], axis=1)
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]).any(axis=1)
            new[0] = last is None or (k[0] != last).any()
            f = b.column(b.schema.get_field_index("_flag")).to_numpy(zero_copy_only=False).astype(np.int64)
            name = named + np.cumsum(new)
            cols = [b.column(b.schema.get_field_index(c)) for c in rows_columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(k), part)), pa.array(n + np.arange(len(k))), pa.array(name - 1), pa.array(flagged + np.cumsum(f) - f)], names=names)
            n, named, flagged, last = n + len(k), int(name[-1]), flagged + int(f.sum()), k[-1]

    rows_columns = rows.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _part long, place long, name long, flagged long"
    out = checkpointed(dealt.mapInArrow(run, kinds))
    flags = F.sum(F.col(flag).cast("long")) if flag else F.lit(0).cast("long")
    totals = out.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("m"), flags.alias("f")).orderBy("_part").collect()
    before, at = {}, (0, 0, 0)
    for r in totals:
        before[r["_part"]] = at
        at = (at[0] + r["n"], at[1] + r["m"] + 1, at[2] + r["f"])
    if not before:
        return out.drop("_part")
    add = [F.element_at(F.create_map(*[x for p, v in before.items() for x in (F.lit(p).cast("long"), F.lit(v[k]).cast("long"))]), F.col("_part")) for k in range(3)]
    return out.select(*rows.columns, (F.col("place") + add[0]).alias("place"), (F.col("name") + add[1]).alias("name"), (F.col("flagged") + add[2]).alias("flagged"))


def suffix_ranks(t: DataFrame, depth: int) -> DataFrame:
    """(s, i, rank): the place of each suffix of the strings ``t`` (s long, i long from 0, c long over 0) by at least its first ``depth`` symbols; a string's end comes before any symbol."""
    w = Window.partitionBy("s").orderBy("i")
    after = lambda c, k: F.coalesce(F.lead(c, k).over(w), F.lit(0).cast("long"))
    t = checkpointed(t.select("s", "i", "c", after("c", 1).alias("c1"), after("c", 2).alias("c2")))
    sample = ordered(t.where("i % 3 > 0"), ["c", "c1", "c2"])
    n, names = sample.agg(F.count(F.lit(1)), F.coalesce(F.max("name") + 1, F.lit(0))).first()
    if names < n and depth > 3:
        sub = sample.select((2 * F.col("s") + F.col("i") % 3 - 1).alias("s"), F.floor(F.col("i") / 3).alias("i"), (F.col("name") + 1).alias("c"))
        r = suffix_ranks(sub, -(-depth // 3))
        kind = F.pmod("s", F.lit(2))
        r = r.select(F.floor((F.col("s") - kind) / 2).alias("s"), (3 * F.col("i") + kind + 1).alias("i"), F.col("rank").alias("r"))
    else:
        r = sample.select("s", "i", F.col("place").alias("r"))
    ranked = t.join(r, ["s", "i"], "left").withColumn("r", F.coalesce(F.col("r") + 1, F.lit(0).cast("long")))
    ranked = checkpointed(ranked.select("s", "i", "c", "c1", "r", after("r", 1).alias("r1"), after("r", 2).alias("r2"), (F.col("i") % 3 == 0).alias("zero")))
    ones = ordered(ranked.where("i % 3 <= 1").select("s", "i", "c", "r1", "r", "zero"), ["c", "r1"], "zero")
    twos = ordered(ranked.where("i % 3 <> 1").select("s", "i", "c", "c1", "r2", "r", "zero"), ["c", "c1", "r2"], "zero")
    first = ones.where("zero").select("s", "i", F.col("place").alias("p"))
    second = twos.where("zero").select("s", "i", (F.col("place") - F.col("flagged")).alias("q"))
    zeros = first.join(second, ["s", "i"]).select("s", "i", (F.col("p") + F.col("q")).alias("rank"))
    others = ones.union(twos.select("s", "i", "c", "r2", "r", "zero", "place", "name", "flagged")).where("not zero")
    return zeros.union(others.select("s", "i", (F.col("r") - 1 + F.col("flagged")).alias("rank")))


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc, at): starts of strings of ``length`` bytes that also start earlier, in a smaller id or further left in the same.

    Adjacent suffixes are compared by their first bytes. Ids are different and not null; null texts are empty.
    """
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    d = docs.select(F.col(id_col).cast("long").alias("s"), raw.alias("raw"))
    code = F.transform(F.sequence(F.lit(1), F.octet_length("raw")), lambda k: F.conv(F.hex(F.substring("raw", k, F.lit(1))), 16, 10).cast("long") + 1)
    t = d.where(F.octet_length("raw") > 0).select("s", F.posexplode(code).alias("i", "c")).withColumn("i", F.col("i").cast("long"))
    rank = suffix_ranks(t, length)
    place = ordered(rank, ["rank"]).select("s", "i", "place")  # ends of depth may share a rank
    long_enough = place.join(d, "s").where(F.col("i") + length <= F.octet_length("raw"))
    row = checkpointed(long_enough.select("s", "i", "place", F.substring("raw", (F.col("i") + 1).cast("int"), F.lit(length)).alias("x")))
    row = ordered(row.select("s", "i", "place", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(7), "x").alias("g")).withColumnRenamed("place", "old"), ["old"]).drop("name", "flagged")
    before = row.select((F.col("place") + 1).alias("place"), F.col("h").alias("bh"), F.col("g").alias("bg"))
    new = row.join(before, "place", "left").select("s", "i", "place", (~(F.col("h").eqNullSafe(F.col("bh")) & F.col("g").eqNullSafe(F.col("bg")))).alias("new"))
    named = ordered(new.withColumnRenamed("place", "old"), ["old"], "new")
    group = named.select("s", "i", (F.col("flagged") + F.col("new").cast("int")).alias("group"))
    first = group.groupBy("group").agg(F.min(F.struct("s", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return group.join(first, "group").where(F.struct("s", "i") != F.col("first")).select(F.col("s").alias("doc"), F.col("i").alias("at"))
