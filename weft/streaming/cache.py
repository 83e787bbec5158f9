"""A cache of answers over a stream of requests: what would be served from it, by age and recency, for each owner."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "whose string, event_id long, key string, hit boolean, age double, held int"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Cache(StatefulProcessor):
    """The entries of one owner: when each was stored and how recently it was used. At most ``capacity`` of them are read and written for a batch."""

    def __init__(self, seconds: float, capacity: int, renew: bool) -> None:
        self.us, self.capacity, self.renew = round(seconds * 1e6), capacity, renew

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "stored long, used long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        kept = OrderedDict((k, stored) for k, (stored, _) in sorted(before.items(), key=lambda x: x[1][1]))
        tick = max((used for _, used in before.values()), default=0)
        used = {k: u for k, (_, u) in before.items()}
        out = []
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for event_id, name, at in zip(batch["event_id"], batch["key"], batch["at"], strict=True):
            for k in [k for k, stored in kept.items() if at - stored > self.us]:
                del kept[k]
            hit = name in kept
            age = (at - kept[name]) / 1e6 if hit else None
            if not hit or self.renew:
                kept[name] = at
            kept.move_to_end(name)
            tick += 1
            used[name] = tick
            if len(kept) > self.capacity:
                kept.popitem(last=False)
            out.append((key[0], event_id, name, hit, age, len(kept)))
        yield pd.DataFrame(out, columns=["whose", "event_id", "key", "hit", "age", "held"])
        for k in before.keys() - kept.keys():
            self.entries.removeKey((k,))
        for k, stored in kept.items():
            if before.get(k) != (stored, used[k]):
                self.entries.updateValue((k,), (stored, used[k]))

    def close(self) -> None:
        pass


def served(requests: DataFrame, seconds: float = 3600, capacity: int = 256, renew: bool = False) -> DataFrame:
    """(owner, event_id, key, hit, age, held) for each request (owner, event_id, key, ts) of a stream.

    Every owner has a cache of ``capacity`` answers. A request whose key is held is a hit, with the ``age`` of the answer in seconds; any other stores
    its answer, and the one used least recently goes where there are too many. Answers older than ``seconds`` go; with ``renew`` a hit makes an answer new.
    ``held`` counts the answers after the request. Requests of a batch are taken by (ts, event_id); later batches come after earlier ones. Null owners are one owner, null keys one
    key (the empty one), requests without time are left out, a repeated request is one more use. An owner's state is its entries, so it doesn't grow with the stream.

    An owner's requests of one batch are sorted where its state is, so the stream's batches should be bounded (files for each trigger).
    """
    if capacity < 1:
        raise ValueError("a cache holds at least one answer")
    # The processor is called for each row of a null key alone, so the key is never null.
    whose = F.coalesce(F.col("owner").cast("long").cast("string"), F.lit(""))
    known = requests.where("ts is not null").select(
        whose.alias("whose"), F.col("event_id").cast("long").alias("event_id"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    out = known.groupBy("whose").transformWithStateInPandas(statefulProcessor=_Cache(seconds, capacity, renew), outputStructType=_OUT, outputMode="append", timeMode="None")
    return out.select(F.nullif("whose", F.lit("")).cast("long").alias("owner"), "event_id", "key", "hit", "age", "held")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state processors need; the session's own setting comes back after that."""
    own = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, own)


def run(stream: DataFrame, folder: str) -> DataFrame:
    """All rows of a stream that appends, after all that is there now.

    Each batch's rows are a table of their own under ``folder``, which all machines share, beside the stream's progress and
    state: one that is run again is written again, and a stream that is started again goes on where it was.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    with state_store(spark):
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").foreachBatch(put).trigger(availableNow=True).start()
        q.awaitTermination()
    if q.lastProgress is None and not _exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/epoch=*")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
