"""Streams of task events: windows, states, increments and rate gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.store import first_of

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str, files: int = 1) -> DataFrame:
    """Events as files arrive in ``folder``, ``files`` at a time, by event time."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of event-time windows; with ``late``, a stream's state is dropped after that."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, every: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.window("ts", width, every)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def last_states(events: DataFrame) -> DataFrame:
    """(user_id, event_type, n): each task's last state and number of events; in a stream the running answer."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count(F.lit(1)).alias("n"))


def numbered_states(events: DataFrame) -> DataFrame:
    """(user_id, n, last, changes): a stateful operator that keeps a task's count, its last state and how often it changed.

    Rows of a batch are taken in order of time; the state of a task is three values.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, changes = state.get if state.exists else (0, "", 0)
        for kind in pd.concat(list(batches)).sort_values(["ts", "event_id"])["event_type"]:
            changes += kind != last and n > 0
            n, last = n + 1, kind
        state.update((n, last, changes))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last], "changes": [changes]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last string, changes long", "n long, last string, changes long", "update", GroupStateTimeout.NoTimeout)


def maintained(stream: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Mentions of nodes or edges kept up to date by a stream: of what ``build`` makes of each batch, what is new is added.

    Each batch writes a version of its own under ``folder``, which all machines share, and reads those before it, so that one that is run again
    writes the same rows again; no row is written twice. The stream's progress is kept there as well. Returns all rows after all that is there now.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        made = build(batch).distinct()
        if epoch:
            before = spark.read.schema(made.schema).parquet(*[f"{folder}/rows/version={k}" for k in range(epoch)])
            on = [made[c].eqNullSafe(before[c]) for c in made.columns]
            made = made.join(before, on, "left_anti")
        made.write.mode("overwrite").parquet(f"{folder}/rows/version={epoch}")

    q = stream.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("version")


def rate_gaps(events: DataFrame, least_seconds: float) -> DataFrame:
    """(user_id, calls, too_soon): how many calls came sooner than ``least_seconds`` after the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    return events.withColumn("gap", gap).groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("gap") < least_seconds * 1e6).alias("too_soon"))


def settled(stream: DataFrame, folder: str, keys: list[str] | None = None) -> DataFrame:
    """The rows of a streaming aggregate after all that is there now.

    Each batch's rows are written under ``folder``, which all machines share, beside the stream's progress, so nothing is
    gathered on the driver and a stream that is started again goes on. Without ``keys`` each batch gives the whole
    result and the last one counts; with them it gives the rows that changed and of each key the last one does.
    """
    spark = stream.sparkSession
    empty = spark.createDataFrame([], stream.schema)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    w = stream.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", f"{folder}/progress")
    q = w.foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None:
        return empty
    every = spark.read.parquet(f"{folder}/rows")
    if keys:
        return first_of(every, keys, [F.desc("epoch")]).select(*stream.columns)
    last = every.agg(F.max("epoch").alias("last"))
    return every.join(F.broadcast(last), F.col("epoch") == F.col("last")).select(*stream.columns)
