"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder on one machine and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="weft-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the :func:`shared_folder`."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """A folder of tables in the :func:`shared_folder`, for iterative plans that end with a result of their own.

    Unlike a checkpoint a table brings nothing of the plan that made it along, which the optimizer would work through again in every round.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        """``df``, written and to be read from its table."""
        path, self.tables = f"{self.folder}/{self.tables}", self.tables + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` from a checkpoint; the tables are deleted."""
        out = cut(df)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return out
