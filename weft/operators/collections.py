"""Collections of embedded documents, as tables: their columns, putting documents in, remembering queries, and a store of named tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import store

#: Columns of a collection: a dense and a sparse vector, the text, and what is filtered by.
DOCUMENTS = "point_id string, project_id string, document_id string, text string, dense array<float>, sparse map<int,float>, metadata map<string,string>"
QUERIES = "point_id string, project_id string, query string, dense array<float>, asked_at timestamp"


def empty(spark: SparkSession, columns: str = DOCUMENTS) -> DataFrame:
    return spark.createDataFrame([], columns)


def put(collection: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The collection with the documents in it: those of one project and id replace what was there, the last of repeated ones by text.

    A point's id follows from project and document id, so that the same document is the same point in every run.
    Columns that a document lacks are null; null keys are keys of their own.
    """
    point = F.sha2(F.concat_ws("\x1f", F.coalesce("project_id", F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = documents.withColumn("point_id", F.left(point, F.lit(32)))
    have = [c for c in collection.columns if c in rows.columns]
    once = store.first_of(rows.select(*have), ["point_id"], [F.desc_nulls_last("text")])
    return store.upsert(collection, once, ["point_id"])


def remember(queries: DataFrame, asked: DataFrame) -> DataFrame:
    """The remembered queries and the new ones, each of which is a point of its own."""
    new = asked.withColumn("point_id", F.left(F.sha2(F.concat_ws("\x1f", "project_id", "query", F.col("asked_at").cast("string")), 256), F.lit(32)))
    return queries.unionByName(new, allowMissingColumns=True).select(*queries.columns)


class Tables:
    """Named tables in a shared folder: every change writes a new version and the last one counts, so that a reader never sees half of one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version: dict[str, str] = {}

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.version[name] = path
        return self.all(name)

    def all(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.version[name])

    def get(self, name: str, key: str, value: object) -> DataFrame:
        return store.get(self.all(name), key, value)

    def query(self, name: str, filters: Mapping[str, object]) -> DataFrame:
        return store.select_where(self.all(name), filters)

    def count(self, name: str, filters: Mapping[str, object] | None = None) -> int:
        return self.query(name, filters or {}).count()

    def put(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows put in by key; the first of a name make the table."""
        return self._write(name, store.upsert(self.all(name), rows, keys) if name in self.version else rows)

    def delete(self, name: str, keys: DataFrame, on: str) -> DataFrame:
        return self._write(name, store.delete(self.all(name), keys, on))
