"""A data source for spark.read.format("weft_records"): adapters by name over replayed files."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.sources.readers import RESULT


def _lines(path: str) -> io.BufferedReader:
    """A file by path, or by the address of a store that Arrow can open."""
    store, name = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    return io.BufferedReader(store.open_input_stream(name))


class _File(InputPartition):
    def __init__(self, path: str):
        self.value = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.source = options.get("source", "file")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        with _lines(partition.value) as f:
            for line in f:
                x = json.loads(line)
                yield (
                    self.source, x.get("id"), x.get("title"), x.get("authors") or [], x.get("year"), x.get("venue"), x.get("abstract"), x.get("doi"), x.get("arxiv_id"), x.get("url"),
                    x.get("pdf_url"), x.get("citations"),
                )


class RecordSource(DataSource):
    """Options: path (files of JSON lines, or addresses of them, that every executor can open, separated by commas), source."""

    @classmethod
    def name(cls) -> str:
        return "weft_records"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
