"""Reports and metrics as text, JSON and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(title: Column, content: Column, sources: Column, footer: Column) -> Column:
    """A report: title, content, a list of sources and a footer."""
    listed = F.transform(sources, lambda s: F.concat(F.lit("- "), s))
    index = F.when(F.size(sources) > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(listed, "\n"))).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), content, index, F.lit("\n\n---\n"), footer, F.lit("\n"))


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON document for each row, without nulls."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
