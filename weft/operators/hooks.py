"""Where models can be plugged in, and what is done without one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

Writer = Callable[[pd.Series], pd.Series]
Embedder = Callable[[pd.Series], pd.Series]


def generated(prompt: Column, write: Writer | None, fallback: Column) -> Column:
    """A model's text for a prompt, batch by batch; the rule's own where there is no model or it says nothing."""
    if write is None:
        return fallback
    call = F.pandas_udf(write, StringType())
    return F.coalesce(F.nullif(call(prompt), F.lit("")), fallback)


def embedded(text: Column, embed: Embedder) -> Column:
    """Vectors of texts by a model that maps a batch of texts to a batch of lists."""
    return F.pandas_udf(embed, ArrayType(FloatType()))(text)


def refined(question: Column, write: Writer | None = None) -> Column:
    """A question rewritten by a model; short ones, and all without a model, stay."""
    short = F.size(F.split(F.trim(question), r"\s+")) <= 3
    return F.when(short, question).otherwise(generated(question, write, question))


def several(question: Column, write: Writer | None = None, most: int = 3) -> Column:
    """Other wordings of a question, a model's lines, at most ``most``; an empty array without a model or where it says nothing."""
    lines = F.split(generated(question, write, F.lit("")), "\n")
    return F.slice(F.filter(F.transform(lines, F.trim), lambda x: x != ""), 1, most)


def imagined(question: Column, write: Writer | None = None) -> Column:
    """A passage that would answer a question, to search by; empty without a model or where it says nothing."""
    return generated(question, write, F.lit(""))


def searched(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(records of all sources that can be read, error by source of the others). Sources are plans; a failure to make one does not stop the others."""
    found, errors = [], {}
    for name, read in sources.items():
        try:
            found.append(read())
        except Exception as e:  # one source must not stop the others
            errors[name] = str(e)
    return (reduce(DataFrame.unionByName, found) if found else None), errors


class Reader(Protocol):
    """What a way of reading documents has: a name, where it applies, what it gives, and whether that is fit for use."""

    name: str

    def can_read(self, document: Column) -> Column: ...

    def read(self, document: Column) -> Column: ...

    def fit(self, reading: Column) -> Column: ...


def read_by(document: Column, readers: list[Reader], otherwise: Column) -> Column:
    """(reader, text): of the readers in order the first that applies and whose reading is fit, else ``otherwise`` by no reader (null)."""
    out = F.struct(F.lit(None).cast("string").alias("reader"), otherwise.alias("text"))
    for r in reversed(readers):
        text = r.read(document)
        good = F.coalesce(r.can_read(document) & text.isNotNull() & r.fit(text), F.lit(False))
        out = F.when(good, F.struct(F.lit(r.name).alias("reader"), text.alias("text"))).otherwise(out)
    return out
