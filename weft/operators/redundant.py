"""Redundant chunks of a group, told by BM25 against each other where the group is: no pair of chunks is ever a row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERM = re.compile("[a-zA-Z0-9一-鿿]+")
#: Chunks that are decided at a time, and entries of a matrix of chunks and terms.
_ROWS, _ENTRIES = 512, 1 << 22


def kept(texts: list[list[str]], least: float, k1: float = 1.5, b: float = 0.75) -> np.ndarray:
    """Which of the texts (lists of terms) a pass in their order keeps: each goes if its similarity with an earlier kept one is ``least`` or more.

    The similarity is BM25 with each other, relative to each with itself, averaged both ways; texts without terms are similar to none.
    """
    out = np.ones(len(texts), bool)
    size = np.array([len(t) for t in texts], np.float64)
    some = np.flatnonzero(size)
    if len(some) < 2:
        return out
    places: dict[str, int] = {}
    code = np.array([places.setdefault(w, len(places)) for i in some for w in texts[i]], np.int64)
    size, n, v = size[some], len(some), len(places)
    key, tf = np.unique(code * n + np.repeat(np.arange(n), size.astype(np.int64)), return_counts=True)
    term, row = key // n, key % n
    df = np.bincount(term, minlength=v)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    s = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / size.mean()))
    own = np.bincount(row, s * tf, minlength=n)
    left = np.zeros(n, bool)
    step = max(1, _ENTRIES // n)
    for i in range(0, n, _ROWS):
        j = min(i + _ROWS, n)
        there = np.append(np.flatnonzero(left[:i]), np.arange(i, j))  # the kept ones before and these
        place = np.full(n, -1)
        place[there] = np.arange(len(there))
        low = len(there) - (j - i)
        said, asked = np.zeros((j - i, len(there))), np.zeros((j - i, len(there)))
        for t in range(0, v, step):
            at = slice(*np.searchsorted(term, [t, t + step]))
            mine = place[row[at]] >= 0
            x, y = np.zeros((2, len(there), min(step, v - t)))
            x[place[row[at]][mine], term[at][mine] - t], y[place[row[at]][mine], term[at][mine] - t] = s[at][mine], tf[at][mine]
            said += y[low:] @ x.T
            asked += x[low:] @ y.T
        close = (said / own[i:j, None] + asked / own[there]) / 2 >= least
        alive = np.append(np.ones(low, bool), np.zeros(j - i, bool))
        for k in range(j - i):
            alive[low + k] = not (close[k, : low + k] & alive[: low + k]).any()
        left[i:j] = alive[low:]
    out[some] = left
    return out


def _passed(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, texts, found, kind = None, [], [], [], None

        def decide() -> None:
            if len(ids) == 1:
                found.append(ids[0])
            elif ids:
                found.extend(x for x, k in zip(ids, kept(texts, least), strict=True) if k)

        for b in batches:
            kind = b.schema.field(1).type
            for g, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g is None or i is None:
                    found.append(i)
                    continue
                if g != group:
                    decide()
                    group, ids, texts = g, [], []
                words = _TERM.findall(t)
                if ids and ids[-1] == i:
                    texts[-1] += words
                else:
                    ids.append(i)
                    texts.append(words)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, kind)], names=["id"])
                found.clear()
        decide()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, kind)], names=["id"])

    return run


def without_redundant(chunks: DataFrame, group: str, id_col: str, text_col: str, least: float) -> DataFrame:
    """(id,): chunks that a pass in the order of their ids keeps within each group, as :func:`kept`. Rows of one id in a group are one chunk; those with a null group or id stay."""
    c = chunks.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return c.repartition("g").sortWithinPartitions("g", "id").mapInArrow(_passed(least), f"id {dict(c.dtypes)['id']}")
