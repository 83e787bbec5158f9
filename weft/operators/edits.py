"""Edit distances of many names to many, by bits (Myers, 1999; Hyyrö, 2003): a column of the table is two words, and names with a common beginning share its columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.spread import PARTS, spread_join

#: Longest pattern, a bit each, and how many pairs are looked at together.
_BITS, _PAIRS = 64, 1 << 18


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each name, filled up with 0, lengths)."""
    n = np.array([len(x) for x in names], np.int64)
    out = np.zeros((len(names), int(n.max(initial=0))), np.uint32)
    for i, x in enumerate(names):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    return out, n


class Texts:
    """Names as the different beginnings they have, by length: from which one each comes, and by which letter."""

    def __init__(self, names: list[str]) -> None:
        codes, n = _codes(names)
        self.letters = np.unique(codes)
        order = np.lexsort(codes.T[::-1]) if codes.shape[1] else np.arange(len(names))
        self.order, self.n, codes = order, n[order], codes[order]
        fresh = np.zeros(len(names), bool)
        fresh[:1] = True
        node = np.zeros(len(names), np.int64)
        self.steps, self.ends = [], [(np.flatnonzero(self.n == 0), node[self.n == 0])]
        for t in range(codes.shape[1]):
            fresh[1:] |= codes[1:, t] != codes[:-1, t]
            first = np.flatnonzero(fresh)
            self.steps.append((node[first], np.searchsorted(self.letters, codes[first, t])))
            node = np.cumsum(fresh) - 1
            done = np.flatnonzero(self.n == t + 1)
            self.ends.append((done, node[done]))

    def distances(self, patterns: list[str]) -> np.ndarray:
        """(patterns, texts): edits between them; patterns have 64 letters at most."""
        codes, m = _codes(patterns)
        mask = np.zeros((len(patterns), len(self.letters)), np.uint64)
        for j in range(codes.shape[1]):
            at = np.minimum(np.searchsorted(self.letters, codes[:, j]), len(self.letters) - 1)
            hit = np.flatnonzero((j < m) & (self.letters[at] == codes[:, j]))
            mask[hit, at[hit]] |= np.uint64(1 << j)
        one, last = np.uint64(1), np.maximum(m - 1, 0).astype(np.uint64)[:, None]
        some = (m > 0).astype(np.int32)[:, None]
        plus, minus, score = np.full((len(patterns), 1), ~np.uint64(0)), np.zeros((len(patterns), 1), np.uint64), m.astype(np.int32)[:, None]
        out = np.empty((len(patterns), len(self.n)), np.int32)
        for t, (done, node) in enumerate(self.ends):
            if t:
                parent, letter = self.steps[t - 1]
                vp, vn, eq = plus[:, parent], minus[:, parent], mask[:, letter]
                xh = (((eq & vp) + vp) ^ vp) | eq
                hp, hn = vn | ~(xh | vp), vp & xh
                up, down = ((hp >> last) & one).astype(np.int32), ((hn >> last) & one).astype(np.int32)
                score = score[:, parent] + np.where(some, up - down, 1)
                hp, hn, xv = (hp << one) | one, hn << one, eq | vn
                plus, minus = hn | ~(xv | hp), hp & xv
            if len(done):
                out[:, self.order[done]] = score[:, node]
        return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))
    side = t["left"].to_numpy(zero_copy_only=False)
    at, to = np.flatnonzero(side), np.flatnonzero(~side)
    if len(at) and len(to):
        ids, names = t["id"].combine_chunks(), t["name"].combine_chunks()
        texts, b = Texts(names.take(pa.array(to)).to_pylist()), ids.take(pa.array(to))
        step = max(1, _PAIRS // len(to))
        for i in range(0, len(at), step):
            mine = at[i : i + step]
            d = texts.distances(names.take(pa.array(mine)).to_pylist())
            a = ids.take(pa.array(np.repeat(mine, len(to))))
            yield pa.RecordBatch.from_arrays([a, pa.concat_arrays([b] * len(mine)), pa.array(d.ravel())], names=["a", "b", "distance"])


def distances(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, distance): edits between the names of each pair of rows (key, id, name) of ``left`` and ``right`` with the same key, in code points; of a null name null.

    Rows of a key of ``left`` are dealt to tasks by their ids, and the right side's are held beside them. Ids of both sides have one type. Null keys are equal to none.
    """
    kind = dict(left.dtypes)["id"]
    short = F.coalesce(F.length("name") <= _BITS, F.lit(False))
    l1, l2 = left.where("key is not null").where(short), left.where(~short)
    r1, r2 = right.where("key is not null and name is not null"), right.where("name is null")
    both = l1.select("key", "id", "name", F.lit(True).alias("left"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("_part"))
    both = both.union(r1.select("key", "id", "name", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")))
    func: Callable = _compared
    fast = both.groupBy("key", "_part").applyInArrow(func, f"a {kind}, b {kind}, distance int")

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = spread_join(x.withColumnRenamed("id", "a"), y.withColumnsRenamed({"id": "b", "name": "_name"}), ["key"], "a")
        return pairs.select("a", "b", F.levenshtein("name", "_name").alias("distance"))

    return fast.union(joined(l2, right)).union(joined(l1, r2))
