"""Hard negatives by exact inner product, found through a pivot table.

With M the greatest norm, x becomes x' = (x, sqrt(M^2 - |x|^2)) and an anchor q
becomes q' = (q, 0): then |x' - q'|^2 = |q|^2 + M^2 - 2 <q, x>, so that the
greatest inner products are the least distances. The table stores the distances of
each x' from a few pivots. By the triangle inequality they bracket its distance from
q', and so its score; only rows whose bracket meets the wanted range are multiplied.

Rows are dealt to cells by their nearest pivot, and large cells to blocks. An
anchor first visits the one block with the greatest bound; the scores found there
narrow its ranges, and then it visits those blocks of cells that the ranges still
meet. Blocks and slices of anchors have a bounded size, so a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import checkpointed

#: Pivots at least and at most, one for so many rows in between, and rows of the sample that they are chosen from.
FEW, PIVOTS, ROWS, SAMPLE = 4, 64, 256, 1024
#: Rows of a block, and anchors of a slice, as a rule.
BLOCK, SLICE = 8192, 4096
#: Pivots that a row's bracket is taken from, besides its own.
_TRIED = 8
#: Scores beyond this are cut to it.
_MOST = 1 << 56
#: Part of the squares that rounding may take.
_SLACK = 1e-9
_FOUND = "rid long, j int, score long, vec_id long"


def quantised(vectors: DataFrame, scale: float = 256.0, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with x = floor(scale * component), without rows that lack the vector or hold null or non-finite components."""
    e = F.col(embedding).cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(embedding).isNotNull() & ~bad).withColumn("x", F.transform(e, lambda v: F.floor(v * scale).cast("double")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([*flat, np.zeros(0)]).reshape(-1, width) if width else np.zeros((len(column), 0))


def _pivots(points: np.ndarray, most: float, number: int) -> np.ndarray:
    """Up to ``number`` of the points, each the farthest from those before it."""
    norm = (points**2).sum(1)
    points = np.column_stack([points, np.sqrt(np.maximum(most - norm, 0))])
    chosen = [0]
    left = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < number and left.max() > 0:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


class _Space:
    """The pivots, and what each cell's rows have as least and greatest distance from each pivot."""

    def __init__(self, pivots: np.ndarray, most: float) -> None:
        self.pivots, self.most, self.width = pivots, most, pivots.shape[1] - 1
        self.rows = np.zeros(len(pivots), np.int64)
        self.low, self.high = np.full((2, len(pivots), len(pivots)), np.inf)

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distances of (x, last) from the pivots."""
        out = np.empty((len(x), len(self.pivots)))
        for k, p in enumerate(self.pivots):
            out[:, k] = ((x - p[:-1]) ** 2).sum(1) + (last - p[-1]) ** 2
        return np.sqrt(out)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x, np.sqrt(np.maximum(self.most - (x**2).sum(1), 0)))

    def blocks(self) -> np.ndarray:
        return -(-self.rows // BLOCK)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each cell's rows can have with each anchor."""
        d = self.distances(q, np.zeros(len(q)))
        near, far = np.zeros_like(d), np.full_like(d, np.inf)
        for c in np.flatnonzero(self.rows):
            near[:, c] = np.maximum(np.maximum(d - self.high[c], self.low[c] - d), 0).max(1)
            far[:, c] = (d + self.high[c]).min(1)
        size = (q**2).sum(1)[:, None] + self.most
        spare = _SLACK * (size + 1)
        return (size - far**2) / 2 - spare, np.where(self.rows > 0, (size - near**2) / 2 + spare, -np.inf)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products: in double precision where that is exact, else in Python's integers."""
    if not x.size or np.abs(x).max() * np.abs(q).max() * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    q = [int(v) for v in q]
    return np.array([max(-_MOST, min(_MOST, sum(a * b for a, b in zip(row, q, strict=True)))) for row in whole], np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties by smaller ids."""
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))


def _visit(space: _Space, same: bool, k: int):
    """What the anchors of a slice find in a block."""
    last = np.iinfo(np.int64).max

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["x"], space.width), _matrix(right["x"], space.width)
            cell = left["cell"][0].as_py()
            d = _matrix(left["d"], len(space.pivots))
            order = np.argsort(d[:, cell], kind="stable")
            x, d = x[order], d[order]
            own = np.ascontiguousarray(d[:, cell])
            ids = left["vec_id"].to_pandas().fillna(last).to_numpy(np.int64)[order] if left["vec_id"].null_count else left["vec_id"].to_numpy()[order]
            null = left["vec_id"].is_null().to_numpy()[order]
            rid = left["rid"].to_numpy()[order]
            both = pa.concat_arrays([*left["label"].chunks, *right["label"].chunks]).dictionary_encode().indices.to_numpy()
            label, asked = both[: len(x)][order], both[len(x) :]
            far = space.distances(q, np.zeros(len(q)))
            middle = d.mean(0)
            for i, (me, lo, hi) in enumerate(zip(right["rid"].to_pylist(), right["lo"].to_pylist(), right["hi"].to_pylist(), strict=True)):
                size = float((q[i] ** 2).sum()) + space.most
                spare = _SLACK * (size + 1)
                most = np.sqrt(max(0.0, size - 2.0 * min(lo) + spare))
                least = np.sqrt(max(0.0, size - 2.0 * max(hi) - spare))
                near = far[i]
                a, b = np.searchsorted(own, near[cell] - most - spare**0.5, "left"), np.searchsorted(own, near[cell] + most + spare**0.5, "right")
                a = max(a, np.searchsorted(own, least - near[cell] - spare**0.5, "left"))
                if a >= b:
                    continue
                held = (label[a:b] == asked[i]) if same else (label[a:b] != asked[i])
                tried = np.argsort(-np.abs(near - middle))[:_TRIED]
                stored = d[a:b, tried]
                held &= np.abs(stored - near[tried]).max(1) <= most + spare**0.5
                held &= (stored + near[tried]).min(1) >= least - spare**0.5
                rest = np.flatnonzero(held) + a
                rest = rest[rid[rest] != me]
                score = _scores(x[rest], q[i])
                for j, (low, high) in enumerate(zip(lo, hi, strict=True)):
                    within = np.flatnonzero((score >= low) & (score <= high))
                    for n in within[_best(score[within], ids[rest[within]], k)]:
                        r = rest[n]
                        out.append((me, j, int(score[n]), None if null[r] else int(ids[r])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rid", "j", "score", "vec_id"])

    return run


def _meets(space: _Space, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Whether a cell can hold what one of an anchor's ranges asks for, and the greatest score it can have."""
    least, most = space.bounds(_matrix(t["x"], space.width))
    out = np.zeros_like(most, bool)
    for i, (lo, hi) in enumerate(zip(t["lo"].to_pylist(), t["hi"].to_pylist(), strict=True)):
        for low, high in zip(lo, hi, strict=True):
            out[i] |= (low <= high) & (most[i] >= low) & (least[i] <= high)
    return out & (space.rows > 0), most


def _first(space: _Space):
    """Adds the cell with the greatest bound, -1 if none can hold anything for an anchor, and one of its blocks."""
    blocks = np.maximum(space.blocks(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            meets, most = _meets(space, t)
            first = np.where(meets.any(1), np.where(meets, most, -np.inf).argmax(1), -1)
            block = t["rid"].to_numpy() % blocks[first]
            yield from t.append_column("cell", pa.array(first.astype(np.int32))).append_column("block", pa.array(block.astype(np.int32))).to_batches()

    return run


def _others(space: _Space):
    """A row for each block that an anchor's ranges meet but the first."""
    blocks = space.blocks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                t = pa.Table.from_batches([whole.slice(start, 512)])
                i, c = np.nonzero(_meets(space, t)[0])
                n = blocks[c]
                i, c, block = np.repeat(i, n), np.repeat(c, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                new = (c != t["cell"].to_numpy()[i]) | (block != t["block"].to_numpy()[i])
                out = t.take(pa.array(i[new])).drop_columns(["cell", "block"])
                out = out.append_column("cell", pa.array(c[new].astype(np.int32))).append_column("block", pa.array(block[new].astype(np.int32)))
                yield from out.to_batches(max_chunksize=4096)

    return run


_ASKED = "rid long, label string, x array<double>, near int, lo array<long>, hi array<long>"


class PivotTable:
    """Rows (vec_id, label, x) with their distances from pivots, dealt to blocks; ``anchor`` marks the rows that ask.

    The pivots come from a sample of 1,024 rows (those with the least hashes); a
    table of them, at most 64 x 64 bounds, is all that the driver and every task hold.
    """

    def __init__(self, rows: DataFrame, anchor: Column) -> None:
        kept = rows.where("label is not null and x is not null").select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("x").cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor")
        )
        norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        n, width, most = kept.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(norm)).first()
        self.empty = n == 0
        if self.empty:
            self.rows = kept
            return
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x"))))
        sample = [r["x"] for r in kept.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()]
        space = _Space(_pivots(np.array(sample, float).reshape(len(sample), width), float(most), min(PIVOTS, max(FEW, n // ROWS))), float(most))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, 2048):
                    t = pa.Table.from_batches([b.slice(start, 2048)])
                    d = space.of_rows(_matrix(t["x"], width))
                    cell = pa.array(d.argmin(1).astype(np.int32))
                    dist = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.ravel())
                    yield from t.append_column("cell", cell).append_column("d", dist).to_batches()

        table = kept.mapInArrow(measured, "vec_id long, label string, x array<double>, anchor boolean, cell int, d array<double>")
        table = checkpointed(table.withColumn("rid", F.monotonically_increasing_id()))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = len(space.pivots)
            count, low, high = np.zeros(p, np.int64), np.full((p, p), np.inf), np.full((p, p), -np.inf)
            for b in batches:
                cell, d = b.column(0).to_numpy(), _matrix(pa.chunked_array([b.column(1)]), p)
                np.add.at(count, cell, 1)
                np.minimum.at(low, cell, d)
                np.maximum.at(high, cell, d)
            c = np.flatnonzero(count)
            cols = [np.repeat(c, p).astype(np.int32), np.tile(np.arange(p, dtype=np.int32), len(c)), np.repeat(count[c], p), low[c].ravel(), high[c].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["cell", "k", "n", "low", "high"])

        parts = table.select("cell", "d").mapInArrow(ranges, "cell int, k int, n long, low double, high double")
        for r in parts.groupBy("cell", "k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            space.rows[r["cell"]] = r["n"]
            space.low[r["cell"], r["k"]], space.high[r["cell"], r["k"]] = r["low"], r["high"]
        blocks = F.array(*map(F.lit, np.maximum(space.blocks(), 1).tolist()))
        self.space = space
        self.rows = table.withColumn("block", F.pmod(F.xxhash64("rid"), blocks[F.col("cell")]).cast("int"))
        self._slices()

    def _slices(self) -> None:
        """Anchors of one cell, and of neighbouring ones, get the same slice."""
        count = {r["cell"]: r["count"] for r in self.rows.where("anchor").groupBy("cell").count().collect()}
        sizes = np.array([count.get(c, 0) for c in range(len(self.space.pivots))])
        start = F.array(*map(F.lit, (np.cumsum(sizes) - sizes).tolist()))
        size = F.array(*map(F.lit, np.maximum(sizes, 1).tolist()))
        self.slice = F.floor((start[F.col("near")] + F.pmod(F.xxhash64("rid"), size[F.col("near")])) / SLICE).cast("int")

    def anchors(self) -> DataFrame:
        return self.rows.where("anchor").select("rid", "vec_id", "label", "x", F.col("cell").alias("near"))

    def _met(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        visits = visits.withColumn("slice", self.slice)
        pairs = visits.select("cell", "block", F.col("slice").alias("part")).distinct()
        rows = self.rows.select("rid", "vec_id", "label", "x", "cell", "block", "d").join(pairs, ["cell", "block"])
        met = rows.groupBy("cell", "block", "part").cogroup(visits.groupBy("cell", "block", "slice"))
        return met.applyInArrow(_visit(self.space, same, k), _FOUND)

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(rid, j, rank, score, vec_id): for every range (lo[j], hi[j]) of an anchor the k rows with the greatest scores in it.

        Only rows with the anchor's label, or only others; never the anchor itself. Ties by smaller vec_id, null ids last.
        """
        top = Window.partitionBy("rid", "j").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        ranked = lambda found: found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        visits = f"{_ASKED}, cell int, block int"
        asked = checkpointed(asked.select("rid", "label", "x", "near", "lo", "hi").mapInArrow(_first(self.space), visits))
        probed = checkpointed(ranked(self._met(asked.where("cell >= 0"), same, k)))
        found = probed.where(F.col("rank") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("had"))
        narrowed = asked.join(found, "rid", "left").withColumn("lo", F.transform("lo", lambda v, j: F.greatest(v, F.col("had")[j]))).select(*asked.columns)
        rest = self._met(narrowed.mapInArrow(_others(self.space), visits), same, k)
        return ranked(probed.drop("rank").union(rest))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id, label, x) that ``anchor`` marks.

    x holds whole numbers; a score is the integer inner product with the anchor, greater ones
    come first, ties by smaller vec_id. An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels are
    returned whose score is from ``low`` to ``high`` percent of the positive's.

    Rows with a null label or x take no part. A null vec_id is no anchor unless the column
    says so, and comes after all ids of its score. Repeated rows count each time, also
    as each other's positives, and a repeated anchor asks each time. Shorter vectors are filled up with zeros. Scores beyond
    2**56 are cut to it. Other columns are not read. An anchor with fewer rows gets what there is;
    without a positive or negative it has no row, and an empty table gives an empty result.
    """
    table = PivotTable(rows, anchor)
    if table.empty:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every = table.anchors().withColumn("lo", F.array(F.lit(-_MOST))).withColumn("hi", F.array(F.lit(_MOST)))
    found = checkpointed(table.best(every, True, positives))
    listed = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    part = lambda p, percent: p["score"].cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    ranges = (
        table.anchors().join(listed, "rid")
        .withColumn("lo", F.transform("p", lambda p: F.ceil(part(p, low)).cast("long"))).withColumn("hi", F.transform("p", lambda p: F.floor(part(p, high)).cast("long")))
    )
    wrong = table.best(ranges, False, negatives).select("rid", (F.col("j") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    right = found.select("rid", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = table.anchors().select("rid", F.col("vec_id").alias("anchor_id"))
    return wrong.join(right, ["rid", "place"]).join(ids, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
