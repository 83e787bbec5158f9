"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LOT, lots

WIDTH, EMBED, FILTERS, HIDDEN = 6, 4, 16, 12
#: Filters are pooled over chunks of two halves; each half is shared with the chunk beside it.
HALF = 96
#: Bytes whose windows are held at a time.
_STEP = 1 << 15
#: Labelled rows of each class that the network is fitted on, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 12_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Network:
    """Bytes -> embeddings -> convolution -> maximum over each chunk -> hidden layer -> mean and maximum over chunks -> logit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (257, EMBED)),
            "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "hidden": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
            "hidden0": np.zeros(HIDDEN),
            "out": r.normal(0, 0.2, 2 * HIDDEN),
            "out0": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _bytes(text: str) -> np.ndarray:
        """The text's bytes, filled up with the value 256 to a whole number of halves, two at least, and WIDTH - 1 beyond."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = max(2, -(-len(raw) // HALF)) * HALF + WIDTH - 1
        x = np.full(n, 256, np.int16)
        x[: len(raw)] = raw
        return x

    def _windows(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x].ravel()
        n = len(x) - WIDTH + 1
        return np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (e.itemsize * EMBED, e.itemsize))

    def _halves(self, x: np.ndarray) -> np.ndarray:
        """Greatest response of each filter in each half, a bounded number of positions at a time."""
        n, step, out = len(x) - WIDTH + 1, _STEP // HALF * HALF, []
        for i in range(0, n, step):
            y = self._windows(x[i : min(i + step, n) + WIDTH - 1]) @ self.p["filters"]
            out.append(y.reshape(-1, HALF, FILTERS).max(axis=1))
        return np.concatenate(out)

    def _pooled(self, halves: np.ndarray) -> np.ndarray:
        return np.maximum(halves[:-1], halves[1:])

    def logit(self, text: str | None) -> float:
        h = np.tanh(self._pooled(self._halves(self._bytes(text or ""))) @ self.p["hidden"] + self.p["hidden0"])
        return float(np.concatenate((h.mean(axis=0), h.max(axis=0))) @ self.p["out"] + self.p["out0"][0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))

    def _backward(self, text: str, label: int, weight: float, grad: dict[str, np.ndarray]) -> None:
        p, x = self.p, self._bytes(text)
        win = self._windows(x)
        y = (win @ p["filters"]).reshape(-1, HALF, FILTERS)
        arg = y.argmax(axis=1)
        halves = np.take_along_axis(y, arg[:, None], 1)[:, 0]
        right = halves[1:] > halves[:-1]
        m = np.maximum(halves[:-1], halves[1:])
        h = np.tanh(m @ p["hidden"] + p["hidden0"])
        top = h.argmax(axis=0)
        doc = np.concatenate((h.mean(axis=0), h[top, np.arange(HIDDEN)]))
        z = float(doc @ p["out"] + p["out0"][0])
        d = np.float32(weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label))
        grad["out"] += d * doc
        grad["out0"] += d
        dh = np.repeat(d * p["out"][None, :HIDDEN] / len(h), len(h), axis=0)
        dh[top, np.arange(HIDDEN)] += d * p["out"][HIDDEN:]
        da = dh * (1 - h * h)
        grad["hidden"] += m.T @ da
        grad["hidden0"] += da.sum(axis=0)
        dm = da @ p["hidden"].T
        dhalf = np.zeros_like(halves)
        dhalf[:-1] += np.where(right, 0, dm)
        dhalf[1:] += np.where(right, dm, 0)
        pos = (arg + HALF * np.arange(len(arg))[:, None]).ravel()
        g = dhalf.ravel()
        f = np.tile(np.arange(FILTERS), len(arg))
        gf = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
        np.add.at(gf, f, g[:, None] * win[pos])
        grad["filters"] += gf.T
        de = (g[:, None] * p["filters"].T[f]).reshape(-1, EMBED)
        np.add.at(grad["embed"], x[(pos[:, None] + np.arange(WIDTH)).ravel()], de)

    def fit(self, rows: list[tuple[str, int]], prior: float, epochs: int = 14, batch: int = 16, rate: float = 0.01, seed: int = 3) -> Network:
        """Adam on the log loss, classes weighted so that the label 1 has the share ``prior``."""
        if not rows:
            return self
        share = sum(y for _, y in rows) / len(rows)
        weight = {1: prior / max(share, 1e-6), 0: (1 - prior) / max(1 - share, 1e-6)}
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for i in range(0, len(rows), batch):
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                mine = order[i : i + batch]
                for j in mine:
                    self._backward(rows[j][0], rows[j][1], weight[rows[j][1]] / len(mine), grad)
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Network:
    """A network fitted on labelled rows that are not held out.

    The sample is bounded: of each label's rows the ``sample_rows`` with the least hash of
    their id are looked up, and those with at most ``sample_chars``
    characters are used, whole. Rows with a null id or another label than 0 or 1
    are passed over; of an id with several labels each counts. Without a usable row the
    network keeps its first weights.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    share = usable.agg(F.avg("quality")).first()[0]
    if share is None:
        return Network()
    chosen: dict[int, set[int]] = {}
    for label in (0, 1):
        rows = usable.where(F.col("quality") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
        for r in rows:
            chosen.setdefault(r["doc_id"], set()).add(label)
    texts = docs.where(F.col("doc_id").isin(list(chosen)) & (F.length("text") <= sample_chars)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = sorted({(r["doc_id"], r["text"]) for r in texts.collect()})
    return Network().fit([(t, y) for d, t in rows for y in sorted(chosen[d])], min(max(share, 0.02), 0.98))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double): the probability of label 1 for each row's whole text, empty and null ones too.

    One narrow pass; the network is a few thousand numbers. Only the id and the
    text are read; null ids and repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in lots(whole, 1, LOT)):
            scores = np.array([shared.value.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=[id_col, "score"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"`{id_col}` long, score double")


def keep(docs: DataFrame, network: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def scored(text):
        return text.map(shared.value.score)

    return docs.where(scored(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) >= threshold)
