"""Removal of word sequences that an earlier document holds, by seed and extension.

Seeds are winnowed anchors: of the ``gram``-word sequences of every window of
``length`` words the one with the least hash, so that equal windows have equal
seeds. The consecutive windows of a document with one seed are its context: the
words around the seed as far as they count for it.

1. Documents meet by their seeds. Where a seed's contexts are the same, extension
   in both directions reaches all of it, and all but the smallest document's go.
2. Where one seed has different contexts, the first document of each extends it by
   i words to the left and ``length - gram - i`` to the right, for every i; what
   agrees has the threshold's length and belongs to the smallest document.
3. Extended windows that overlap or touch are united to maximal repeats.

A document sends one row for each seed (about a fifth of its words), a context that a
task has met before is settled there, and only contexts that differ are
opened, so that neither a group of copies nor a frequent passage makes pairs.
All steps are exact but for 64-bit hashes of words and contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import checkpointed, lots

#: Words that a task handles at a time.
_LOT = 1 << 20
#: White space, and so the words, of every text.
SPACE = r"[\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROW = "a long, run long, doc_id long, tag long, at long, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sums:
    """Hashes of any stretch of a sequence of word hashes, from prefix sums of their products with powers."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.full(n + 1, _ODD)
        back = np.full(n + 1, _BACK)
        power[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(power)[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sum[end] - self.sum[start]) * self.back[start] + (end - start).astype(np.uint64))


def contexts(words: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, context, first window, windows) of runs of windows with one seed; ``doc`` numbers the words' documents.

    Neighbouring runs with the same seed and context, as a repeated word gives, are one.
    """
    m = len(words) - length + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = _Sums(words)
    at = np.arange(len(words) - gram + 1)
    grams = sums.of(at, at + gram)
    least, anchor = grams[:m].copy(), np.arange(m)
    for k in range(1, length - gram + 1):
        less = grams[k : k + m] < least
        np.copyto(least, grams[k : k + m], where=less)
        np.copyto(anchor, at[k : k + m], where=less)
    whole = doc[:m] == doc[length - 1 :]
    new = np.ones(m, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (doc[1:m] != doc[: m - 1])
    start = np.flatnonzero(new & whole)
    end = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole) + 1
    seed, run = _mix(least[start]), sums.of(start, end + length - 1)
    again = np.zeros(len(start), bool)
    again[1:] = (seed[1:] == seed[:-1]) & (run[1:] == run[:-1]) & (start[1:] == end[:-1]) & (doc[start[1:]] == doc[start[:-1]])
    last = np.append(~again[1:], True) if len(start) else again
    return seed[~again], run[~again], start[~again], end[last] - start[~again]


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Whether a row's document is larger than another's with the same keys."""
    order = np.lexsort((doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else doc
    out = np.zeros(len(order), bool)
    out[order] = doc[order] > first
    return out


def _rows(a: np.ndarray, run: np.ndarray, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows in the order of ``at`` within documents numbered by ``doc``. What this task knows to be later is united and has a negative n."""
    known = _later((run, a), ids[doc])
    new = np.ones(len(a), bool)
    new[1:] = ~known[1:] | ~known[:-1] | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(n, start) if len(start) else n
    gone, doc, at = known[start], doc[start], at[start]
    place = _mix(ids[doc].view(np.uint64) * _ODD + at.astype(np.uint64))
    a, run = np.where(gone, place, a[start]), np.where(gone, np.uint64(0), run[start])
    out = (a.view(np.int64), run.view(np.int64), ids[doc], tags[doc], at, np.where(gone, -total, total))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "run", "doc_id", "tag", "at", "n"])


def _flat(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    c = b.column(column)
    return c.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sides(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, sizes = _flat(b, 2)
    ids, tags = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return words.view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, ids, tags


def _least_stay(rows: DataFrame) -> DataFrame:
    """With ``later`` (a smaller document has the same context), ``several`` (contexts of the seed) for every row.

    Rows are dealt by seed and sorted once for both windows; a task that sent them has one for each context and place.
    """
    seed, same = Window.partitionBy("a"), Window.partitionBy("a", "run")
    out = rows.repartition("a").sortWithinPartitions("a", "run")
    out = out.withColumn("several", (F.min("run").over(seed) < F.max("run").over(seed)) & (F.min("doc_id").over(seed) < F.max("doc_id").over(seed)))
    return out.withColumn("later", (F.col("n") < 0) | (F.col("doc_id") > F.min("doc_id").over(same)))


def _span() -> Column:
    """First window and number of windows in one long."""
    return F.shiftleft("at", 32) + F.abs("n")


def spans(docs: DataFrame, length: int = 13, gram: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, text) of all rows, and (doc_id, tag, gone): packed starts and numbers of the windows that a smaller document holds.

    The tag is from the text's hash, negative for a null id. No key is null and both joins with the texts read the same columns, so that one exchange of the texts serves both.
    """
    if not 1 <= gram <= length:
        raise ValueError("a seed is no longer than a window")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id")
    hashed = F.shiftrightunsigned(F.xxhash64(text), 33)
    texts = docs.select(place, F.when(F.col("doc_id").cast("long").isNull(), -1 - hashed).otherwise(hashed).alias("tag"), text.alias("text"))
    words = F.transform(F.filter(F.split("text", SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words")

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in lots(whole, 2, _LOT)):
            flat, doc, base, ids, tags = _sides(b)
            seed, run, start, n = contexts(flat, doc, length, gram)
            doc = doc[start]
            yield _rows(seed, run, ids, tags, doc, start - base[doc], n)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in lots(whole, 2, _LOT)):
            flat, doc, base, ids, tags = _sides(b)
            asked, sizes = _flat(b, 3)
            first, n = np.repeat(base, sizes) + (asked >> 32), asked & 0xFFFFFFFF
            start = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
            window = _Sums(flat).of(start, start + length)
            new = np.ones(len(start), bool)
            new[1:] = (window[1:] != window[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]])
            many = np.diff(np.append(np.flatnonzero(new), len(start)))
            start, window = start[new], window[new]
            doc = doc[start]
            yield _rows(window, np.zeros(len(start), np.uint64), ids, tags, doc, start - base[doc], many)

    met = _least_stay(texts.where("tag >= 0").select("doc_id", "tag", words).mapInArrow(sow, _ROW)).where("later or several")
    met = met.groupBy("doc_id", "tag").agg(
        F.collect_list(F.when(F.col("later"), _span())).alias("gone"), F.collect_list(F.when(~F.col("later"), _span())).alias("asked")
    )
    met = checkpointed(met)
    asked = met.where(F.size("asked") > 0).select("doc_id", "tag", "asked").hint("shuffle_hash")
    opened = texts.join(asked, ["doc_id", "tag"]).select("doc_id", "tag", words, "asked").mapInArrow(extend, _ROW)
    opened = _least_stay(opened).where("later").groupBy("doc_id", "tag").agg(F.collect_list(_span()).alias("gone"))
    gone = met.where(F.size("gone") > 0).select("doc_id", "tag", "gone").union(opened)
    return texts, gone.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def deduplicated(docs: DataFrame, length: int = 13, gram: int = 5) -> DataFrame:
    """(doc_id, text, n_words, n_removed, repeats): every row of ``docs`` without words that a smaller doc_id holds.

    A word goes where a window of ``length`` consecutive words covers it whose
    sequence also starts in a document with a smaller doc_id. ``repeats`` has the
    maximal removed stretches (first_word, n_words); ``text`` the other words, joined by a space.
    Words are runs of characters other than space and U+0009 to U+000D, compared as they are.

    A null text is empty and a text without words gives an empty one. A null doc_id
    is neither smaller nor larger than any: such a row keeps all and removes
    nothing elsewhere. Rows of one doc_id are not smaller than each other, so repeated rows
    come out alike, each judged against smaller ids. (Different texts of one id are told
    apart by 31 bits of their hash.) Long texts go by in lots; a text
    is handled whole by one task. Other columns are not read. An empty table gives an empty result.
    """
    texts, gone = spans(docs, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "n_words", "n_removed", "repeats"]
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
        for b in (x for whole in batches for x in lots(whole, 1, 8 * _LOT)):
            rows = []
            for doc_id, text, at in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                words = text.encode().split()
                pieces: list[dict] = []
                if at:
                    x = np.array(at)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, x >> 32, 1)
                    np.add.at(step, (x >> 32) + (x & 0xFFFFFFFF) + length - 1, -1)
                    off = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], off.astype(np.int8), [0]))))
                    pieces = [{"first_word": int(i), "n_words": int(j - i)} for i, j in zip(edge[::2], edge[1::2], strict=True)]
                    words_kept = [w for w, o in zip(words, off.tolist(), strict=True) if not o]
                else:
                    words_kept = words
                rows.append((doc_id, b" ".join(words_kept).decode(), len(words), len(words) - len(words_kept), pieces))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = texts.join(gone.hint("shuffle_hash"), ["doc_id", "tag"], "left").select(F.when(F.col("tag") >= 0, F.col("doc_id")).alias("doc_id"), "text", "gone")
    return found.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long, repeats array<struct<first_word long, n_words long>>")
