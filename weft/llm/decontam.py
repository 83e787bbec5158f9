"""Benchmark decontamination by spaced-seed hashing (Ma, Tromp and Li, 2002, on words)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LOT, lots

_WORD = re.compile(r"[^\W_]+")
#: Hits, and pairs of words, that are looked at together.
_HITS, _CELLS = 1 << 20, 1 << 18
RESULT = "doc_id long, item_id long, first_word long, n_words int, n_equal int"
#: A benchmark with more text than this is matched in several passes, each over a part no larger.
BLOCK_BYTES = 16 << 20


@lru_cache(maxsize=8)
def spaced_seeds(window: int = 13, errors: int = 2, weight: int = 6) -> tuple[tuple[int, ...], ...]:
    """Masks (offsets that must agree) one of which hits every ``window`` with ``errors`` substitutions.

    Greedy cover of all choices of wrong positions, spans in increasing order,
    so that the masks follow from the three parameters.
    """
    left = set(combinations(range(window), errors))
    found = []
    shapes = [(0, *c, s) for s in range(weight - 1, window) for c in combinations(range(1, s), weight - 2)]

    def covers(shape: tuple[int, ...]) -> set:
        moved = [{o + k for o in shape} for k in range(window - shape[-1])]
        return {e for e in left if any(m.isdisjoint(e) for m in moved)}

    while left:
        best = max(shapes, key=lambda s: (len(covers(s)), -s[-1]))
        left -= covers(best)
        found.append(best)
    return tuple(found)


def _allowed(n: int, similarity: float) -> int:
    """Substitutions in ``n`` words of which a share ``similarity`` is equal."""
    return int(n * (1 - similarity) + 1e-9)


def missed_length(seeds: tuple[tuple[int, ...], ...], least: int = 13, similarity: float = 0.8) -> int:
    """The first length, of ``least`` or more, at which no seed hits some stretch with a share ``similarity`` equal; 0 if there is none.

    Exact: for every choice of the last words that are wrong, the fewest errors with which a
    stretch of each length goes unhit. Beyond the last length tried, ``least`` words in a row
    with no more errors than are allowed in these are certain, by counting.
    """
    span = max(s[-1] for s in seeds)
    state, every = np.arange(1 << span), (1 << span) - 1
    masks = [sum(1 << (s[-1] - o) for o in s) for s in seeds]
    few = np.full(1 << span, 1 << 30)
    few[every] = 0
    worst = _allowed(least, similarity) + 1
    last = int((1 - similarity) * (least - 1) / (worst - (1 - similarity) * least) + 1e-6) * least + least - 1
    for n in range(1, last + 1):
        new = np.full(1 << span, 1 << 30)
        for wrong in (0, 1):
            w = state << 1 | wrong
            unhit = np.logical_and.reduce([w & m != 0 for m in masks])
            np.minimum.at(new, w[unhit] & every, few[unhit] + wrong)
        few = new
        if n >= least and few.min() <= _allowed(n, similarity):
            return n
    return 0


@lru_cache(maxsize=8)
def overlap_seeds(least: int = 13, similarity: float = 0.8, weight: int = 6) -> tuple[tuple[int, ...], ...]:
    """Masks one of which hits every stretch of ``least`` or more words of which a share ``similarity`` is equal.

    ``least`` words allow fewer errors than the longer stretches do, so these are covered as well:
    greedily, as in :func:`spaced_seeds`, with lengths added until none is missed.
    """
    shapes = [(0, *c, s) for s in range(weight - 1, least + 2) for c in combinations(range(1, s), weight - 2)]
    sizes, found = {least}, ()
    while not found or missed_length(found, least, similarity):
        if found:
            sizes.add(missed_length(found, least, similarity))
        wrong = {n: np.array([sum(1 << i for i in c) for c in combinations(range(n), _allowed(n, similarity))]) for n in sorted(sizes)}
        hits = {s: [np.logical_or.reduce([x & sum(1 << o + k for o in s) == 0 for k in range(n - s[-1])] or [x < 0]) for n, x in wrong.items()] for s in shapes}
        left, found = [np.ones(len(x), bool) for x in wrong.values()], ()
        while any(x.any() for x in left):
            gain, best = max(((sum((h & x).mean() for h, x in zip(hits[s], left, strict=True)), -s[-1]), s) for s in shapes)
            if not gain[0]:
                raise ValueError(f"no {weight} words are equal in every overlap of {least}")
            left = [x & ~h for h, x in zip(hits[best], left, strict=True)]
            found += (best,)
    return found


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall((text or "").lower())


class SeedIndex:
    """Hashes of the test items under every mask, and the items' words to verify hits with."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int = 13, similarity: float = 0.8, weight: int = 6):
        self.min_words, self.similarity = min_words, similarity
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.int64)))
        rng = np.random.default_rng(20)
        self.factor = rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
        short = sorted({len(t) for _, t in self.items if len(t) < min_words})
        seeds = overlap_seeds(min_words, similarity, weight)
        self.masks = [*seeds, *(tuple(range(n)) for n in short)]
        self.tables = []
        for mask in self.masks:
            whole = len(mask) if mask == tuple(range(len(mask))) and len(mask) in short else 0
            h, who, at = [], [], []
            for k, (_, t) in enumerate(self.items):
                if (len(t) == whole) if whole else len(t) >= min_words:
                    x = self._hash(t, mask)
                    h.append(x)
                    who.append(np.full(len(x), k, np.int64))
                    at.append(np.arange(len(x)))
            h, who, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, who, at))
            h = h.astype(np.uint64)
            before = np.where(at > 0, np.roll(h, 1), np.uint64(0))  # the item's hash one word earlier
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((h[order], who[order], at[order], before[order], bits))

    def _hash(self, ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        n = len(ids) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = np.zeros(n, np.uint64)
        known = np.ones(n, bool)
        u = ids.view(np.uint64)
        for k, o in enumerate(mask):
            x += u[o : o + n] * self.factor[k % 64]
            known &= ids[o : o + n] > 0
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x[~known] = 0
        return x

    def _diagonals(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """For each item hit, the shifts between its words and the text's at which a seed hits, ascending.

        Hits that follow another one on their diagonal add nothing and are passed over, a bounded number at a time. An item with more hits than
        the text and itself have diagonals several times over is hit on all of them.
        """
        found: dict[int, list[np.ndarray]] = {}
        sought = []
        for mask, (table, who, at, before, bits) in zip(self.masks, self.tables, strict=True):
            h = self._hash(ids, mask)
            pos = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)] & (h != 0)) if len(table) else np.zeros(0, np.int64)
            sought.append((table, who, at, before, h, pos))
        every: dict[int, np.ndarray] = {}
        if sum(int((np.searchsorted(t, h[pos], "right") - np.searchsorted(t, h[pos], "left")).sum()) for t, _, _, _, h, pos in sought) > _HITS:
            hits = np.zeros(len(self.items))
            for table, who, _, _, h, pos in sought:
                mine = np.sort(h[pos])
                hits += np.bincount(who, np.searchsorted(mine, table, "right") - np.searchsorted(mine, table, "left"), len(self.items))
            for k in np.flatnonzero(hits > [4 * (len(ids) + len(t)) for _, t in self.items]).tolist():
                every[k] = np.arange(1 - len(self.items[k][1]), len(ids))
            if every:
                dense = np.isin(np.arange(len(self.items)), list(every))
                sought = [(t[keep], who[keep], at[keep], before[keep], h, pos) for t, who, at, before, h, pos in sought for keep in [~dense[who]]]
        for table, who, at, before, h, pos in sought:
            lo, hi = np.searchsorted(table, h[pos], "left"), np.searchsorted(table, h[pos], "right")
            pos, lo, n = pos[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            first = 0
            while first < len(pos):
                last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _HITS, "right")), first + 1)
                p, count = np.repeat(pos[first:last], n[first:last]), n[first:last]
                entry = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[first:last], count)
                new = (p == 0) | (before[entry] == 0) | (h[np.maximum(p - 1, 0)] != before[entry])
                k, shift = who[entry[new]], p[new] - at[entry[new]]
                for item in np.unique(k).tolist():
                    found.setdefault(item, []).append(np.unique(shift[k == item]))
                first = last
        return every | {k: np.unique(np.concatenate(x)) for k, x in found.items()}

    def _longest(self, ids: np.ndarray, item: np.ndarray, shifts: np.ndarray, any_: bool) -> tuple[int, int, int] | None:
        """(first word, words, equal words) of the longest overlap on these diagonals, or of one if any will do.

        Diagonals with more words in common come first. Of each batch only those are looked at closely on which, by
        running sums, a stretch as long as the best one so far can have the share that must be equal.
        """
        size, n = len(item), len(ids)
        whole = size >= self.min_words
        need = self.min_words if whole else size
        common = np.minimum(size + np.minimum(shifts, 0), n - np.maximum(shifts, 0))
        order = np.lexsort((shifts, -common))
        shifts, common = shifts[order], common[order]
        around = np.concatenate((np.zeros(size, np.int32), ids.astype(np.int32), np.zeros(size, np.int32)))
        views = np.lib.stride_tricks.sliding_window_view(around, size)
        share = Fraction(self.similarity).limit_denominator(1000)
        kind = np.int32 if size * share.denominator < 1 << 31 else np.int64
        loss = (-share.numerator * np.arange(size + 1)).astype(kind)
        wanted = item.astype(np.int32)
        best: tuple[int, int, int] | None = None
        step = max(1, _CELLS // size)
        for i in range(0, len(shifts), step):
            least = best[1] if best else need
            if common[i] < least:
                break
            same = views[shifts[i : i + step] + size] == wanted
            sums = np.zeros((len(same), size + 1), kind)
            np.cumsum(same, axis=1, out=sums[:, 1:])
            total = sums[:, -1].copy()
            sums *= kind(share.denominator)
            sums += loss
            low = np.minimum.accumulate(sums, axis=1)
            can = (low[:, : size + 1 - least] <= sums[:, least:]).any(axis=1)
            if best:
                begin, end = same.argmax(axis=1), size - same[:, ::-1].argmax(axis=1)
                longer = (end - begin > least) & (low[:, : max(size - least, 0)] <= sums[:, least + 1 :]).any(axis=1)
                can &= longer | ((end - begin >= least) & ((total > best[2]) | (shifts[i : i + step] + begin < best[0])))
            for d in np.flatnonzero(can).tolist():
                if best and common[i + d] < best[1]:
                    break
                start, length, equal = longest_overlap(same[d], self.similarity)
                first = int(shifts[i + d]) + start
                if length >= need and (equal == length or whole) and (best is None or (length, equal, -first) > (best[1], best[2], -best[0])):
                    best = (first, length, equal)
                    if any_ or equal == size:
                        return best  # nothing is longer, and what follows is later
        return best

    def match(self, text: str | None, any_: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, first word, words, equal words) of the longest overlap with every item found in ``text``, or of some overlap with one item."""
        tokens = words(text)
        ids = np.fromiter(map(self.vocab.get, tokens, repeat(0)), np.int64, len(tokens))
        best: dict[int, tuple[int, int, int]] = {}
        for k, shifts in self._diagonals(ids).items():
            item_id, item = self.items[k]
            found = self._longest(ids, item, shifts, any_)
            if found and (item_id not in best or (found[1], found[2], -found[0]) > (best[item_id][1], best[item_id][2], -best[item_id][0])):
                best[item_id] = found
                if any_:
                    break
        return [(i, *v) for i, v in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def longest_overlap(same: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """(start, length, equal) of the longest run that begins and ends equal with a share >= ``similarity`` equal, the first of them."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # Over the equal positions only: run i..j has j - i + 1 equal of at[j] - at[i] + 1.
    k = np.arange(len(at))
    right = (k + 1) - similarity * (at + 1)
    left = k - similarity * at
    reach = np.maximum.accumulate(right[::-1])[::-1]
    j = np.searchsorted(-reach, -(left - 1e-9), "right") - 1
    length = np.where(j >= k, at[j] - at + 1, 0)
    i = int(length.argmax())
    return (int(at[i]), int(length[i]), int(j[i]) - i + 1) if length[i] else (0, 0, 0)


def _indexes(benchmark: DataFrame, min_words: int, similarity: float, weight: int, block_bytes: int) -> Iterator[SeedIndex]:
    """Seed indexes that together hold every test item, each of at most about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        rows = sorted({(r[0], r[1]) for r in mine.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield SeedIndex(rows, min_words, similarity, weight)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_words: int = 13, similarity: float = 0.8, weight: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that :func:`contaminated` finds no overlap in. Narrow.

    Null and empty texts overlap with nothing and stay; null ids and repeated rows are kept as they are. An empty
    benchmark keeps all rows, an empty table gives an empty result.
    """
    out = docs
    for index in _indexes(benchmark, min_words, similarity, weight, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(text, shared=shared):
            return text.map(lambda t: not shared.value.match(t, any_=True))

        out = out.where(clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = 13,
    similarity: float = 0.8,
    weight: int = 6,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal): each document and test item that overlap.

    An overlap is a stretch of at least ``min_words`` words, aligned word by
    word, of which a share ``similarity`` is equal (items with fewer words must
    occur whole); the longest is reported, the earliest of ties. Seeds are
    chosen so that such a stretch of any length is hit, whatever words
    are substituted. One narrow pass over whole texts without a shuffle:
    the test side is a hash table in each task, at most ``block_bytes`` of text;
    a larger benchmark is cut into parts by a hash of its id and takes a pass
    for each. Null and empty texts, on either side, match nothing; null ids stay
    null; repeated documents are reported once for each row, repeated items
    once; columns with other names are not read.
    """
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = []
    for built in _indexes(benchmark, min_words, similarity, weight, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in (x for whole in batches for x in lots(whole, 1, LOT)):
                out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in index.value.match(t)]
                cols = list(zip(*out, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "n_equal"])

        found.append(kept.mapInArrow(run, RESULT))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
