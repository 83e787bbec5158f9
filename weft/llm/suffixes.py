"""Exact removal of repeated byte strings: those that can be equal are brought together, then suffix-sorted.

Sorting every suffix of a corpus would move each byte many times between
machines. Equal strings of ``length`` bytes can be brought together more
cheaply: each string has an anchor, the first of its ``GRAM``-byte grams with the
least hash, and equal strings have equal anchors. So a text falls into runs of
consecutive strings with the same anchor ("contexts"), and

1. contexts are dealt by the hash of their anchor's gram; of equal contexts all but the
   earliest are repeats as a whole;
2. where one gram has different contexts, their bytes are gathered by gram and
   suffix-sorted with the difference-cover algorithm (Kärkkäinen and Sanders,
   2003), which then compares adjacent prefixes; where it has more than ``CROWD``, each
   of their strings is dealt by its own hash instead, in the same shuffle;
3. the repeats of each document are united.

All steps are exact but for 64-bit hashes of whole contexts that share a gram hash as well.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpointed, lots, sent

#: Bytes of text, or list items, that a task unpacks at a time, and bytes that it sorts at a time.
_LOT, _ITEMS, _SORTED = 8 << 20, 20_000, 1 << 19
#: Rows that a task gives out at a time.
_ROWS = 50_000
#: Length of the grams that anchors are chosen from.
GRAM = 37
#: Positions handled at a time; they share a word with the top bits of a hash.
_POSITIONS = 1 << 20
#: Contexts of one gram beyond this many are compared by the hashes of their strings, in all tasks.
CROWD = 4000
#: A document's place: the low bits are a byte position, those above tell texts of one id apart.
_AT = 40


# Suffix sorting -----------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` (non-negative integers below 2**20), sorted by at least their first ``depth`` symbols.

    Suffixes at 1 and 2 modulo 3 are named by their sorted triples; where names
    are not unique and triples don't reach ``depth``, the string of names is sorted
    the same way. The other suffixes follow from the rank one further, and the
    two sorted lists are merged by counting. At most 2**20 symbols.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = text
    t[:n] += 1
    base = int(t.max()) + 1
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    key = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(new) - 1
    if depth > 3 and not new.all():
        order = suffix_order(name, -(-depth // 3))
        tie = np.zeros(len(order), bool)
        tie[1:] = _same(name, order, -(-depth // 3))
        name[order] = np.cumsum(~tie) - 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1
    sample = sample[order]
    zeros = np.arange(0, n, 3)
    wide = len(name) + 2
    zero_key = t[zeros] * wide + rank[zeros + 1]
    by = np.argsort(zero_key, kind="stable")
    zeros, zero_key = zeros[by], zero_key[by]
    one = sample[sample % 3 == 1]
    two = sample[sample % 3 == 2]
    before = np.searchsorted(t[one] * wide + rank[one + 1], zero_key, "left")
    before += np.searchsorted((t[two] * base + t[two + 1]) * wide + rank[two + 2], (t[zeros] * base + t[zeros + 1]) * wide + rank[zeros + 2], "left")
    out = np.empty(n + (n % 3 == 1), np.int64)
    free = np.ones(len(out), bool)
    # Suffixes equal as far as they were compared may be counted in either order.
    at = np.maximum.accumulate(before) + np.arange(len(zeros))
    out[at] = zeros
    free[at] = False
    out[free] = sample
    return out[out < n]


def _same(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether neighbours in ``order`` agree in their first ``depth`` symbols, the end being a symbol of its own."""
    t = np.full(len(text) + depth, -1, text.dtype if text.dtype.kind == "i" else np.int64)
    t[: len(text)] = text
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), bool)
    live = np.arange(len(a))
    for k in range(depth):
        live = live[t[a[live] + k] == t[b[live] + k]]
        if not len(live):
            break
    same[live] = True
    return same


def repeats(parts: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(document, place, bytes) of runs of strings that occur at an earlier (document, place) of ``parts``, overlapping runs united."""
    parts = list({(doc, place): (doc, place, x) for doc, place, x in parts}.values())  # a repeated row is one document
    sizes = np.array([len(x) for _, _, x in parts])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    ranked = sorted(range(len(parts)), key=lambda i: parts[i][:2])
    # Parts lie in the order of their places, so that of equal strings the one further left is earlier.
    start = 0
    owner = np.empty(len(text), np.int64)
    valid = np.zeros(len(text), bool)
    begins = np.empty(len(parts), np.int64)
    for i in ranked:
        x = np.frombuffer(parts[i][2], np.uint8)
        text[start : start + len(x)] = x.astype(np.int64) + 1
        owner[start : start + len(x) + 1] = i
        valid[start : start + len(x) - length + 1] = True
        begins[i] = start
        start += len(x) + 1
    order = suffix_order(text, length)
    order = order[valid[order]]
    if len(order) < 2:
        return []
    group = np.concatenate(([0], np.cumsum(~_same(text, order, length))))
    least = np.full(group[-1] + 1, len(text), np.int64)
    np.minimum.at(least, group, order)
    again = np.sort(order[order != least[group]])
    if not len(again):
        return []
    cut = np.flatnonzero((np.diff(again) > 1) | (np.diff(owner[again]) != 0)) + 1
    out = []
    for run in np.split(again, cut):
        doc, place, _ = parts[owner[run[0]]]
        out.append((doc, place + int(run[0] - begins[owner[run[0]]]), len(run) - 1 + length))
    return out


# Contexts -----------------------------------------------------------------------


def _pieces(raws: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, start, bytes) of stretches that hold each string of every text once, in lots of at most _POSITIONS bytes."""
    most = _POSITIONS // 2
    lot, used = [], 0
    for i, raw in enumerate(raws):
        at = 0
        while len(raw) - at >= length:
            n = min(len(raw) - at, most)
            if used + n > _POSITIONS - 64:
                yield lot
                lot, used = [], 0
            lot.append((i, at, n))
            used += n
            at += n - length + 1
    if lot:
        yield lot


def contexts(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, strings, gram hash, context hash) of every context of the texts, as arrays."""
    import xxhash

    width = length - GRAM + 1
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    factors = np.random.default_rng(9).integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for lot in _pieces(raws, length):
        buf = b"".join([raws[i][at : at + n] for i, at, n in lot]) + bytes(GRAM + 8)
        n = len(buf) - GRAM - 8
        word = np.ndarray((n + GRAM,), "<u8", buf, strides=(1,))
        h = np.zeros(n, np.uint64)
        for o, f in zip((0, 8, 16, 24, GRAM - 8), factors, strict=True):
            h += word[o : o + n] * f
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        least = (h & np.uint64(~(_POSITIONS - 1) & (2**64 - 1))) | np.arange(n, dtype=np.uint64)
        # Least of width successive: two overlapping powers of two.
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: -(width - step)], least[width - step :])
        anchor = (least & np.uint64(_POSITIONS - 1)).astype(np.int64)[: n - length + 1]
        sizes = np.array([x[2] for x in lot])
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for b, s in zip(begins[1:].tolist(), sizes[:-1].tolist(), strict=True):
            anchor[max(b - min(s, length - 1), 0) : b] = -1  # strings that would cross into the next stretch
        cut = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]))
        # An anchor belongs to one stretch, as strings that cross are left out.
        lo, hi = cut[:-1], cut[1:]
        real = anchor[lo] >= 0
        lo, hi = lo[real], hi[real]
        which = np.searchsorted(begins, lo, "right") - 1
        view = memoryview(buf)
        digest = xxhash.xxh3_64_intdigest
        ctx = np.array([digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + (length - 1)).tolist(), strict=True)], np.uint64)
        text = np.array([x[0] for x in lot])[which]
        start = np.array([x[1] for x in lot])[which] + lo - begins[which]
        for c, x in zip(cols, (text, start, hi - lo, h[anchor[lo]].view(np.int64), ctx.view(np.int64)), strict=True):
            c.append(x)
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in cols)


def _united(doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that overlap or touch, of the same document, as one. Sorted."""
    if not len(doc):
        return doc, at, size
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + size)[order]
    # Ends grow within a document as its stretches are a sliding window's.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first], np.maximum.reduceat(end, first) - at[first]


_NO_ID = -(1 << 63)
_ROW = "key long, ctx long, doc long, at long, n int"


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(raws: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([(xxhash.xxh3_64_intdigest(x) & 0x3FFFFF) << _AT for x in raws], np.int64)


def _raw(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, which are dealt in half the room."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False, write_dict_id=False).compress
    for b in (x for whole in batches for x in lots(whole, 1, _LOT)):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x) for x in _raw(b.column(1))], pa.binary())], names=["id", "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def _batch(names: list[str], cols: list, types: list | None = None) -> pa.RecordBatch:
    types = types or [pa.int64()] * len(cols)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _scan(length: int):
    """Contexts of each batch of (id, text); of equal ones within it only the earliest, the others as stretches to remove (n < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in lots(whole, 1, _LOT)):
            ids, raws = _ids(b.column(0)), _raw(b.column(1))
            text, start, n, key, ctx = contexts(raws, length)
            doc, at = ids[text], _places(raws)[text] + start if len(text) else text
            order = np.lexsort((at, doc, ctx, key))
            text, n, key, ctx, doc, at = (x[order] for x in (text, n, key, ctx, doc, at))
            again = np.zeros(len(n), bool)
            again[1:] = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
            d, a, s = _united(doc[again], at[again], n[again] + length - 1)
            once = ~again
            yield _batch(
                ["key", "ctx", "doc", "at", "n"],
                [np.concatenate((key[once], d * 31 + a)), np.concatenate((ctx[once], np.zeros(len(d), np.int64))), np.concatenate((doc[once], d)), np.concatenate((at[once], a)), np.concatenate((n[once], -s))],
                [*[pa.int64()] * 4, pa.int32()],
            )

    return run


def _compare(length: int):
    """From contexts sorted by gram, context and place: stretches to remove (n < 0), and the earliest of each context where its gram has another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, False  # the earliest row of the last context, and whether its gram is known to have several
        for b in batches:
            key, ctx, doc, at, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            whole = n < 0
            out = [(doc[whole], at[whole], n[whole], key[whole])]
            key, ctx, doc, at, n = (x[~whole] for x in (key, ctx, doc, at, n))
            if held is not None:
                key, ctx, doc, at, n = (np.concatenate(([x], y)) for x, y in zip(held, (key, ctx, doc, at, n), strict=True))
            if not len(key):
                yield _batch(["doc", "at", "n", "key"], [np.concatenate(x) for x in zip(*out, strict=True)])
                continue
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= ctx[1:] != ctx[:-1]
            first = np.flatnonzero(new)
            mine = first[np.cumsum(new) - 1]
            again = (doc != doc[mine]) | (at != at[mine])
            d, a, s = _united(doc[again], at[again], n[again] + length - 1)
            out.append((d, a, -s, np.zeros(len(d), np.int64)))
            # A context's earliest row goes on if its gram has another context.
            gram = np.cumsum(new_key) - 1
            several = np.bincount(gram[first]) > 1
            several[0] |= crowded
            give = first[several[gram[first]]]
            if crowded:
                give = give[give > 0]  # the row carried over has been given out
            out.append((doc[give], at[give], n[give], key[give]))
            last = int(mine[-1])
            held, crowded = (key[last], ctx[last], doc[last], at[last], n[last]), bool(several[-1])
            yield _batch(["doc", "at", "n", "key"], [np.concatenate(x) for x in zip(*out, strict=True)])

    return run


_PART = "key long, more long, doc long, at long, part binary"


def _cut_out(length: int):
    """(key, more, doc, at, part): the bytes of the contexts listed for each text; of crowded grams each string instead, with both halves of its hash as key and more, and no bytes."""
    names, types = ["key", "more", "doc", "at", "part"], [*[pa.int64()] * 4, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (y for whole in batches for x in lots(whole, 2, _ITEMS) for y in lots(x, 1, _LOT // 2)):
            ids, raws = _ids(b.column(0)), _unpacked(b.column(1))
            places = _places(raws)
            rows = []
            for i, wanted in enumerate(b.column(2).to_pylist()):
                for x in wanted:
                    o = x["at"] - int(places[i])
                    if not (0 <= o < len(raws[i]) and (x["at"] >> _AT) == (int(places[i]) >> _AT)):
                        continue
                    if x["crowd"]:
                        for k in range(x["n"]):
                            key, more = struct.unpack("<qq", hashlib.blake2b(raws[i][o + k : o + k + length], digest_size=16).digest())
                            rows.append((key, more, int(ids[i]), x["at"] + k, None))
                    else:
                        rows.append((x["key"], 0, int(ids[i]), x["at"], raws[i][o : o + x["n"] + length - 1]))
                    if len(rows) >= _ROWS:
                        yield _batch(names, list(zip(*rows, strict=True)), types)
                        rows = []
            if rows:
                yield _batch(names, list(zip(*rows, strict=True)), types)

    return run


def _later(strings: np.ndarray, first: np.ndarray | None, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Stretches (doc, at, n < 0) of the strings (key, more, doc, at) but the first of each hash, and that of the last hash. Sorted; ``first`` is that of rows before."""
    if first is not None:
        strings = np.concatenate((first[:, None], strings), axis=1)
    key, more, doc, at = strings
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    mine = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (doc != doc[mine]) | (at != at[mine])  # a repeated row is one document
    d, a, s = _united(doc[again], at[again], np.full(int(again.sum()), length))
    return [d, a, -s], strings[:, mine[-1]]


def _sorted_out(length: int):
    """Stretches to remove (n < 0), from parts sorted by gram, which are gathered in whole grams up to the size of one suffix sort, and strings sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple[int, int, bytes]] = []
        group: list[tuple[int, int, bytes]] = []
        lot_size = group_size = 0
        current = first = None

        def done(parts: list) -> Iterator[pa.RecordBatch]:
            if parts and (found := repeats(parts, length)):
                d, a, s = zip(*found, strict=True)
                yield _batch(["doc", "at", "n"], [d, a, [-x for x in s]])

        for whole in batches:
            alone = whole.filter(whole.column(4).is_null())
            if alone.num_rows:
                strings = np.stack([c.to_numpy(zero_copy_only=False) for c in alone.columns[:4]])
                out, first = _later(strings, first, length)
                yield _batch(["doc", "at", "n"], out)
            for b in lots(whole.filter(whole.column(4).is_valid()), 4, _LOT // 2):
                for key, _, doc, at, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if key != current:
                        if lot_size + group_size > _SORTED:
                            yield from done(lot)
                            lot, lot_size = [], 0
                        lot += group
                        lot_size += group_size
                        group, group_size, current = [], 0, key
                    group.append((doc, at, part))
                    group_size += len(part) + 1
        if lot_size + group_size > _SORTED:
            yield from done(lot)
            lot = []
        yield from done(lot + group)

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _with_lists(packed: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Compressed texts beside their lists. Both uses deal the texts alike, whatever the size of the lists, so that they are dealt once."""
    return packed.join(lists.withColumnRenamed("doc", "_doc").hint("merge"), F.col("_key") == F.col("_doc"), how)


def repeated_stretches(texts: DataFrame, packed: DataFrame, length: int = 100, crowd: int = CROWD) -> DataFrame:
    """(doc, at, n): stretches of n bytes that strings of ``length`` bytes with an earlier start elsewhere cover; they may overlap.

    ``texts`` has id and text, ``packed`` the same with the text compressed. ``at`` holds the byte position in
    its low 40 bits. A null id reads as the least long.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    rows = texts.where(F.octet_length("text") >= length).mapInArrow(_scan(length), _ROW)
    dealt = rows.repartition("key").sortWithinPartitions("key", "ctx", "doc", "at")
    found = checkpointed(dealt.mapInArrow(_compare(length), "doc long, at long, n long, key long"))
    whole = found.where("n < 0").select("doc", "at", (-F.col("n")).alias("n"))
    part = found.where("n > 0")
    many = sent(part.groupBy("key").count().where(F.col("count") > crowd).select("key", F.lit(True).alias("crowd")))
    wanted = part.join(many, "key", "left").groupBy("doc").agg(F.collect_list(F.struct("at", "n", "key", "crowd")).alias("wanted"))
    parts = _with_lists(packed, wanted, "inner").select("id", "packed", "wanted").mapInArrow(_cut_out(length), _PART)
    # Each gram's parts go to one task, which takes them gram by gram; crowded grams are spread by string. All are
    # rows of one shuffle: with a job of their own for the crowded ones the texts would be dealt again.
    dealt = parts.repartition("key").sortWithinPartitions("key", "more", "doc", "at")
    removed = dealt.mapInArrow(_sorted_out(length), "doc long, at long, n long").select("doc", "at", (-F.col("n")).alias("n"))
    return whole.union(removed)


def _digest(id_col: str):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (y for whole in batches for x in lots(whole, 2, _ITEMS) for y in lots(x, 1, _LOT // 2)):
            rows = []
            for raw, spans in zip(_unpacked(b.column(1)), b.column(2).to_pylist(), strict=True):
                kept, at, n_spans, removed = hashlib.sha256(), 0, 0, 0
                place = int(_places([raw])[0]) >> _AT
                mine = sorted((x["at"] & ((1 << _AT) - 1), x["n"]) for x in spans or () if x["at"] >> _AT == place)
                for a, n in _maximal(mine):
                    kept.update(raw[at:a])
                    at, n_spans, removed = a + n, n_spans + 1, removed + n
                kept.update(raw[at:])
                rows.append((len(raw), removed, n_spans, kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _maximal(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (start, bytes) sorted by start; touching ones are one."""
    out: list[list[int]] = []
    for a, n in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b - a) for a, b in out]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    A byte is removed if a string of ``length`` bytes covers it that starts
    earlier as well: in a document with a smaller id, or in the same one further
    left. Strings are judged on the input; matches never cross documents. Null
    texts are empty. A null id comes before all others. Rows with the same id and text are the
    same document and get the same result; different texts of one id are ordered by
    a hash. Columns other than the id and text are not read.
    """
    texts = _texts(docs, id_col, text_col)
    packed = texts.mapInArrow(_packed, "id long, packed binary").withColumn("_key", F.coalesce("id", F.lit(_NO_ID)))
    spans = repeated_stretches(texts, packed, length)
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return _with_lists(packed, listed, "left").select("id", "packed", "spans").mapInArrow(_digest(id_col), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
