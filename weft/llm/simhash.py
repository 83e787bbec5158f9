"""SimHash near-duplicate detection with pigeonhole blocks (Manku, Jain and Das Sarma, 2007)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import LOT, checkpointed, connected_components, lots, sent

BITS = 64
#: XXH64 values that are turned to bits at a time.
_STEP = 1 << 16
#: Shingles of a text that a sketch is made of, at most; larger sets are halved. Standard deviations beyond which the sketches of halved sets tell two texts apart.
SKETCHED, SURE = 512, 6
_NO_ID = -(1 << 63)
#: MinHash bands and values in each: of pairs at Jaccard similarity 0.8 all bands differ for 3 in a million.
BANDS, ROWS = 24, 4


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text.

    Words are runs of bytes other than ASCII white space, after A-Z became a-z.
    A text with fewer words than ``shingle`` is one shingle; a null text, or one
    without words, gives 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: -(shingle - 1)] if shingle > 1 else starts, ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _STEP):
        spans = zip(starts[i : i + _STEP].tolist(), ends[i : i + _STEP].tolist(), strict=True)
        h = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every row of ``docs`` as a signed long.

    One narrow pass: texts go to Arrow batches, ids and fingerprints come back.
    Repeated rows and null ids are kept as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in lots(whole, 1, LOT)):
            fp = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, fp long")


def block_masks(blocks: int, max_distance: int) -> list[tuple[int, list[int]]]:
    """Masks such that two fingerprints within ``max_distance`` bits agree under at least one.

    ``blocks`` pieces, at most ``max_distance`` of which can differ: every mask
    covers ``blocks - max_distance`` of them. With each mask come the pieces before its
    last one that it does not cover: where two fingerprints agree under several
    masks, they differ in all of these under one alone.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    piece = [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for c in combinations(range(blocks), blocks - max_distance):
        mask = 0
        for i in c:
            mask |= piece[i]
        out.append((mask, [piece[i] for i in range(c[-1]) if i not in c]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """``rows`` with fp dealt to every mask: columns mask and key, the bits of fp under it."""
    masks = F.array(*[_long(m) for m, _ in block_masks(blocks, max_distance)])
    keyed = rows.select("*", F.posexplode(masks).alias("mask", "_bits"))
    return keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("_bits"))).drop("_bits")


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _same_key() -> Column:
    return (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key"))


def _first_meeting(max_distance: int, blocks: int) -> Column:
    """Of rows a and b of :func:`_keyed` that agree under a mask: near enough, and under no earlier mask."""
    apart = F.array(*[F.array(*map(_long, d)).cast("array<long>") for _, d in block_masks(blocks, max_distance)])
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    return (F.bit_count(differ) <= max_distance) & F.forall(F.get(apart, F.col("a.mask")), lambda x: differ.bitwiseAND(x) != 0)


def close_pairs(distinct: DataFrame, max_distance: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance), each once, of all pairs a < b of the distinct longs in ``distinct.fp`` within ``max_distance`` bits.

    Each fingerprint is dealt to every mask; those that agree under a mask meet
    in an equi-join whose condition verifies the Hamming distance and that no
    earlier mask has the pair, so that candidates which fail are never rows.
    Keys have 64 * (blocks - max_distance) / blocks bits, which keeps blocks
    small for billions of fingerprints.
    """
    keyed = _keyed(distinct.select("fp"), max_distance, blocks)
    pairs = keyed.alias("a").join(keyed.alias("b"), _same_key() & _first_meeting(max_distance, blocks) & (F.col("a.fp") < F.col("b.fp")))
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))).alias("distance"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 3,
    blocks: int = 6,
) -> DataFrame:
    """(id_col, fp, n_links, component_id) for every row of ``docs``.

    Copies share a fingerprint and are counted once before the join, so a group
    of a billion copies is one row in it. ``component_id`` is the smallest id
    reachable by links of at most ``max_distance`` bits, the row's own included;
    ``n_links`` counts linked fingerprints other than its own. Null texts and
    texts without words have fingerprint 0 and link like any other. A null id
    never becomes a component's id unless all its ids are null. Repeated rows
    come back repeated; an empty table gives an empty result. Columns other
    than the id and the text are not read, whatever their names.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    pairs = checkpointed(close_pairs(distinct.select("fp"), max_distance, blocks))
    both = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp")))
    links = both.groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    tied = connected_components(pairs, "a", "b").withColumnRenamed("node", "fp")
    members = distinct.join(tied, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = members.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = members.join(roots, "component").join(links, "fp", "left")
    labels = labels.select("fp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return fps.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "n_links", "component_id")


def word_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct XXH64 values of a text's word shingles, sorted; none for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    many = range(max(len(words) - shingle + 1, min(len(words), 1)))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in many], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """SimHash of distinct features, as a signed long."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > max(len(hashes), 1), bitorder="little").view("<i8")[0])


def level(n: int) -> int:
    """Halvings after which about ``SKETCHED`` or fewer of ``n`` hashes are left."""
    return max(0, (n - 1).bit_length() - (SKETCHED - 1).bit_length()) if n > SKETCHED else 0


def sketch(hashes: np.ndarray, halvings: int) -> list[int]:
    """Odd sketch (Mitzenmacher, Pagh and Pham, 2014) of sorted hashes as 8 signed longs: of 512 bits each is the parity of the hashes that fall on it.

    A hash that only one of two sets holds changes one bit, so that two sketches never differ in more bits
    than the sets do in members. Of larger sets only the least hashes, a share of 2 ** -halvings, are looked at.
    """
    few = hashes[: np.searchsorted(hashes, np.uint64((1 << (64 - halvings)) - 1), "right")]
    place = (few * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
    odd = np.bincount(place.astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _most_bits(n: Column, halvings: Column, similarity: float) -> Column:
    """In so many bits the sketches of two sets with ``n`` members together can differ that have the Jaccard similarity.

    Exact for sets that were not halved; ``SURE`` standard deviations for others.
    """
    apart = n * (1 - similarity) / (1 + similarity) / F.pow(F.lit(2.0), halvings)
    return apart + F.when(halvings > 0, SURE * F.sqrt(apart)).otherwise(0.0) + 1e-6


def alike(x: str, y: str, similarity: float) -> Column:
    """Rows ``x`` and ``y`` (aliases) with columns n, level, s0.. and t0.. of :func:`_sketched` may have that similarity."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    sized = (a("n") >= similarity * b("n")) & (b("n") >= similarity * a("n"))
    above = lambda one, other, k: F.when(one("level") < other("level"), one(f"t{k}")).otherwise(one(f"s{k}"))
    bits = sum((F.bit_count(above(a, b, k).bitwiseXOR(above(b, a, k))) for k in range(1, 8)), F.bit_count(above(a, b, 0).bitwiseXOR(above(b, a, 0))))
    return sized & (F.abs(a("level") - b("level")) <= 1) & (bits <= _most_bits(a("n") + b("n"), F.greatest(a("level"), b("level")), similarity))


def bands(hashes: np.ndarray) -> list[int]:
    """Signed longs, one of each of ``BANDS`` groups of ``ROWS`` MinHash values.

    Two sets with Jaccard similarity j have the same one in a place with probability j ** ROWS; an empty set has zeros.
    """
    if not len(hashes):
        return [0] * BANDS
    r = np.random.default_rng(31)
    flip, factor, mix = (r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1 << 10):
        low = np.minimum(low, ((hashes[i : i + (1 << 10), None] ^ flip) * factor).min(axis=0))
    low = (low ^ (low >> np.uint64(29))) * mix
    return low.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


_PRINT = "id long, one long, two long, fp long, n long, level int, sketches array<long>, bands array<long>"


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in lots(whole, 3, LOT)):
            made = []
            for t in b.column(3).to_pylist():
                h = word_hashes(t, shingle)
                k = level(len(h))
                made.append((majority(word_hashes(t, 1)), len(h), k, [*sketch(h, k), *sketch(h, k + 1)], bands(h)))
            fp, n, k, sketches, banded = list(zip(*made, strict=True)) or [()] * 5
            longs = pa.list_(pa.int64())
            cols = [pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(sketches, longs), pa.array(banded, longs)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["id", "one", "two", "fp", "n", "level", "sketches", "bands"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in (x for whole in batches for x in lots(whole, 2, LOT)):
        texts = [pack((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["one", "two", "packed"])


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in (x for whole in batches for x in lots(whole, 1, 1 << 20)):
            sets = [word_hashes(unpack(t).decode("utf-8", "surrogatepass"), shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def _sketched(nodes: DataFrame) -> DataFrame:
    """(node, fp, n, level, s0.., t0..): the sketch of each node, and that after one halving more, which is compared with a larger text's."""
    return nodes.select("node", "fp", "n", "level", *[F.get("sketches", F.lit(k)).alias(f"{c}{k % 8}") for k, c in enumerate("s" * 8 + "t" * 8)])


def _really_similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' shingle sets have that Jaccard similarity."""
    x, y = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(x, "a").join(y, "b")
    return checkpointed(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _distinct_texts(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, row, node) of every row, node being the least row of its text, told apart by 128 bits; and the prints of the nodes."""
    rows = prints.select("id", "one", "two", F.monotonically_increasing_id().alias("row"))
    least = rows.groupBy("one", "two").agg(F.min("row").alias("node"))
    members = checkpointed(rows.join(least, ["one", "two"]))
    copies = sent(members.where("row <> node").select("row"))
    return members, prints.withColumn("node", F.monotonically_increasing_id()).join(copies, F.col("node") == F.col("row"), "left_anti")


def _blocks(nodes: DataFrame, max_distance: int, blocks: int, part: int = 512) -> DataFrame:
    """(block, mask, part, node, fp) of nodes that share a block with others: the bits of the fingerprint under a mask, or a band of MinHash values.

    Blocks of more than ``part`` nodes fall into parts of about that size, others each time.
    """
    masks = [_long(m) for m, _ in block_masks(blocks, max_distance)]
    keys = F.posexplode(F.concat(F.array(*[F.col("fp").bitwiseAND(m) for m in masks]), F.col("bands"))).alias("mask", "key")
    keyed = nodes.where("n > 0").select("node", keys).select("node", "mask", F.xxhash64("mask", "key").alias("block"))
    shared = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    kept = keyed.join(shared, "block").join(nodes.select("node", "fp"), "node")
    return kept.select("block", "mask", F.pmod(F.xxhash64("node", "block"), F.ceil(F.col("size") / part)).alias("part"), "node", "fp")


def _near_by_words(max_distance: int, n_masks: int) -> Column:
    """Rows a and b of one block: by a band, or with words' fingerprints that are as near as that."""
    return (F.col("a.mask") >= n_masks) | (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance)


def _groups(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, max_distance: int, blocks: int) -> DataFrame:
    """(node, component) of nodes that links connect with others."""
    n_masks = len(block_masks(blocks, max_distance))
    sketches = _sketched(nodes)
    met = checkpointed(_blocks(nodes, max_distance, blocks))
    sets = checkpointed(sets_of(met.select("node").distinct()))

    def possible(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select([F.col(c).alias(c if c != "node" else k) for c in sketches.columns]) for k in "ab")
        both = pairs.join(a, "a").alias("x").join(b.alias("y"), F.col("x.b") == F.col("y.b"))
        return both.where(alike("x", "y", similarity)).select("x.a", "x.b")

    # First each node meets the first one of its part of a block and the one before it there.
    order = Window.partitionBy("block", "part").orderBy("fp", "node")
    me = F.struct("mask", "node", "fp")
    near = met.select(me.alias("a"), F.array(F.first(me).over(order), F.lag(me).over(order)).alias("bs"))
    near = near.select("a", F.explode("bs").alias("b"))
    near = near.where((F.col("a.node") != F.col("b.node")) & _near_by_words(max_distance, n_masks))
    some = checkpointed(possible(near.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()))
    tied = checkpointed(connected_components(_really_similar(some, sets, similarity), "a", "b"))

    # Then, in blocks with several components, all that are not of the largest one meet all of other components.
    size = tied.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    tied_size = tied.join(size, "component").select("node", "component", "size")
    placed = met.drop("part").join(tied_size, "node", "left")
    placed = checkpointed(placed.select("block", "mask", "node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size")))
    mixed = placed.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("size", "component")).alias("largest"))
    mixed = mixed.where("low <> high").select("block", F.col("largest.component").alias("largest"))
    rest = checkpointed(placed.join(mixed, "block").join(sketches, "node"))
    once = (F.col("b.component") == F.col("b.largest")) | (F.col("a.node") < F.col("b.node"))
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.component") != F.col("b.component")) & once & _near_by_words(max_distance, n_masks) & alike("a", "b", similarity)
    pairs = rest.where("component <> largest").alias("a").join(rest.alias("b"), on)
    pairs = pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
    pairs = checkpointed(pairs.join(some, ["a", "b"], "left_anti"))
    links = tied.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(links.union(_really_similar(pairs, sets, similarity)), "a", "b")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_distance: int = 3, blocks: int = 6) -> DataFrame:
    """The rows of ``docs``, columns unchanged, without near-duplicates: of each group one row stays.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is
    ``similarity`` or more, which is compared exactly; a group is what links connect. Pairs are proposed
    by the SimHash of their distinct words, within ``max_distance`` bits, which is much nearer for
    edited copies than that of shingles, and, however far apart that is, by equal :func:`bands` of
    the shingles. Sketches of the shingles pass over pairs that can't be as similar.

    All pairs of a large group would be many. So first each text meets two of its
    block, and what is similar becomes one component; then those outside of a block's largest
    component meet all in other components. Groups come out as if all pairs had been compared.

    Equal texts, null and empty ones being equal, are one from the start; texts without words
    hold no shingle and link with nothing else. The row with the least id stays, one of equal rows; a null
    id only in a group without others. An empty table gives an empty result; columns of any name stay as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one, two = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), one.alias("one"), two.alias("two"), text.alias("text"))
    prints = checkpointed(rows.mapInArrow(_prints(shingle), _PRINT))
    members, nodes = _distinct_texts(prints)

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = sent(members.where("row = node").select("node", "one", "two").join(some, "node"))
        texts = rows.select("one", "two", "text").join(wanted.select("one", "two"), ["one", "two"], "left_semi")
        packed = texts.mapInArrow(_packed, "one long, two long, packed binary").groupBy("one", "two").agg(F.max("packed").alias("packed"))
        return packed.join(wanted, ["one", "two"]).select("node", "packed").mapInArrow(_shingle_sets(shingle), "node long, set array<long>")

    groups = _groups(nodes, sets_of, similarity, max_distance, blocks)
    grouped = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    me = F.struct(F.col("id").isNull().alias("no"), F.coalesce("id", F.lit(_NO_ID)).alias("id"), "one", "two")
    first = grouped.groupBy("component").agg(F.min(me).alias("first"))
    mine = grouped.groupBy("component", me.alias("me")).agg(F.count(F.lit(1)).alias("rows")).join(first, "component")
    keys = [F.col(f"me.{c}").alias(f"_text_{c}") for c in ("id", "one", "two")]
    keyed = mine.select(*keys, "rows", (F.col("me") == F.col("first")).alias("stays"))
    # Rows to be left out, and those of which one of several equal ones stays; both are few beside all rows.
    gone = sent(keyed.where("not stays or rows > 1").drop("rows"))
    on = ["_text_id", "_text_one", "_text_two"]
    held = docs.withColumns({"_text_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "_text_one": one, "_text_two": two})
    kinds = dict(docs.dtypes)
    order = [F.col(c) for c in docs.columns if c != text_col and kinds[c] != "variant" and "map<" not in kinds[c]]
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    several = held.join(gone.where("stays"), on, "left_semi").withColumn("_place", place).where("_place = 1")
    return held.join(gone, on, "left_anti").select(*docs.columns).union(several.select(*docs.columns))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
