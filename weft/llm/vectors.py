"""Embedding near-duplicates by a robust-pruned flat graph (Subramanya et al., 2019), built on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpointed, connected_components

#: Vectors that the cluster centres are fitted on, at most: of all, and of each shard that is split.
SAMPLE, SAMPLE_OF_SHARD = 8192, 2048
#: Centres of each of the two levels, at most.
CENTRES, CENTRES_OF_SHARD = 512, 256
#: Mean number of different vectors whose nearest centre is a shard's, and the number that no shard exceeds (but for the chance of hashes).
SHARD, SHARD_MOST = 1500, 4500
#: Centres that each vector is dealt to.
OVERLAP = 3
DEGREE, ALPHA, BEAM, STEP = 24, 1.2, 48, 4
#: Vectors looked up exactly, in the audit of recall.
AUDIT = 200
_BLOCK = 512
#: Cosines in single precision that are nearer to the threshold are computed once more.
_DOUBT = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without over- or underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    r = np.random.default_rng(seed)
    c = sample[r.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


# The graph of one shard ---------------------------------------------------------


def robust_prune(u: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``nodes`` up to ``degree`` neighbours from its row of ``pool`` (nearest first, -1 for none), as a row filled up with -1.

    A candidate is passed over if one chosen before is closer to it than the node is, by ``alpha``.
    """
    some = np.maximum(pool, 0)
    gap = 2 - 2 * np.einsum("ij,ikj->ik", u[nodes], u[some])
    between = np.maximum(2 - 2 * np.matmul(u[some], u[some].transpose(0, 2, 1)), 0)
    alive = (pool >= 0) & (pool != nodes[:, None])
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        at = alive.argmax(axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        out[some, k] = pool[some, at[some]]
        alive &= alpha * alpha * between[rows, at] > gap
        alive[rows, at] = False
    return out


def build(u: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists of one shard: pruned nearest neighbours, made symmetric and pruned again, and a ring so that all is reachable.

    Similarities are held for a bounded number of rows at a time.
    """
    n, most = len(u), min(len(u) - 1, 3 * degree)
    if most <= 0:
        return [np.zeros(0, np.int64) for _ in range(n)]
    first = []
    for i in range(0, n, _BLOCK):
        sim = u[i : i + _BLOCK] @ u.T
        pool = np.argpartition(-sim, most, axis=1)[:, : most + 1]
        pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(sim, pool, 1), axis=1, kind="stable"), 1)
        first.append(robust_prune(u, np.arange(i, i + len(sim)), pool, degree, alpha))
    out = np.concatenate(first)
    src, dst = np.repeat(np.arange(n), degree), out.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    pairs = np.unique(np.concatenate((np.stack((src, dst), 1), np.stack((dst, src), 1))), axis=0)
    near = np.einsum("ij,ij->i", u[pairs[:, 0]], u[pairs[:, 1]])
    order = np.lexsort((-near, pairs[:, 0]))
    src, dst = pairs[order].T
    begin = np.searchsorted(src, np.arange(n + 1))
    links = []
    for i in range(0, n, _BLOCK):
        nodes = np.arange(i, min(i + _BLOCK, n))
        size = np.minimum(np.diff(begin)[nodes], 3 * degree)
        pool = np.full((len(nodes), max(int(size.max()), 1)), -1, np.int64)
        for k, j in enumerate(nodes):
            pool[k, : size[k]] = dst[begin[j] : begin[j] + size[k]]
        kept = robust_prune(u, nodes, pool, degree, alpha)
        for k, j in enumerate(nodes):
            mine = kept[k][kept[k] >= 0] if size[k] > degree else pool[k, : size[k]]
            links.append(np.unique(np.append(mine, (j + 1) % n)))
    return links


def search(u: np.ndarray, links: list[np.ndarray], threshold: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered pairs (q, x), q not x, of rows at ``threshold`` or closer that a range-expanding greedy search finds, for blocks of q.

    From the medoid each query keeps the ``beam`` nearest seen and visits the nearest not visited; when none is left
    it goes on from everything within the range until nothing new there is found. Cosines are computed of the nodes that the walk comes
    to, none else, and those near the threshold once more in double precision.
    """
    n = len(u)
    width = max(map(len, links), default=0)
    if n < 2 or not width:
        return
    table = np.full((n, width), -1, np.int64)
    for i, x in enumerate(links):
        table[i, : len(x)] = x
    f = u.astype(np.float32)
    medoid = int((u @ u.mean(axis=0)).argmax())
    for at in range(0, n, _BLOCK):
        q = np.arange(at, min(at + _BLOCK, n))
        seen, visited = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        seen[:, medoid] = True
        best, value = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -2, np.float32)
        best[:, 0], value[:, 0] = medoid, f[q] @ f[medoid]
        found: list[np.ndarray] = []

        def keep(r: np.ndarray, x: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows and nodes that are within the range; single precision decides where it can."""
            ok = cos >= threshold + _DOUBT
            doubt = np.flatnonzero(np.abs(cos - threshold) < _DOUBT)
            ok[doubt] = np.einsum("ij,ij->i", u[q[r[doubt]]], u[x[doubt]]) >= threshold  # noqa: B023
            found.append(r[ok] * n + x[ok])  # noqa: B023
            return r[ok], x[ok]

        keep(np.arange(len(q)), np.full(len(q), medoid), value[:, 0])

        def expand(rows: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row, node, cosine) of the neighbours not seen before, each once, in the order of rows."""
            near = table[go]  # noqa: B023
            keys = np.unique((rows[:, None] * n + near)[near >= 0])
            r, x = np.divmod(keys, n)
            fresh = ~seen[r, x]  # noqa: B023
            r, x = r[fresh], x[fresh]
            seen[r, x] = True  # noqa: B023
            cos = np.einsum("ij,ij->i", f[q[r]], f[x])  # noqa: B023
            keep(r, x, cos)  # noqa: B023
            return r, x, cos

        live = np.arange(len(q))
        while len(live):
            open_ = (best[live] >= 0) & ~visited[live[:, None], np.maximum(best[live], 0)]
            live, open_ = live[open_.any(axis=1)], open_[open_.any(axis=1)]
            if not len(live):
                break
            first = open_ & (np.cumsum(open_, axis=1) <= STEP)
            r, c = np.nonzero(first)
            rows, go = live[r], best[live[r], c]
            visited[rows, go] = True
            r, x, cos = expand(rows, go)
            # Each query's new nodes, beside those that it holds.
            count = np.bincount(r, minlength=len(q))
            wide = int(count.max()) if len(r) else 0
            if not wide:
                continue
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            new, worth = np.full((len(q), wide), -1, np.int64), np.full((len(q), wide), -2, np.float32)
            new[r, place], worth[r, place] = x, cos
            got = np.flatnonzero(count)
            ids, values = np.concatenate((best[got], new[got]), axis=1), np.concatenate((value[got], worth[got]), axis=1)
            top = np.argsort(-values, axis=1, kind="stable")[:, :beam]
            best[got], value[got] = np.take_along_axis(ids, top, 1), np.take_along_axis(values, top, 1)
        # What is found on the way is gone on from, node by node for all queries that have come to it.
        front = np.zeros((len(q), n), bool)
        front.ravel()[np.concatenate(found)] = True
        front &= ~visited
        while front.any():
            visited |= front
            more = np.zeros_like(front)
            for x in np.flatnonzero(front.any(axis=0)).tolist():
                here = np.flatnonzero(front[:, x])
                near = links[x]
                r, c = np.nonzero(~seen[here[:, None], near])
                if len(r):
                    r, y = here[r], near[c]
                    seen[r, y] = True
                    r, y = keep(r, y, np.einsum("ij,ij->i", f[q[r]], f[y]))
                    more[r, y] = True
            front = more & ~visited
        r, x = np.divmod(np.concatenate(found), n)
        other = q[r] != x
        yield q[r[other]], x[other]


def exhaustive(u: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As :func:`search`, of all rows."""
    for at in range(0, len(u), _BLOCK):
        a, x = np.nonzero(u[at : at + _BLOCK] @ u.T >= threshold)
        a = a + at
        yield a[a != x], x[a != x]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each of ``n`` rows is linked with by pairs, itself included, whatever the number of pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if (label == before).all():
                break
    while (label[label] != label).any():
        label = label[label]
    return label


# Shards -------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _deal(by_path: dict[str, np.ndarray], overlap: int):
    """(path, id, v): each vector for its path's nearest centres; those of another length than these, or without centres, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, size = np.array(b.column(0).to_pylist(), object), b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for p, s in sorted(set(zip(paths.tolist(), size.tolist(), strict=True))):
                take = pa.array(np.flatnonzero((paths == p) & (size == s)))
                ids, v = b.column(1).take(take), b.column(2).take(take)
                c = by_path.get(p)
                if c is None or c.shape[1] != s:
                    names = pa.array([f"{p}/length {s}" if c is not None else p] * len(ids))
                else:
                    k = min(overlap, len(c))
                    near = np.argsort(-(unit(_matrix(v)) @ c.T), axis=1, kind="stable")[:, :k]
                    again = pa.array(np.repeat(np.arange(len(ids)), k))
                    names, ids, v = pa.array([f"{p}/{x}" for x in near.ravel().tolist()]), ids.take(again), v.take(again)
                yield pa.RecordBatch.from_arrays([names, ids, v], names=["path", "id", "v"])

    return run


def _centres_of_shard(sizes: dict[str, int], most: int):
    def run(t: pa.Table) -> pa.Table:
        p = t.column("path")[0].as_py()
        c = centres(unit(_matrix(t.column("v"))), min(CENTRES_OF_SHARD, max(2, -(-2 * sizes[p] // most))))
        return pa.table({"path": pa.array([p] * len(c)), "c": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return run


def shards(rows: DataFrame, shard: int = SHARD, most: int = SHARD_MOST, overlap: int = OVERLAP, split: bool = True) -> DataFrame:
    """(shard string, id, v): every vector in the shards of its ``overlap`` nearest centres, of at most about ``most`` vectors.

    The first centres come from a bounded sample. Shards beyond ``most`` get centres of their own, all in one job, from a
    bounded sample of each. What still is too large, being too alike, falls into tiles by a hash, and any two tiles
    make a shard, so that all its pairs meet; without ``split`` all that is too large does. Vectors of another length than most have meet among themselves.
    """
    deal = "path string, id long, v array<double>"
    got = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if got is None:
        return rows.select(F.lit("").alias("shard"), "id", "v")
    sample = rows.where(F.size("v") == got["n"]).select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    top = centres(unit(_matrix(sample.column(0))), min(max(1, -(-got["count"] // shard)), CENTRES))
    level = checkpointed(rows.select(F.lit("").alias("path"), "id", "v").mapInArrow(_deal({"": top}, overlap), deal))
    sizes = {r["path"]: r["count"] for r in level.groupBy("path").count().where(F.col("count") > most).collect()}
    if sizes and split:
        share = F.create_map(*[x for p, s in sizes.items() for x in (F.lit(p), F.lit(int(min(1.0, SAMPLE_OF_SHARD / s) * (1 << 31))).cast("long"))])
        big = F.col("path").isin(list(sizes)) & ~F.contains("path", F.lit("length"))
        some = level.where(big & (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 31)) < F.element_at(share, F.col("path"))))
        lower: dict[str, list] = {}
        for r in some.groupBy("path").applyInArrow(_centres_of_shard(sizes, most), "path string, c array<double>").collect():
            lower.setdefault(r["path"], []).append(r["c"])
        split = level.where(F.col("path").isin(list(lower))).mapInArrow(_deal({p: np.array(c) for p, c in lower.items()}, 2), deal).dropDuplicates(["path", "id"])
        level = checkpointed(level.where(~F.col("path").isin(list(lower))).union(split))
    n = level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(2 * F.col("n") / most).cast("int")).where(F.col("n") > most)
    tiled = level.join(F.broadcast(n.select("path", "tiles")), "path", "left")  # no more rows than there are centres
    mine = F.pmod(F.xxhash64("path", "id"), F.col("tiles")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: (k != mine) | (F.col("tiles") == 1))
    names = F.transform(other, lambda k: F.concat_ws("-", F.concat_ws("/", "path", F.least(mine, k).cast("string")), F.greatest(mine, k).cast("string")))
    return tiled.select(F.explode(F.when(F.col("tiles").isNull(), F.array("path")).otherwise(names)).alias("shard"), "id", "v")


def _build_shard(t: pa.Table) -> pa.Table:
    ids = t.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    links = build(unit(_matrix(t.column("v"))[order]).astype(np.float32))
    src = np.repeat(ids, [len(x) for x in links])
    dst = ids[np.concatenate([np.zeros(0, np.int64), *links]).astype(np.int64)]
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


_FOUND = "id long, links long, around long, least long"


def _search_shard(threshold: float, walk: bool):
    """(id, links, around, least) of a shard's vectors: how many others it links them with, how many rows these are, and the least id linked there.

    A pair that meets in several shards counts in the first of these only.
    """

    def run(t: pa.Table) -> pa.Table:
        here = t.column("shard")[0].as_py()
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        ids, copies = ids[order], t.column("copies").to_numpy()[order]
        u = unit(_matrix(t.column("v"))[order])
        # Of the shards that others of this shard are in before it, a column each: pairs that share one count there.
        listed = t.column("shards").to_pylist()
        before = [[s for s in listed[i] if s < here] for i in order.tolist()]
        names = {s: k for k, s in enumerate(sorted({s for x in before for s in x}))}
        wide = max(map(len, before), default=0)
        earlier = np.full((len(ids), wide), -1, np.int64)
        for i, x in enumerate(before):
            earlier[i, : len(x)] = [names[s] for s in x]
        if walk:
            near, links = t.column("near").to_pylist(), []
            for i in order.tolist():
                x = np.array(sorted(near[i] or ()), np.int64)
                at = np.searchsorted(ids, x)
                links.append(at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == x)])
            pairs = search(u, links, threshold)
        else:
            pairs = exhaustive(u, threshold)
        n, around = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in pairs:
                new = np.ones(len(a), bool)
                for k in range(wide):
                    for m in range(wide):
                        new &= (earlier[a, k] != earlier[b, m]) | (earlier[a, k] < 0)
                n[:] += np.bincount(a[new], minlength=len(ids))
                around[:] += np.bincount(a[new], copies[b[new]], len(ids)).astype(np.int64)
                yield a, b

        least = ids[forest(len(ids), counted())]
        some = (n > 0) | (least != ids)
        return pa.table({"id": ids[some], "links": n[some], "around": around[some], "least": least[some]})

    return run


def linked(rows: DataFrame, threshold: float = 0.9, shard: int = SHARD, most: int = SHARD_MOST, overlap: int = OVERLAP, walk: bool = True) -> DataFrame:
    """(id, links, around, least) for the different vectors ``rows`` (id, v, copies) and each shard in which it is linked.

    ``links`` and ``around`` add up, over shards, to the number of other vectors at cosine ``threshold`` or more, verified in double precision, and
    of their copies; ``least`` ties the vector to another one. So a group of near copies gives rows for its members, not for its
    pairs. With ``walk`` each shard builds a graph, a vector's adjacency lists from all its shards are united, and every shard is searched
    along the united lists; without, all vectors of a shard are compared.
    """
    dealt = checkpointed(shards(rows.select("id", "v"), shard, most, overlap, walk))
    own = dealt.groupBy("id").agg(F.collect_set("shard").alias("shards")).join(rows.select("id", "copies"), "id")
    ready = dealt.join(own, "id")
    if walk:
        edges = dealt.groupBy("shard").applyInArrow(_build_shard, "src long, dst long")
        union = edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("near"))
        ready = ready.join(union, "id", "left")
    return ready.groupBy("shard").applyInArrow(_search_shard(threshold, walk), _FOUND)


def audit(rows: DataFrame, found: DataFrame, threshold: float, queries: int = AUDIT) -> tuple[int, int]:
    """(links found, true links) of ``queries`` vectors, chosen by a hash and compared with all others."""
    q = rows.select("id", "v", F.size("v").alias("n")).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(queries).toArrow()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for s in set(q.column("n").to_pylist()):
        part = q.filter(pc.equal(q.column("n"), s))
        by_size[s] = part.column("id").to_numpy(), unit(_matrix(part.column("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for s, (ids, u) in by_size.items():
                take = pa.array(np.flatnonzero(size == s))
                if len(take):
                    near = u @ unit(_matrix(b.column(1).take(take))).T >= threshold
                    near &= ids[:, None] != b.column(0).take(take).to_numpy()[None]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.sum(axis=1))], names=["id", "n"])

    true = rows.select("id", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = found.groupBy("id").agg(F.sum("links").alias("links"))
    r = true.join(got, "id", "left").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return r["links"], r["n"]


def usable(v: str) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that isn't zero."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, least_recall: float = 0.9, shard: int = SHARD, most: int = SHARD_MOST) -> DataFrame:
    """(id_col, n_links, component_id, kept, audited_recall, audited_links) for every row of ``vectors``.

    Equal vectors become one before the graph is built. Links are symmetric; ``n_links`` counts
    other rows, copies included. Where the audit finds less than ``least_recall``
    of the true links, the index is built once more with twice the overlap, and after that all vectors are compared;
    ``audited_links`` is the number of true links that the audit knows of (null recall without any). Vectors that are null, zero,
    or hold null or non-finite components link with nothing; others link with those of their own length. Repeated ids are rows of their
    own that are counted as copies; a null id links, but is never a component's
    id unless it is alone. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = checkpointed(rows.withColumn("ok", usable("v"))).withColumn("row", F.monotonically_increasing_id())
    sound = rows.where("ok").select("row", F.col("id").alias("own"), F.xxhash64("v").alias("one"), F.xxhash64(F.lit(7), "v").alias("two"))
    groups = sound.groupBy("one", "two").agg(F.min("row").alias("id"), F.min("own").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    members = checkpointed(sound.join(groups, ["one", "two"]).select("row", "own", "id", "least_id", "copies"))
    heads = members.where("row = id").select("id", "least_id", "copies")
    distinct = checkpointed(rows.where("ok").select("row", "v").join(heads, F.col("row") == F.col("id")).select("id", "v", "copies"))
    recall, true = None, 0
    for overlap, walk in ((OVERLAP, True), (2 * OVERLAP, True), (1, False)):
        if walk:
            found = checkpointed(linked(distinct, threshold, shard, most, overlap))
        else:  # one shard, in tiles that all pairs meet in
            found = checkpointed(linked(distinct, threshold, 1 << 62, most, 1, walk=False))
        hit, true = audit(distinct, found, threshold)
        recall = hit / true if true else None
        if recall is None or recall >= least_recall:
            break
    sums = found.groupBy("id").agg(F.sum("around").alias("around"))
    tied = connected_components(found.select("id", "least"), "id", "least")
    labels = heads.join(tied, heads["id"] == tied["node"], "left").withColumn("component", F.coalesce("component", "id"))
    roots = labels.groupBy("component").agg(F.min("least_id").alias("root"))
    labels = labels.join(roots, "component").join(sums, "id", "left").select("id", "root", F.coalesce("around", F.lit(0)).alias("around"))
    mine = members.join(labels, "id").select("row", (F.col("copies") - 1 + F.col("around")).alias("n_links"), "root")
    out = rows.select("row", "id").join(mine, "row", "left")
    component = F.coalesce(F.when(F.col("n_links") > 0, F.col("root")), F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"),
        F.lit(true).cast("long").alias("audited_links"),
    )
