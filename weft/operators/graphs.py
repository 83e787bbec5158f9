"""Property graphs as two tables: nodes (node_id, node_type, label, ...) and edges (src, dst, edge_type, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import short_hash
from weft.operators.lineage import cut


def node_id(node_type: str, label: Column) -> Column:
    return F.concat(F.lit(f"{node_type}:"), short_hash(label))


def edge_id(edge_type: str, src: Column, dst: Column) -> Column:
    return F.concat(F.lit(f"edge:{edge_type}:"), short_hash(src), F.lit(":"), short_hash(dst))


def mentions(rows: DataFrame, node_type: str, label: Column, paper: Column, evidence: Column, cut_at: int = 50) -> DataFrame:
    """(node_id, node_type, label, paper_id, evidence_id): where each label that isn't missing or unknown is said, every place once.

    This edge table is the provenance of the nodes; it stays flat, so that a label that all papers have is many
    short rows instead of one long one. Labels are cut to ``cut_at`` characters. Null papers or evidence stay null.
    """
    key = F.left(label, F.lit(cut_at))
    known = rows.where(F.coalesce((F.trim(label) != "") & (F.lower(label) != "unknown"), F.lit(False)))
    return known.select(node_id(node_type, key).alias("node_id"), F.lit(node_type).alias("node_type"), key.alias("label"), paper.alias("paper_id"), evidence.alias("evidence_id")).distinct()


def counted(said: DataFrame) -> DataFrame:
    """(node_id, node_type, label, papers, evidence): nodes with the numbers of different papers and pieces of evidence of their mentions."""
    return said.groupBy("node_id", "node_type").agg(F.min("label").alias("label"), F.count_distinct("paper_id").alias("papers"), F.count_distinct("evidence_id").alias("evidence"))


def edge_mentions(rows: DataFrame, edge_type: str, src: Column, dst: Column, evidence: Column) -> DataFrame:
    """(edge_id, edge_type, src, dst, evidence_id): the evidence of each edge, every piece once; rows without either end are passed over."""
    each = rows.where(src.isNotNull() & dst.isNotNull()).select(src.alias("src"), dst.alias("dst"), evidence.alias("evidence_id")).distinct()
    return each.select(edge_id(edge_type, F.col("src"), F.col("dst")).alias("edge_id"), F.lit(edge_type).alias("edge_type"), "src", "dst", "evidence_id")


def merge_graphs(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Mentions of both, of nodes or of edges, each once; columns that only one side has are null in the other's rows."""
    return base.unionByName(delta, allowMissingColumns=True).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, ...): each edge in either direction."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *rest).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *rest))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = both_ways(edges.select("src", "dst")).groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, F.col("node_id") == F.col("a"), "left").select(*nodes.columns, F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, node, hop): nodes within at most two hops of each seed, the seed itself at 0, by level-wise joins.

    Of the edges only those at the nodes of a level are made distinct and joined.
    """
    every = both_ways(edges.select("src", "dst")).select("a", "b")
    seen = seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, min(max(hops, 0), 2) + 1):
        adj = every.join(front.select(F.col("node").alias("a")).distinct(), "a", "left_semi").distinct()
        step = front.join(adj, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        front = step.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def paths(pairs: DataFrame, edges: DataFrame, most_hops: int = 3, most: int = 10) -> DataFrame:
    """(src, dst, path array, hops): simple undirected paths between each pair (src, dst), shortest first, at most ``most`` a pair.

    Paths grow from both ends of the stated pairs, each half of the hops, and meet in the middle; no longer once a pair
    has ``most`` shorter ones. Equal ends give the trivial path.
    """
    every = both_ways(edges.select("src", "dst")).select("a", "b")
    asked = pairs.select("src", "dst").distinct()
    done = asked.where("src = dst").select("src", "dst", F.array("src").alias("path")).withColumn("hops", F.lit(0))
    last = F.element_at("path", -1)
    halves = {end: [asked.where("src <> dst").select("src", "dst", F.array(end).alias("path"))] for end in ("src", "dst")}

    def grown(half: DataFrame) -> DataFrame:
        near = every.join(half.select(last.alias("a")).distinct(), "a", "left_semi").distinct()
        longer = half.join(near, last == F.col("a")).where(~F.array_contains("path", F.col("b")))
        return longer.select("src", "dst", F.concat("path", F.array("b")).alias("path"))

    for hop in range(1, most_hops + 1):
        end = "src" if hop % 2 else "dst"
        halves[end].append(grown(halves[end][-1]))
        full = done.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("src", "dst")
        left = halves["src"][-1].join(full, ["src", "dst"], "left_anti").withColumn("at", last)
        right = halves["dst"][-1].select("src", "dst", F.col("path").alias("rest"), last.alias("at"))
        met = left.join(right, ["src", "dst", "at"])
        path = F.concat("path", F.slice(F.reverse("rest"), F.lit(2), F.size("rest")))
        met = met.select("src", "dst", path.alias("path")).where(F.size(F.array_distinct("path")) == F.size("path"))
        done = done.unionByName(met.withColumn("hops", F.lit(hop)))
    w = Window.partitionBy("src", "dst").orderBy("hops", "path")
    return done.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node_id, community, settled): labels such that no settled node has its label less often around it than another one.

    A node takes the most frequent label around it, the least of ties, if its own is rarer. Rounds let labels become smaller and
    larger in turns, and from the sixteenth on about half of the nodes, by a hash of their id and the round, so that neighbours don't swap labels for ever. Each round is one
    join and one aggregation with a checkpoint behind it. After ``rounds`` the labels are returned as they are, with the nodes that would still change not settled. Isolated
    nodes keep their own label; edges to nodes that don't exist count for nothing.
    """
    adj = cut(both_ways(edges.select("src", "dst")).select("a", "b").distinct())
    label = cut(nodes.select("node_id", F.col("node_id").alias("community")).distinct())
    for k in range(rounds):
        votes = adj.join(label, F.col("b") == F.col("node_id")).groupBy("a", "community").agg(F.count(F.lit(1)).alias("n"))
        mine = label.select(F.col("node_id").alias("a"), F.col("community").alias("own"))
        best = votes.join(mine, "a").groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("top"), F.max(F.when(F.col("community") == F.col("own"), F.col("n"))).alias("have"))
        wants = -F.col("top.n") > F.coalesce("have", F.lit(0))
        best = best.where(wants).select("a", F.col("top.community").alias("new"))
        new = label.join(best, F.col("node_id") == F.col("a"), "left")
        may = (F.col("new") < F.col("community")) == F.lit(k % 2 == 0)
        may = may if k < 16 else may & (F.pmod(F.xxhash64("a", F.lit(k)), F.lit(2)) == 0)
        new = cut(new.select("node_id", F.when(may, F.col("new")).otherwise(F.col("community")).alias("community"), F.col("new").isNotNull().alias("restless")))
        label = new.select("node_id", "community")
        if new.where("restless").isEmpty():
            break
    return new.select("node_id", "community", (~F.col("restless")).alias("settled")) if rounds else label.withColumn("settled", F.lit(False))


def without_paper(said: DataFrame, edges: DataFrame, paper: object) -> tuple[DataFrame, DataFrame]:
    """Mentions and edges after a paper is taken out; nodes that only it mentioned go, with their edges, communities excepted."""
    left = said.where(~F.col("paper_id").eqNullSafe(F.lit(paper)))
    gone = said.where((F.col("paper_id") == F.lit(paper)) & (F.col("node_type") != "community")).select("node_id").distinct()
    gone = gone.join(left, "node_id", "left_anti")
    e = edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return left, e.select(*edges.columns)


def contracted(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after nodes became others: ``merged`` is (node_id, into). Loops and repeated edges go."""
    m = merged.select("node_id", "into")
    e = edges.join(m.select(F.col("node_id").alias("src"), F.col("into").alias("_s")), "src", "left").join(m.select(F.col("node_id").alias("dst"), F.col("into").alias("_d")), "dst", "left")
    return e.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "edge_type").where("src <> dst").distinct()


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): counts by node type and edge type, and isolated nodes."""
    kinds = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.col("node_type").alias("name"), "n")
    links = edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.col("edge_type").alias("name"), "n")
    alone = degrees(nodes, edges).agg(F.count_if(F.col("degree") == 0).alias("n")).select(F.lit("isolated").alias("kind"), F.lit("all").alias("name"), "n")
    return kinds.union(links).union(alone)


def missing_pairs(left: DataFrame, right: DataFrame, together: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(first ``most`` pairs that don't occur together, one row with the number of all such pairs).

    The number is that of all pairs less that of those together, so that pairs are
    never made to be counted; the first ones are looked for in the first values of the
    left side, enough of which are taken to hold ``most`` missing pairs whatever is together.
    """
    t = together.select("l", "r").distinct().join(left.select("l"), "l", "left_semi").join(right.select("r"), "r", "left_semi")
    nl, nr, nt = (x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((left.select("l").distinct(), "a"), (right.select("r").distinct(), "b"), (t, "c")))
    total = nl.crossJoin(nr).crossJoin(nt).select((F.col("a") * F.col("b") - F.col("c")).alias("n_missing"))
    have = t.groupBy("l").agg(F.count(F.lit(1)).alias("have"))
    gap = left.select("l").distinct().join(have, "l", "left").crossJoin(nr).where(F.col("b") > F.coalesce("have", F.lit(0)))
    some = gap.select("l").orderBy("l").limit(most)
    # Only the first of the right side matter: as many as the most that one of these can have, and those missing.
    room = some.join(have, "l", "left").agg((F.coalesce(F.max("have"), F.lit(0)) + most).alias("room"))
    rights = right.select("r").distinct()
    rights = rights.orderBy("r").limit(room.first()["room"])
    pairs = rights.crossJoin(some).join(t, ["l", "r"], "left_anti")
    return pairs.select("l", "r").orderBy("l", "r").limit(most), total
