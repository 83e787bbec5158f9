"""Repair of the role structure of conversations by dynamic programming over a trie of their signatures.

A conversation's rows become a signature, one letter for each row: what its role allows and
whether it has to go or is truncated. Distinct signatures are sorted, so that each shares
its longest prefix with its neighbour, and walked as a trie depth-first: a layer of the
dynamic program belongs to a node, is computed once for all signatures through it,
and a terminal node reads off its answer. Signatures are cut into chunks of
``CHUNK`` rows; a chunk's answer holds for each state it can start from, and a
conversation composes its chunks, so that no walk grows with a long conversation.

States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LOT, checkpointed, lots

#: Costs of the edits, and of keeping a truncated row.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a signature at most.
CHUNK = 1024
SPACE = " \t\n\x0b\f\r"
#: What a state takes next, besides a system row at the start, and what closes it.
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_CLOSE = {0: "", 1: "II", 2: "I", 3: ""}
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


# Faults ---------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults planted by the checksum of conv_id and turn modulo 20.

    0 drops the row, 1 empties its text, 2 takes out full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. Nulls count as a space.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("k"))
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy"))
    return out.drop("copy")


def _ended(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def _plain(turns: DataFrame) -> DataFrame:
    """The rows, null roles and texts as a space, with the digest that orders rows of one turn and role."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))


def signatures(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, sig, low, high, turns, blank, duplicate, truncated, illegal): letters and counts of each chunk of a conversation's rows.

    A row's letter is x if it has to go (blank or duplicate), else the first of its role (o: not s, u or a), a capital
    if it is truncated. First places of repeated (role, text) are found by an aggregation, and
    texts stay where they are; the rows are dealt by conversation and read as a stream.
    """
    rows = _plain(turns).withColumn("end", _ended(F.col("text"))).drop("text")
    first, n = F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")
    twice = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(first, n).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.coalesce(F.col("first") < F.struct("turn"), F.lit(False)).alias("later")
    marked = rows.join(twice, same, "left").select("conv_id", "turn", "role", "digest", "end", later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "chunk", "sig", "low", "high", "turns", *_COUNTS]
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 7]
        chunk, letters, count, before, place = 0, [], {}, None, (None, None)

        def take() -> tuple:
            out = (before[0], chunk, "".join(letters), count.get("low"), count.get("high"), *(count.get(k, 0) for k in ("turns", *_COUNTS)))
            letters.clear(), count.clear()
            return out

        for b in batches:
            out = []
            for conv, turn, role, digest, end, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = before is None or before[0] != conv
                if letters and (new or len(letters) == CHUNK):
                    out.append(take())
                    chunk += 1
                if new:
                    chunk, place = 0, (None, None)
                initial = role[:1]
                fault = "blank" if end == "" else "duplicate" if again or (not new and before[:4] == (conv, turn, role, digest)) else "truncated" if end not in ".!?" else ""
                if fault:
                    count[fault] = count.get(fault, 0) + 1
                if not new and before[2][:1] + initial not in ("su", "ua", "au"):
                    count["illegal"] = count.get("illegal", 0) + 1
                if turn is not None:
                    count.setdefault("low", turn)
                    count["high"] = turn
                    if place != (conv, turn):
                        count["turns"] = count.get("turns", 0) + 1
                        place = (conv, turn)
                letter = initial if initial in ("s", "u", "a") else "o"
                letters.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
                before = (conv, turn, role, digest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if letters:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(take(), kinds, strict=True)], names=names)

    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return dealt.mapInArrow(run, f"conv_id long, chunk int, sig string, low long, high long, turns long, {', '.join(f'{c} long' for c in _COUNTS)}")


# The dynamic program --------------------------------------------------------------


def _moves(letter: str, state: int) -> dict[int, tuple[int, str]]:
    """Cheapest edits of one row, with inserted rows before it, by the state they lead to; ties by the edits' letters."""
    out: dict[int, tuple[int, str]] = {}
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    for inserted in range(3):
        options = [(state, DELETE, "D")]
        if letter != "x":
            options.append((_NEXT[state], RETYPE + extra, "R"))
            if role == "s" and state == 0:
                options.append((1, extra, "K"))
            elif (role, _NEXT[state]) in (("u", 2), ("a", 3)):
                options.append((_NEXT[state], extra, "K"))
        for to, cost, edit in options:
            new = (cost + inserted * INSERT, "I" * inserted + edit)
            out[to] = min(out.get(to, new), new)
        state = _NEXT[state]
    return out


MOVES = {letter: [_moves(letter, state) for state in range(4)] for letter in "xsuaoSUAO"}
#: A layer: by state (cost, rank of the edits so far, state before, edits since).
Layer = dict[int, tuple[int, int, int, str]]


def step(layer: Layer, options: list[dict[int, tuple[int, str]]]) -> Layer:
    """The next layer. Edits that end with a row's edit are no prefixes of each other, so ranks and the last edits decide ties."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for state, (cost, rank, _, _) in layer.items():
        for to, (more, edits) in options[state].items():
            new = (cost + more, rank, edits, state)
            if to not in best or new < best[to]:
                best[to] = new
    order = sorted(best, key=lambda to: best[to][1:3])
    return {to: (best[to][0], order.index(to), best[to][3], best[to][2]) for to in best}


def _edits(layers: list[Layer], state: int) -> str:
    out = []
    for layer in reversed(layers[1:]):
        _, _, state, edits = layer[state]
        out.append(edits)
    return "".join(reversed(out))


def walk(sigs: Iterator[str], starts: tuple[int, ...]) -> Iterator[list[tuple[int, int, int, str]]]:
    """For each of the sorted signatures (start, end, cost, edits); layers of a prefix shared with the one before are reused."""
    stacks = [[{s: (0, 0, s, "")}] for s in starts]
    before = ""
    for sig in sigs:
        n = min(len(sig), len(before))
        shared = next((i for i in range(n) if sig[i] != before[i]), n)
        out = []
        for start, stack in zip(starts, stacks, strict=True):
            del stack[shared + 1 :]
            for letter in sig[shared:]:
                stack.append(step(stack[-1], MOVES[letter]))
            out += [(start, end, cost, _edits(stack, end)) for end, (cost, _, _, _) in sorted(stack[-1].items())]
        yield out
        before = sig


def answers(sigs: DataFrame) -> DataFrame:
    """(sig, opens, ways): the cheapest edits of each distinct signature between all states; one that opens a conversation starts with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
        walks: dict[bool, tuple[list, Iterator]] = {}
        for opens, starts in ((True, (0,)), (False, (0, 1, 2, 3))):
            queue: list[str] = []
            walks[opens] = queue, walk(iter(queue.pop, None), starts)
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                ways = []
                for sig, opens in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    queue, steps = walks[opens]
                    queue.append(sig)
                    ways.append([dict(zip(("start", "end", "cost", "edits"), w, strict=True)) for w in next(steps)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ways, way)], names=["sig", "opens", "ways"])

    distinct = sigs.select("sig", (F.col("chunk") == 0).alias("opens")).distinct()
    ordered = distinct.repartitionByRange("opens", "sig").sortWithinPartitions("opens", "sig")
    return ordered.mapInArrow(run, "sig string, opens boolean, ways array<struct<start int, end int, cost long, edits string>>")


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    sigs = checkpointed(signatures(turns))
    found = sigs.withColumn("opens", F.col("chunk") == 0).join(answers(sigs), ["sig", "opens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, layers, current = None, [], False

        def done() -> tuple:
            ends = {state: (cost + INSERT * len(_CLOSE[state]), rank) for state, (cost, rank, _, _) in layers[-1].items()}
            state = min(ends, key=ends.get)
            return conv, ends[state][0], _edits(layers, state) + _CLOSE[state]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "cost", "audit"])

        for b in batches:
            rows = []
            for c, ways in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if current and c != conv:
                    rows.append(done())
                if not current or c != conv:
                    conv, layers, current = c, [{0: (0, 0, 0, "")}], True
                options: list[dict] = [{} for _ in range(4)]
                for w in ways.as_py():
                    options[w["start"]][w["end"]] = (w["cost"], w["edits"])
                layers.append(step(layers[-1], options))
            if rows:
                yield batch(rows)
        if current:
            yield batch([done()])

    composed = found.select("conv_id", "chunk", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, "conv_id long, cost long, audit string")
    span = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    counts = sigs.groupBy("conv_id").agg(span, *(F.sum(c).alias(c) for c in _COUNTS))
    composed = composed.withColumnRenamed("conv_id", "c")
    return counts.join(composed, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


# Repaired conversations -----------------------------------------------------------


def repaired(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) of the conversations after the edits of ``audit``; inserted rows have an empty text.

    The edits go ahead of a conversation's rows, which a task reads as a stream.
    """
    rows = _plain(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    none = F.lit(None).cast("string")
    heads = audit.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("digest"), F.col("audit").alias("text"))
    said = {2: "user", 3: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, at, state, position = None, "", 0, 0, 0

        def put(role: str, text: str) -> tuple:
            nonlocal state, position
            state = 1 if state == 0 and role[:1] == "s" else _NEXT[state]
            position += 1
            return conv, position - 1, role, text

        for whole in batches:
            for b in lots(whole, 3, LOT):
                out: list[tuple] = []
                for c, kind, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if kind == 0:
                        out += [put(said[_NEXT[state]], "") for _ in edits[at:]]
                        conv, edits, at, state, position = c, text, 0, 0, 0
                        continue
                    while edits[at] == "I":
                        out.append(put(said[_NEXT[state]], ""))
                        at += 1
                    if edits[at] != "D":
                        out.append(put(role if edits[at] == "K" else said[_NEXT[state]], text))
                    at += 1
                yield _batch(out)
        yield _batch([put(said[_NEXT[state]], "") for _ in edits[at:]])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["conv_id", "position", "role", "text"])

    dealt = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(run, "conv_id long, position long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): lowercase hex of `role:text` of a conversation's rows by position, joined by newlines; read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for whole in batches:
            for b in lots(whole, 3, LOT):
                ids, shas = [], []
                for c, _, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if sha is not None and c != conv:
                        ids.append(conv), shas.append(sha.hexdigest())
                        sha = None
                    if sha is None:
                        conv, sha = c, hashlib.sha256()
                    else:
                        sha.update(b"\n")
                    sha.update(f"{role}:{text}".encode())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas)], names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of ``turns`` or of ``ids``.

    Rows are taken by turn, nulls first; rows of one turn by role and the digest of their text. The first fault of a row counts: blank (white space
    only), duplicate (role and text as in an earlier row), truncated (does not end with a full stop, exclamation or question mark).
    ``audit`` has the initials of the cheapest edits (Keep, Rerole, Delete, Insert) that leave
    an optional system row and then user and assistant rows in turn, or nothing; of equal costs the least in ASCII order.
    ``illegal`` counts neighbours other than su, ua and au; ``gaps`` the turns that lack between the least and the greatest.

    Null roles and texts count as a space, so such a text is blank and such a role has to be changed or to go. Rows with a null conv_id are one conversation.
    Repeated rows are duplicates. A conversation in ``ids`` without rows has zeros, an empty audit and the digest of nothing. A long conversation
    is read as a stream by one task, since its digest is a running one; its edits are one string in that task. Other columns are not read; an empty table gives an empty result.
    """
    found = checkpointed(audits(turns))
    shas = digests(repaired(turns, found.select("conv_id", "audit")))
    every = (turns if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    out = out.join(shas.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    nothing = hashlib.sha256().hexdigest()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
