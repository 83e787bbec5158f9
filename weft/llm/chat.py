"""Chat formatting by token-level assembly."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LOT, lots

#: Control strings in the order of their reserved ids, which follow the vocabulary.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: The pre-tokenization pattern of the 50k byte-level vocabularies: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TURN = "conv_id long, turn long, ids array<int>, loss array<tinyint>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\+)\|")
_loaded: dict[str, tuple] = {}


def escape(text: str) -> str:
    """No ``<|`` is left, so no control string; one more backslash in every ``<\\...|`` keeps it reversible."""
    return _OPEN.sub(lambda m: "<" + m[1] + "\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1][1:] + "|", text)


def tokenizer(path: str):
    """(encoding, first reserved id) of a file of base64 tokens and ranks; read once in each process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        free = max(ranks.values()) + 2  # the id after the last rank is the vocabulary's own end of text
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), free
    return _loaded[path]


def assemble(role: str, text: str, path: str, learned: tuple[str, ...]) -> tuple[list[int], np.ndarray]:
    """Ids of one turn and its loss mask.

    Role and text are encoded apart, so that no token spans a boundary, and
    the reserved ids are spliced between. The mask is the prefix sum of +1
    where a learned text starts and -1 where it ends.
    """
    enc, free = tokenizer(path)
    head, body = enc.encode_ordinary(escape(role)), enc.encode_ordinary(escape(text))
    ids = [free, *head, free + 1, *body, free + 2]
    step = np.zeros(len(ids) + 1, np.int8)
    if role in learned:
        step[len(head) + 2] += 1
        step[len(head) + 2 + len(body)] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8)


def format_turns(
    turns: DataFrame,
    vocabulary: str = VOCABULARY,
    learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """(conv_id, turn, ids, loss): the tokens of every row of ``turns``, with 1 in ``loss`` under the mask.

    A conversation's tokens are those of its rows by turn (ties by ids), one
    after the other; rows stay apart, so that no conversation has to fit into
    one task. A null role or text is empty; null ids and turns stay null and
    sort first; repeated rows are repeated; other columns are not read. The
    vocabulary file must be at the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (y for whole in batches for x in lots(whole, 3, LOT) for y in lots(x, 2, LOT)):
            made = [assemble(r or "", t or "", vocabulary, learned) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            ids = pa.array([x for x, _ in made], pa.list_(pa.int32()))
            loss = pa.array([m for _, m in made], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, loss], names=["conv_id", "turn", "ids", "loss"])

    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return kept.mapInArrow(run, TURN)


def read_turn(ids: list[int], loss: list[int], path: str) -> tuple[str, str, str, int]:
    """(role, text, learned text, code points of the formatted turn), from the tokens alone."""
    enc, free = tokenizer(path)
    if ids[0] != free or ids[-1] != free + 2 or ids.count(free + 1) != 1:
        raise ValueError("not a formatted turn")
    sep = ids.index(free + 1)
    role, text = enc.decode(ids[1:sep]), enc.decode(ids[sep + 1 : -1])
    under = enc.decode([x for x, m in zip(ids, loss, strict=True) if m])
    return unescape(role), unescape(text), unescape(under), len(role) + len(text) + sum(map(len, CONTROL))


def digests(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): what each conversation says, read back from its tokens.

    Rows are dealt by conversation and sorted by turn, equal turns by their ids; each task reads them as a stream
    and holds two running digests and one turn, however long a conversation is. Rows with a null
    conv_id are one conversation, null turns come first, repeated rows count each time. A conversation
    without learned text has the digest of nothing; an empty table gives an empty result.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None

        def done() -> tuple:
            n, turns, chars, learned, size = state
            return current, n, turns.hexdigest(), chars, learned.hexdigest(), size

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            rows = []
            for conv, ids, loss in (row for part in lots(b, 2, LOT // 4) for row in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if state is not None and conv != current:
                    rows.append(done())
                    state = None
                if state is None:
                    state, current = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                role, text, under, size = read_turn(ids, loss, vocabulary)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += size
            if rows:
                yield batch(rows)
        if state is not None:
            yield batch([done()])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
