"""SentencePiece encoding and decoding with forward states shared along a trie of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LOT, lots  # as many new words are sorted together

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A marked word: a run of marks and what follows up to the next mark or, where no longer piece holds one, newline.
_WORD = regex.compile(f"{MARK}+[^{MARK}]*+|[^{MARK}]++")
_WORD_OF_LINE = regex.compile(f"{MARK}+[^{MARK}\n]*+|[^{MARK}\n]++|\n")
#: Words whose ids a process remembers; beyond that it forgets those that it met least lately.
REMEMBERED = 90_000
UNIGRAM, BPE = 1, 2
_loaded: dict[str, Pieces] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[i : i + n]
            i += n


class Pieces:
    """A SentencePiece model file: pieces, scores and the segmentation of marked words.

    Two kinds of model. In a unigram model the best segmentation maximises the
    sum of scores, and a word's forward state at each position is the best sum
    and last piece. In a BPE model scores are merge ranks, whose sum says
    nothing; there the state at a position is the last piece of the prefix's
    own merge result, the only piece ending there that is stable beside the
    state where it begins. Either state depends on the prefix alone, so that
    words in sorted order (a depth-first walk of their trie) compute states for
    the characters after the prefix shared with the word before.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kind = UNIGRAM
        self.dummy_prefix = True
        self.byte_id = [-1] * 256
        self.ids: dict[str, int] = {}
        self.unk = 0
        for n, value in _fields(raw):
            if n == 1:
                parts = dict(_fields(value))
                piece, kind = parts[1].decode(), parts.get(3, 1)
                i = len(self.pieces)
                self.pieces.append(piece)
                self.scores.append(float(np.frombuffer(parts.get(2, b"\0" * 4), "<f4")[0]))
                if kind == 6:
                    self.byte_id[int(piece[3:5], 16)] = i
                elif kind == 2:
                    self.unk = i
                elif kind in (1, 4):
                    self.ids[piece] = i
            elif n == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif n == 3:
                self.dummy_prefix = bool(dict(_fields(value)).get(3, 1))
        self.byte_of = {i: b for b, i in enumerate(self.byte_id) if i >= 0}
        self.longest = max(map(len, self.ids))
        self.word = _WORD if any("\n" in p and len(p) > 1 for p in self.ids) else _WORD_OF_LINE
        self.worst = min(self.scores) - 10
        # The pieces' trie: a node has its children by character and, under "", the piece that ends there.
        self.trie: dict[str, object] = {}
        self.packed: dict[str, bytes] = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
            self.packed[piece] = pack("<i", i)
        self._stable: dict[tuple[str, str], bool] = {}
        self._memory: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    # Segmentation of one word ------------------------------------------------

    def merged(self, word: str) -> list[str]:
        """The merge procedure itself: best-scored adjacent pair first, the leftmost of ties.

        Pairs wait in a heap; one is stale if either part has been merged since. So a word takes n log n steps.
        """
        parts: list[str] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int]] = []

        def wait(k: int) -> None:
            j = after[k]
            if j < len(parts):
                i = self.ids.get(parts[k] + parts[j])
                if i is not None:
                    heappush(heap, (-self.scores[i], k, i))

        for k in range(len(parts) - 1):
            wait(k)
        while heap:
            _, k, i = heappop(heap)
            j = after[k]
            if not parts[k] or j >= len(parts) or parts[k] + parts[j] != self.pieces[i]:
                continue
            parts[k], parts[j] = self.pieces[i], ""
            after[k] = after[j]
            if after[k] < len(parts):
                before[after[k]] = k
            wait(k)
            if before[k] >= 0:
                wait(before[k])
        return [p for p in parts if p]

    def _beside(self, left: str, right: str) -> bool:
        """Merging ``left + right`` gives just these two pieces."""
        key = (left, right)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 2 * REMEMBERED:
                self._stable.clear()
            known = self._stable[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Pieces of each of the distinct ``words``, which are visited in sorted order."""
        before = ""
        last: list[str] = [""]  # last[i]: the piece that ends at character i
        state: list = [() if self.kind == BPE else 0.0]
        step = self._extend_merged if self.kind == BPE else self._extend_best
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], state[shared + 1 :]
            step(word, last, state)
            parts, i = [], len(word)
            while i:
                parts.append(last[i])
                i -= len(last[i])
            parts.reverse()
            yield word, parts
            before = word

    def _extend_merged(self, word: str, last: list[str], state: list) -> None:
        """State: the places in the pieces' trie that the pieces which may still end later have come to."""
        root, stable, beside = self.trie, self._stable, self._beside
        for end in range(len(last), len(word) + 1):
            c = word[end - 1]
            found, open_ = "", []
            for start, node in state[end - 1]:
                node = node.get(c)
                if node is not None:
                    open_.append((start, node))
                    if not found and "" in node:
                        piece = node[""]
                        known = stable.get((last[start], piece))
                        if known or known is None and beside(last[start], piece):
                            found = piece
            node = root.get(c)
            if node is not None:
                open_.append((end - 1, node))
            last.append(found or c)
            state.append(open_)

    def _extend_best(self, word: str, last: list[str], score: list) -> None:
        for end in range(len(last), len(word) + 1):
            piece, total = self._last_best(word, end, score)
            last.append(piece)
            score.append(total)

    def _last_best(self, word: str, end: int, score: list[float]) -> tuple[str, float]:
        best, total = word[end - 1 : end], score[end - 1] + self.worst
        for start in range(max(0, end - self.longest), end):
            i = self.ids.get(word[start:end])
            if i is not None and score[start] + self.scores[i] > total:
                best, total = word[start:end], score[start] + self.scores[i]
        return best, total

    def _to_ids(self, parts: list[str]) -> bytes:
        known = self.packed
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:  # characters without a piece: their bytes, if the model has those
            spelt = [known.get(p) or b"".join(pack("<i", self.byte_id[b] if self.byte_id[b] >= 0 else self.unk) for b in (p.encode() if self.byte_id[0] >= 0 else b"?")) for p in parts]
            return b"".join(spelt)

    # Texts -------------------------------------------------------------------

    def marked(self, text: str) -> list[str]:
        """Marked words of one text, which joined give the text with marks for spaces."""
        return self.word.findall((MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. A U+2581 of the text itself is written as its three bytes, so that decoding gives it back."""
        own = pack("<3i", *[self.byte_id[b] for b in MARK.encode()])
        apart = self.byte_id[MARK.encode()[0]] >= 0
        split = []
        for t in texts:
            if apart and MARK in t:
                first, *rest = t.split(MARK)
                split.append([self.marked(first) if first else [MARK] * self.dummy_prefix, *[self.word.findall(x.replace(" ", MARK)) for x in rest]])
            else:
                split.append([self.marked(t)])
        self._learn({w for parts in split for words in parts for w in words})
        known = self._memory.__getitem__
        return [np.frombuffer(own.join([b"".join(map(known, words)) for words in parts]), "<i4") for parts in split]

    def _learn(self, words: set[str]) -> None:
        """Have the ids of all ``words`` in memory."""
        memory, older = self._memory, self._older
        if len(memory) > REMEMBERED:
            self._memory, self._older = memory, older = {}, memory
        new = []
        for w in words:
            if w not in memory:
                x = older.get(w)
                if x is None:
                    new.append(w)
                else:
                    memory[w] = x
        # Runs of marks have pieces of equal score, between which the place decides.
        runs = {w for w in new if self.kind == BPE and w.startswith(MARK * 2)}
        for w in runs:
            memory[w] = self._to_ids(self.merged(w))
        for w, parts in self.segment([w for w in new if w not in runs]):
            memory[w] = self._to_ids(parts)

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def model(path: str) -> Pieces:
    """The model of a file; read once in each process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """(id_col, ids array<int>): the pieces of every row's whole text.

    Equal to what the sentencepiece library gives for the model, but for texts
    that hold U+2581 themselves. Narrow: each Arrow batch's new distinct words
    are walked in sorted order, so nothing is shuffled and memory is bounded by a batch and
    ``REMEMBERED`` words. Null and empty texts have no pieces; null ids and
    repeated rows are kept; other columns are not read. The model file must be
    at the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            for part in lots(b, 1, LOT):
                made = m.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(made)], names=[id_col, "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", model_path: str = MODEL) -> DataFrame:
    """(id_col, text string): the texts that ``encoded.ids`` stand for; null ids arrays give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            texts = [m.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, with_ids: bool = False) -> DataFrame:
    """(id_col, n_pieces, ids_sha256 over little-endian 32-bit ids, decoded_sha256, decoded_chars), and ids if asked for.

    Each text is encoded as by :func:`encode` and decoded again from its ids in the same pass, so that neither
    texts nor ids leave the worker. Null and empty texts have no pieces and the digests of nothing; null ids and
    repeated rows are kept; an empty table gives an empty result; other columns are not read.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["n_pieces", "ids_sha256", "decoded_sha256", "decoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for part in (x for b in batches for x in lots(b, 1, LOT)):
            made = m.encode_batch([t or "" for t in part.column(1).to_pylist()])
            rows = []
            for ids in made:
                text = m.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(text)))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            out = [_lists(made)] if with_ids else []
            yield pa.RecordBatch.from_arrays([part.column(0), *out, *cols], names=[id_col, *["ids"] * with_ids, *names])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"`{id_col}` long, {'ids array<int>, ' * with_ids}n_pieces long, ids_sha256 string, decoded_sha256 string, decoded_chars long")


def _lists(made: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *made])))
