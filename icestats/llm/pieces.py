"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which lays out their trie depth first: the
forward states of a prefix are computed once and reused by every word that starts with it.
For a unigram model a state holds the best score of the prefix (Viterbi); for a BPE model it
holds the one last piece with which the prefix's own encoding ends, found by asking which
neighbouring pieces the merges leave apart. Ids equal those of the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0
#: Words, and twice as many neighbour pairs, that a task remembers between slices (some 100 MB).
CACHED = 150_000
#: Bytes of text that a task encodes at once.
PIECE_BYTES = 1_000_000
UNKNOWN_SURFACE = " ⁇ "


class Model:
    """Pieces and scores of a model with the identity normaliser."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(raw)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if m.trainer_spec.model_type not in (UNIGRAM, BPE) or any(p.type == USER_DEFINED for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.kind = m.trainer_spec.model_type
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        joined = "".join(p for p in self.ids if len(p) > 1)
        apart = "".join(c for c in "\n\t\r" if c not in joined)
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        # cuts that no piece crosses; without them a text is one word
        self.cut = None if inner else re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self.apart: dict[tuple[str, str], bool] = {}
        self.index: dict[str, int] = {}
        self.flat, self.border = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.ends = self._suffixes()
        self.table = [b""] * len(m.pieces)
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.table[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == UNKNOWN:
                self.table[i] = UNKNOWN_SURFACE.encode()
            elif p.type == NORMAL:
                self.table[i] = p.piece.replace(MARK, " ").encode("utf-8", "surrogatepass")

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return self.cut.findall(marked) if self.cut else [marked]

    def merge(self, text: str) -> list[str]:
        """BPE by merging: the best neighbour pair first, the leftmost at a tie."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(part):
                both = part[i] + part[j]
                score = self.scores.get(both)
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[i] or not part[j] or part[i] + part[j] != both or right[i] != j:
                continue
            part[i], part[j] = both, ""
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p]

    def stays(self, a: str, b: str) -> bool:
        """Whether merging leaves the pieces a and b apart."""
        got = self.apart.get((a, b))
        if got is None:
            got = self.apart[a, b] = self.merge(a + b) == [a, b]
        return got

    def out(self, parts: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in parts]
        except KeyError:
            pass
        ids: list[int] = []
        for p in parts:
            at = self.ids.get(p)
            if at is not None:
                ids.append(at)
            elif self.bytes:
                ids.extend(self.bytes[x] for x in p.encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return ids

    def _suffixes(self) -> dict:
        """Pieces by their characters from the last to the first; "" holds the piece."""
        root: dict = {}
        for piece in self.ids:
            if self.kind == UNIGRAM or len(piece) == 1 or self.merge(piece) == [piece]:
                node = root
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = piece
        return root

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words; sorted, so that a prefix's states serve all words that share it."""
        found: dict[str, list[int]] = {}
        extend = self._last_piece if self.kind == BPE else self._best_piece
        last, score, before, pieces = "", [0.0], [0], [""]  # states by length of the prefix
        for word in sorted(words):
            if self.kind == BPE and word.startswith(MARK * 2):
                found[word] = self.out(self.merge(word))  # runs of marks tie in score
                continue
            k, most = 0, min(len(last), len(word))
            while k < most and last[k] == word[k]:
                k += 1
            if k + 1 < len(before):
                del score[k + 1 :], before[k + 1 :], pieces[k + 1 :]
            extend(word, k + 1, score, before, pieces)
            last, end, parts = word, len(word), []
            while end:
                parts.append(pieces[end])
                end = before[end]
            parts.reverse()
            found[word] = self.out(parts)
        return found

    def _last_piece(self, word: str, first: int, score: list[float], before: list[int], pieces: list[str]) -> None:
        """BPE: the piece with which the encoding of each longer prefix ends; just one stays apart from its neighbour."""
        root, apart = self.ends, self.apart
        for end in range(first, len(word) + 1):
            node, start, got = root, end, None
            while start:
                node = node.get(word[start - 1])
                if node is None:
                    break
                start -= 1
                piece = node.get("")
                if piece is not None:
                    if not start:
                        got = (start, piece)
                        break
                    pair = (pieces[start], piece)
                    if apart[pair] if pair in apart else self.stays(*pair):
                        got = (start, piece)
                        break
            if got is None:
                got = (end - 1, word[end - 1])
            before.append(got[0])
            pieces.append(got[1])

    def _best_piece(self, word: str, first: int, score: list[float], before: list[int], pieces: list[str]) -> None:
        """Unigram: the best score of each longer prefix and the piece it ends with."""
        for end in range(first, len(word) + 1):
            node, start = self.ends, end
            best, at, last = score[end - 1] + self.worst, end - 1, word[end - 1]
            if last in self.scores:
                best = score[end - 1] + self.scores[last]
            while start:
                node = node.get(word[start - 1])
                if node is None:
                    break
                start -= 1
                piece = node.get("")
                if piece is not None and score[start] + self.scores[piece] > best:
                    best, at, last = score[start] + self.scores[piece], start, piece
            score.append(best)
            before.append(at)
            pieces.append(last)

    def _know(self, words: list[str]) -> None:
        """Encode the words not met before; ids of word k lie between its borders in one array."""
        if len(self.apart) > 2 * CACHED:
            self.apart.clear()
        if len(self.index) > CACHED:
            self.index.clear()
            self.flat, self.border = np.zeros(0, np.int32), np.zeros(1, np.int64)
        new = self.encode_words(set(words).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.flat = np.concatenate([self.flat, np.array([i for x in new.values() for i in x], dtype=np.int32)])
            self.border = np.concatenate([self.border, self.border[-1] + np.cumsum([len(x) for x in new.values()])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, border of each text)."""
        words: list[str] = []
        to = [0]
        for t in texts:
            if t:
                words += self.words(t)
            to.append(len(words))
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        self._know(words)
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        reps = self.border[codes + 1] - self.border[codes]
        ends = np.concatenate([[0], np.cumsum(reps)])
        ids = self.flat[np.repeat(self.border[codes] - ends[:-1], reps) + np.arange(ends[-1])]
        return ids, ends[to]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_LOADED: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(raw)
    return _LOADED[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded) of every whole text; `decoded` is made from the ids.

    The driver reads the model and sends it along. A null text has null ids and null
    `decoded`, an empty one no ids; repeated rows are encoded each; an empty table gives an
    empty result; other columns are not read. U+2581 decodes as a blank.
    """
    raw = read_model(path)
    _model(raw)  # a model that is not supported fails here
    chosen = docs.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw)
        for batch in batches:
            for part in slices(batch, text_col, PIECE_BYTES):
                texts = part.column(1).to_pylist()
                ids, border = model.encode(texts)
                listed = ids.tolist()
                back = [None if t is None else model.decode(listed[a:b]) for t, a, b in zip(texts, border, border[1:])]
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.compute.if_else(null, pa.scalar(None, lists.type), lists), pa.array(np.diff(border)), pa.array(back, pa.string())],
                    [id_col, "ids", "n_tokens", "decoded"],
                )

    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, decoded string")


@query("op1_shared_prefix_pieces")
def op1(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"))
