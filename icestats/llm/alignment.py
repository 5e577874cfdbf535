"""Cross-tokenizer alignment through inverted pair bitmaps.

Two tokenizers cut the same bytes; where tokens of both end together a group ends, and every
token of one side is linked with every token of the other side of its group. Each pair of
ids has a compressed bitmap of the documents that hold it linked, kept in containers of one
chunk of documents each, and planes with the bits of its link count in each of them. The OR
of a pair's bitmaps counts its documents; the postings carry that score back to them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import slices, store, table

LEFT = "/opt/tokenizers/byte_bpe_50k.json"
RIGHT = "/opt/tokenizers/piece_bpe_32k.model"
#: The byte-level pre-tokenizer's pattern (fixed value of that tokenizer family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A container's documents are numbered in 16 bits.
CHUNK_DOCS = 1 << 16
CHUNK_BYTES = 8_000_000
#: Texts are encoded in stretches of about this many characters, cut where no token of either side crosses.
STRETCH = 1_000_000
#: Links that are expanded at once.
LINKS = 2_000_000
#: A blank between an ASCII letter, digit or mark and a letter starts a token on both sides.
CUT = re.compile(r"(?<=[0-9A-Za-z.,;]) (?=[A-Za-z])")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """A byte-level BPE file; merges rank as their ids, so ranks by id encode the same."""

    def __init__(self, raw: bytes):
        import tiktoken

        told = json.loads(raw)
        model, alphabet = told["model"], byte_alphabet()
        pre = told["pre_tokenizer"] or {}
        if model["type"] != "BPE" or told["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level BPE files are supported")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(made) or len(vocab) != len(made) + 256:
            raise ValueError("merges must be in the order of their ids")
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items()}
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.table[i] = piece
        self.encoder = tiktoken.Encoding("left", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(" " + text)


class PieceSide:
    """A SentencePiece model; it puts the leading blank itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.table = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.table.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text cut at blanks that start a token on both sides; both sides put the blank back."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        found = CUT.search(text, start + size)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.end()
    return [*out, text[start:]]


class Aligner:
    """Groups and links of texts under both tokenizers, with tables of their bytes."""

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.sizes = [np.array([len(p) for p in side.table], dtype=np.int64) for side in (left, right)]
        self.n_left, self.n_right = len(left.table), len(right.table)
        # digits and the mark that follows a token: inside and at the end of a group's left part; inside, at the
        # end of a group and at the end of a document on the right
        self.written = np.array(
            [f"{i}{mark}".encode() for mark, n in ((",", self.n_left), ("|", self.n_left), (",", self.n_right), (";", self.n_right), ("", self.n_right)) for i in range(n)]
        )

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if the bytes of either side are not those of blank and text."""
        if not text:
            return [], []
        parts = stretches(text)
        a = [i for s in parts for i in self.left.encode(s)]
        b = [i for s in parts for i in self.right.encode(s)]
        whole = b" " + text.encode()
        same = b"".join(map(self.left.table.__getitem__, a)) == whole and b"".join(map(self.right.table.__getitem__, b)) == whole
        return (a, b) if same else ([], [])

    def align(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Per text n_a, n_b, n_groups, n_links, sha; sorted keys pair * CHUNK_DOCS + text number and their links."""
        sides = [self.tokens(t) for t in texts]
        counts = [np.array([len(s[k]) for s in sides], dtype=np.int64) for k in (0, 1)]
        ids = [np.array([i for s in sides for i in s[k]], dtype=np.int64) for k in (0, 1)]
        ends = [np.cumsum(self.sizes[k][ids[k]]) for k in (0, 1)]
        shared = np.intersect1d(ends[0], ends[1], assume_unique=True)
        group = [np.searchsorted(shared, e) for e in ends]
        width = [np.bincount(g, minlength=len(shared)) for g in group]
        until = [np.cumsum(w) for w in width]
        links = width[0] * width[1]
        text_end = np.cumsum(counts[0])
        text_of = np.searchsorted(text_end, until[0] - width[0], side="right")  # of a group
        n_links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(n_links, text_of, links)
        told = {
            "n_a": counts[0], "n_b": counts[1], "n_groups": np.bincount(text_of, minlength=len(texts)), "n_links": n_links,
            "sha": self._digests(ids, group, width, until, text_of, counts),
        }
        keys, n = [], []
        fan = width[1][group[0]]
        fan_end = np.cumsum(fan)
        first = (until[1] - width[1])[group[0]]
        own = text_of[group[0]]
        start = 0
        while start < len(fan):
            stop = max(start + 1, int(np.searchsorted(fan_end, (fan_end[start - 1] if start else 0) + LINKS, side="right")))
            reps = fan[start:stop]
            at = np.repeat(first[start:stop] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            pair = np.repeat(ids[0][start:stop], reps) * self.n_right + ids[1][at]
            key, times = np.unique(pair * CHUNK_DOCS + np.repeat(own[start:stop], reps), return_counts=True)
            keys.append(key)
            n.append(times)
            start = stop
        if not keys:
            return told, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return told, *summed(np.concatenate(keys), np.concatenate(n))

    def _digests(self, ids, group, width, until, text_of, counts) -> list[str]:
        at_left = np.arange(len(ids[0])) + (until[1] - width[1])[group[0]]
        at_right = np.arange(len(ids[1])) + until[0][group[1]]
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in group]
        final = np.zeros(len(ids[1]), dtype=np.int64)
        final[np.cumsum(counts[1])[counts[1] > 0] - 1] = 1
        code = np.zeros(len(ids[0]) + len(ids[1]), dtype=np.int64)
        code[at_left] = ids[0] + self.n_left * last[0]
        code[at_right] = 2 * self.n_left + ids[1] + self.n_right * (last[1].astype(np.int64) + final)
        border = np.concatenate([[0], np.cumsum(counts[0] + counts[1])]).tolist()
        return ["" if a == b else hashlib.sha256(self.written[code[a:b]].tobytes().replace(b"\0", b"")).hexdigest() for a, b in zip(border, border[1:])]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pack(keys: np.ndarray, links: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, bytes, bytes, list[bytes]]:
    """(pairs, documents of each, lists, bitmaps, planes) of one chunk's sorted postings.

    A pair in fewer than a sixteenth of the documents lists their numbers, another one has a
    bitmap. Plane p holds bit p of the link count of every posting, in order.
    """
    pair, doc = keys // CHUNK_DOCS, keys % CHUNK_DOCS
    pairs, first, n = np.unique(pair, return_index=True, return_counts=True)
    dense = n * 16 >= docs
    listed = doc[~np.repeat(dense, n)].astype("<u2").tobytes()
    maps = []
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(docs, dtype=bool)
        bits[doc[first[k] : first[k] + n[k]]] = True
        maps.append(np.packbits(bits).tobytes())
    planes = [np.packbits(links >> p & 1).tobytes() for p in range(int(links.max()).bit_length())] if len(links) else []
    return pairs, n, listed, b"".join(maps), planes


def unpack(n: np.ndarray, listed: bytes, maps: bytes, planes: list[bytes], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, links) of every posting, in the order of `pack`."""
    dense = n * 16 >= docs
    of_dense = np.repeat(dense, n)
    doc = np.zeros(len(of_dense), dtype=np.int64)
    doc[~of_dense] = np.frombuffer(listed, dtype="<u2")
    if dense.any():
        bits = np.unpackbits(np.frombuffer(maps, dtype=np.uint8).reshape(int(dense.sum()), -1), axis=1, count=docs)
        doc[of_dense] = np.nonzero(bits)[1]
    links = np.zeros(len(doc), dtype=np.int64)
    for p, plane in enumerate(planes):
        links |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=len(doc)).astype(np.int64) << p
    return doc, links


_LOADED: dict[int, Aligner] = {}


def _aligner(left: bytes, right: bytes) -> Aligner:
    key = hash((left, right))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(ByteSide(left), PieceSide(right))
    return _LOADED[key]


NAMES = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "pairs", "n", "listed", "maps", "planes"]


def build_postings(docs: DataFrame, left: str = LEFT, right: str = RIGHT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of documents: their own counts, and the postings of all pairs in them.

    A chunk's slices hold different documents, so their bitmaps are OR-merged by one sort.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    raw = []
    for path in (left, right):
        with open(path, "rb") as f:
            raw.append(f.read())
    _aligner(*raw)  # a file that is not supported fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, serial = _aligner(*raw), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        told: list[dict] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs_in = bytes_in = 0

        def chunk() -> pa.RecordBatch:
            nonlocal ids, told, held, docs_in, bytes_in, serial
            own = pa.concat_arrays(ids)
            pairs, n, listed, maps, planes = pack(*summed(*(np.concatenate(x) for x in zip(*held))), docs_in)

            def one(values, kind):
                values = values if isinstance(values, pa.Array) else pa.array(values, kind)
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            out = pa.RecordBatch.from_arrays([
                pa.array([serial], pa.int64()), one(own, None), *(one(np.concatenate([t[c] for t in told]), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                one([s for t in told for s in t["sha"]], pa.string()), one(pairs, pa.int64()), one(n, pa.int64()),
                pa.array([listed], pa.binary()), pa.array([maps], pa.binary()), one(planes, pa.binary()),
            ], NAMES)
            ids, told, held, docs_in, bytes_in, serial = [], [], [], 0, 0, serial + 1
            return out

        for batch in batches:
            for part in (p.slice(a, CHUNK_DOCS) for p in slices(batch) for a in range(0, p.num_rows, CHUNK_DOCS)):
                size = part.column(1).nbytes
                if docs_in and (docs_in + part.num_rows > CHUNK_DOCS or bytes_in + size > CHUNK_BYTES):
                    yield chunk()
                about, keys, links = aligner.align(part.column(1).to_pylist())
                ids.append(part.column(0))
                told.append(about)
                held.append((keys + docs_in, links))
                docs_in, bytes_in = docs_in + part.num_rows, bytes_in + size
        if docs_in:
            yield chunk()

    return chosen.mapInArrow(
        run, f"chunk long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
        "pairs array<long>, n array<long>, listed binary, maps binary, planes array<binary>",
    )


def _pairs(postings: DataFrame) -> DataFrame:
    """(chunk, place, pair, n): every pair of every chunk with its documents there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pairs, n = batch.column("pairs")[row].values, batch.column("n")[row].values
                for a in range(0, len(pairs), 50_000):
                    size = min(50_000, len(pairs) - a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, batch.column("chunk")[row].as_py())), pa.array(np.arange(a, a + size, dtype=np.int32)), pairs.slice(a, size), n.slice(a, size)],
                        ["chunk", "place", "pair", "n"],
                    )

    return postings.select("chunk", "pairs", "n").mapInArrow(run, "chunk long, place int, pair long, n long")


def pair_counts(postings: DataFrame, n_right: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of its left id is in more.

    Containers of different chunks hold different documents: the popcount of their OR is the sum.
    """
    counts = _pairs(postings).groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {n_right}")))  # at most n_right rows each
    return counts.withColumn("best", F.col("n") == most)


def align_documents(docs: DataFrame, left: str = LEFT, right: str = RIGHT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    Null and empty texts, and texts that either side does not give back byte by byte, have no
    tokens: zeros and an empty digest. Texts of any length are encoded in stretches that no token
    crosses; repeated rows are documents of their own; ties for the highest count are all
    best. An empty table gives an empty result; other columns are not read.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    postings = store(build_postings(chosen, left, right, "id", "text"), "postings")
    with open(right, "rb") as f:
        n_right = len(PieceSide(f.read()).table)
    counts = store(pair_counts(postings, n_right), "pairs")
    scores = _pairs(postings).select("chunk", "place", "pair").join(counts, "pair").select("chunk", "place", F.col("n").alias("count"), "best")
    def run(about: pa.Table, scored: pa.Table) -> pa.Table:
        row = about.combine_chunks().to_batches()[0]
        own = {c: row.column(c)[0] for c in NAMES[1:]}
        docs_in, n = len(own["ids"]), own["n"].values.to_numpy()
        place = scored.column("place").to_numpy()
        count, best = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        count[place] = scored.column("count").to_numpy()
        best[place] = scored.column("best").to_numpy()
        doc, links = unpack(n, own["listed"].as_py(), own["maps"].as_py(), own["planes"].as_py(), docs_in)
        total, n_best = np.zeros(docs_in, dtype=np.int64), np.zeros(docs_in, dtype=np.int64)
        np.add.at(total, doc, links * np.repeat(count, n))
        np.add.at(n_best, doc, links * np.repeat(best, n))
        return pa.Table.from_arrays(
            [own["ids"].values, *(own[c].values for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(total), own["sha"].values],
            [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return postings.groupBy("chunk").cogroup(scores.groupBy("chunk")).applyInArrow(run, schema)


@query("op12_pair_bitmaps")
def op12(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"))
