"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of similar length share a block. A block holds one bit slice per Bloom position:
bit d of a slice belongs to document d. A term enters a document's signature once for each
step of a ladder of occurrence counts that it reaches, so that the AND of a term's slices
overestimates both presence and count. Slice sums weighted by the query's terms bound each
document's score from above; a document whose bound reaches the k-th best exact score known
is rescored exactly from its text, every other one is provably no result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import mix64, slices, store, table

#: ASCII letters and digits and all bytes of other characters make terms; A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
#: Occurrence counts from which a term enters once more; the ladder goes on by halves of powers of two.
LADDER = np.array(sorted({1, 2, 3} | {2**k for k in range(2, 33)} | {3 * 2**k for k in range(1, 31)}), dtype=np.int64)
PROBES = 6
BITS_PER_ENTRY = 12
BLOCK_DOCS = 1024
#: Cells (slices x documents) of one block while it is built.
BLOCK_CELLS = 16_000_000
#: Query text that one pass over the signatures carries to the tasks.
BATCH_BYTES = 2_000_000
#: Documents per item, as a multiple of k, whose exact scores set the bar.
SEEDS = 4


def terms_of(raw: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return raw.translate(TERM_BYTES).split() if raw else []


def probes(hashes: np.ndarray, level: np.ndarray, height: int) -> np.ndarray:
    """(entries, PROBES) slice numbers of (term, ladder step) entries."""
    with np.errstate(over="ignore"):
        first = mix64(hashes + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 71)
        second = mix64(first, 72) | np.uint64(1)
        return ((first[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * second[:, None]) >> np.uint64(11)) % np.uint64(height)


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([t.decode("latin-1") for t in terms], dtype=object), categorize=False) if terms else np.zeros(0, np.uint64)


def size_class(entries: int) -> int:
    """Documents of a class have at most 2^(class / 2) entries."""
    return max(0, math.ceil(2 * math.log2(max(entries, 1)) - 1e-9))


def slices_of_class(size: int) -> int:
    return max(64, math.ceil(BITS_PER_ENTRY * 2 ** (size / 2)))


class _Blocks:
    """Signatures of a task's documents by size class; a full class leaves as a block."""

    def __init__(self, names: list[str], ids: pa.DataType):
        self.names, self.id_type, self.open, self.n = names, ids, {}, 0

    def add(self, doc_id: pa.Scalar, n: int, entries: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = size_class(len(entries[0]))
        held = self.open.setdefault(size, [])
        held.append((doc_id, n, entries))
        if len(held) >= min(BLOCK_DOCS, max(1, BLOCK_CELLS // slices_of_class(size))):
            yield self.close(size)

    def close(self, size: int) -> pa.RecordBatch:
        held = self.open.pop(size)
        height = slices_of_class(size)
        counts = [len(e[0]) for _, _, e in held]
        at = probes(np.concatenate([e[0] for _, _, e in held]), np.concatenate([e[1] for _, _, e in held]), height)
        cells = np.zeros((height, len(held)), dtype=bool)
        cells[at, np.repeat(np.arange(len(held)), counts)[:, None]] = True
        bits = np.packbits(cells, axis=1)
        ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array([i for i, _, _ in held], self.id_type))
        n = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array([n for _, n, _ in held], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, n, pa.array([height]), pa.array([bits.tobytes()], pa.binary())], self.names)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for size in sorted(self.open):
            yield self.close(size)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ids, n, height, bits): blocks of signatures of every document that holds a term.

    `n` counts each document's terms; `bits` are `height` slices of one bit per document.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            blocks = blocks or _Blocks(["ids", "n", "height", "bits"], batch.schema.field(0).type)
            for part in slices(batch):
                ids = part.column(0)
                lists = [terms_of(raw) for raw in part.column(1).cast(pa.binary()).to_pylist()]
                sizes = np.array([len(x) for x in lists], dtype=np.int64)
                flat = [t for x in lists for t in x]
                if not flat:
                    continue
                codes, names = pd.factorize(np.array(flat, dtype=object))
                hashes = term_hashes(list(names))
                own, tf = np.unique(np.repeat(np.arange(len(lists)), sizes) * len(names) + codes, return_counts=True)
                steps = np.searchsorted(LADDER, tf, side="right")
                entry_doc = np.repeat(own // len(names), steps)
                entry_hash = np.repeat(hashes[own % len(names)], steps)
                entry_step = np.arange(len(entry_doc)) - np.repeat(np.cumsum(steps) - steps, steps)
                cut = np.searchsorted(entry_doc, np.arange(len(lists) + 1))
                for k in np.flatnonzero(sizes).tolist():
                    a, b = cut[k], cut[k + 1]
                    yield from blocks.add(ids[k], int(sizes[k]), (entry_hash[a:b].copy(), entry_step[a:b].copy()))
        if blocks is not None:
            yield from blocks.rest()

    return chosen.mapInArrow(run, f"ids array<{kind}>, n array<long>, height long, bits binary")


def document_counts(docs: DataFrame, terms: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each of the given terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(terms.intersection(terms_of(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(n, documents: int, total: int):
    """100 - 75 + 75 times a document's length against the mean, in whole hundredths."""
    return 100 - 75 + (75 * n * documents) // total


def gain(tf, factor):
    """What one unit of a term's weight brings at `tf` occurrences; grows with tf, below 10^6."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * factor)


def whole_floats(weights: list[int]) -> np.ndarray:
    """The weights in single precision where all their sums are exact in it."""
    return np.array(weights, dtype=np.float32 if sum(weights) < 1 << 24 else np.float64)


class Queries(NamedTuple):
    """A batch of queries over shared terms: the terms, and per query (term numbers, weights)."""

    terms: list[bytes]
    rows: list[tuple[np.ndarray, np.ndarray]]
    documents: int
    total: int


def upper_bounds(queries: Queries, n: np.ndarray, height: int, bits: bytes) -> np.ndarray:
    """(queries, documents) bounds of the scores of one block's documents."""
    docs = len(n)
    plane = np.frombuffer(bits, dtype=np.uint8).reshape(height, -1)
    factor = length_factor(n, queries.documents, queries.total)
    hashes = term_hashes(queries.terms)
    bound = np.zeros((len(queries.rows), docs))
    active, present, before = np.arange(len(hashes)), None, np.zeros(docs, dtype=np.int64)
    for step in range(len(LADDER) - 1):
        at = probes(hashes[active], np.full(len(active), step), height).astype(np.int64)
        found = plane[at[:, 0]]
        for j in range(1, PROBES):
            found &= plane[at[:, j]]
        if present is not None:
            found &= present
        some = found.any(axis=1)
        active, present = active[some], found[some]
        if not len(active):
            break
        best = gain(LADDER[step + 1] - 1, factor)  # the most that counts below the next step bring
        row_of = np.full(len(hashes), -1)
        row_of[active] = np.arange(len(active))
        held = np.unpackbits(present, axis=1, count=docs).astype(np.float32)
        for q, (terms, weights) in enumerate(queries.rows):
            at_row = row_of[terms]
            use = at_row >= 0
            if use.any():
                bound[q] += (weights[use] @ held[at_row[use]]) * (best - before)
        before = best
    return bound


def _bounded(index: DataFrame, queries: Queries, kind: str, k: int | None, bar: np.ndarray | None) -> DataFrame:
    """(item, id, bound): per task the k greatest bounds of each query, or all that reach its bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in queries.rows]
        id_type, serial = None, 0
        for batch in batches:
            ids_of, n_of, heights, bits_of = (batch.column(c) for c in ("ids", "n", "height", "bits"))
            id_type = ids_of.type.value_type
            for row in range(batch.num_rows):
                ids = ids_of[row].values
                bound = upper_bounds(queries, n_of[row].values.to_numpy(), heights[row].as_py(), bits_of[row].as_py())
                if bar is not None:
                    q, d = np.nonzero(bound >= bar[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids.take(pa.array(d)), pa.array(bound[q, d].astype(np.int64))], ["item", "id", "bound"])
                    continue
                for q, own in enumerate(bound):
                    least = heaps[q][0][0] if len(heaps[q]) == k else 0
                    better = np.flatnonzero(own > least)
                    for d in better[np.argsort(-own[better], kind="stable")[:k]].tolist():
                        serial += 1
                        push = heapq.heappush if len(heaps[q]) < k else heapq.heappushpop
                        push(heaps[q], (own[d], serial, ids[d].as_py()))
        if bar is None and id_type is not None:
            for q, heap in enumerate(heaps):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(heap), pa.int64()), pa.array([i for _, _, i in heap], id_type), pa.array([int(b) for b, _, _ in heap], pa.int64())], ["item", "id", "bound"]
                )

    return index.mapInArrow(run, f"item long, id {kind}, bound long")


def _rescored(docs: DataFrame, wanted: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, id, score) of the wanted pairs, at most k per item and task: the highest, least id first."""
    pairs = wanted.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    met = docs.join(pairs, F.col("id").eqNullSafe(F.col("_id"))).select("id", "text", "items")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {t: j for j, t in enumerate(queries.terms)}
        best: dict[int, list] = {}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            for doc, raw, items in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                terms = terms_of(raw)
                if not terms:
                    continue
                factor = length_factor(len(terms), queries.documents, queries.total)
                brings = {code[t]: gain(tf, factor) for t, tf in Counter(t for t in terms if t in code).items()}
                for q in items:
                    own, weights = queries.rows[q]
                    score = sum(int(w) * brings[t] for t, w in zip(own.tolist(), weights.tolist()) if t in brings)
                    if score > 0:
                        held = best.setdefault(q, [])
                        held.append((-score, doc is None, doc))
                        if len(held) >= 64 * k:
                            best[q] = heapq.nsmallest(k, held, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
        for q, held in best.items():
            held = heapq.nsmallest(k, held, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(held), pa.int64()), pa.array([x[2] for x in held], id_type), pa.array([-x[0] for x in held], pa.int64())], ["item", "id", "score"]
            )

    return met.mapInArrow(run, f"item long, id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k documents of highest score above 0 for each row of `items`.

    Equal scores go by ascending id, null ids last; ranks are unique. Null and empty texts hold no
    term; a text of any length is read whole; a repeated document counts and ranks each
    time, a repeated item is answered each time. Empty tables give an empty result; other
    columns are not read. Items go in batches of about BATCH_BYTES, each one pass.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{query_col}`").alias("query"))
    id_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((chosen, "id"), (asked, "item")))
    index = store(build_index(chosen, "id", "text"), "signatures")
    size = index.select(F.explode("n").alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    batches = max(1, math.ceil((asked.agg(F.sum(F.octet_length("query"))).first()[0] or 0) / BATCH_BYTES))
    parts = []
    for batch in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("item", "query"), F.lit(batches)) == batch).collect()
        wanted = [Counter(terms_of(r["query"].encode()) if r["query"] else ()) for r in rows]
        terms = sorted(set().union(*wanted))
        if not terms or not size["documents"]:
            continue
        holding = document_counts(chosen, set(terms))
        code = {t: j for j, t in enumerate(terms)}
        weight = {t: term_weight(size["documents"], holding.get(t, 0)) for t in terms}
        queries = Queries(terms, [
            (np.array([code[t] for t in own], dtype=np.int64), whole_floats([weight[t] * c for t, c in own.items()])) for own in wanted
        ], size["documents"], size["total"])
        seeds = store(_top(_bounded(index, queries, id_kind, SEEDS * k, None), "bound", SEEDS * k), "seeds")
        known = _rescored(chosen, seeds, queries, k)
        kth = {r["item"]: r["score"] for r in _top(known, "score", k).where(F.col("rank") == k).collect()}
        bar = np.array([kth.get(q, 1) for q in range(len(rows))], dtype=np.float64)
        candidates = store(_bounded(index, queries, id_kind, None, bar).select("item", "id"), "candidates")
        found = _top(_rescored(chosen, candidates, queries, k), "score", k)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"item long, name {item_kind}")
        parts.append(found.join(names, "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {id_kind}, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _top(scored: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(by), F.col("id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
factors AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM lengths, total),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, total GROUP BY term),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN factors USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_bit_sliced_search", SQL)
def op11(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
