"""N-gram Jaccard join by chosen paths.

Every different set of word shingles gets a min-hash sketch. From the root of a run, a node
picks a few sketch places at random and hands each set on to the child of its value there,
so that similar sets stay together; nodes that are still large split again, small ones are
compared in full, and runs repeat until a pair at the threshold is found with the wanted
recall. Joined sets form components; inside these all shingle sets are compared exactly, in
blocks, which counts every link once. Equal sets are one class member from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import SHINGLE, components, grouped, mix64, shingles, slices, store, table, words_of

SIMILAR = 0.8
RECALL = 0.99
PLACES = 64
#: Sketches must agree on this share less than the threshold to be joined: four deviations.
MARGIN = 0.2
LEAF = 1024
DEPTH = 3
BLOCK = 128


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met: a path of `depth` critical choices survives with p."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(n), seed) | np.uint64(1)


def sketches(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Min-hash values (len(sets), places) of sets that are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), places), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(_odd(places, 11), mix64(np.arange(places), 12))):
            out[:, k] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signature(own: np.ndarray) -> bytes:
    """128 bits of a sorted shingle set."""
    with np.errstate(over="ignore"):
        a = np.uint64(np.add.reduce(mix64(own, 21))), np.uint64(np.add.reduce(mix64(own, 22)) + np.uint64(len(own)))
    return b"".join(int(x).to_bytes(8, "big") for x in a)


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, places: int = PLACES) -> DataFrame:
    """(id, sig, sketch) of each document; null sig for a text without words."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = [np.unique(s) for s in shingles([words_of(t) for t in part.column(1).to_pylist()], width)]
                full = [k for k, s in enumerate(own) if len(s)]
                sigs: list[bytes | None] = [None] * len(own)
                rows: list[bytes | None] = [None] * len(own)
                if full:
                    made = sketches([own[k] for k in full], places)
                    for k, sketch in zip(full, made):
                        sigs[k], rows[k] = signature(own[k]), sketch.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary()), pa.array(rows, pa.binary())], ["id", "sig", "sketch"])

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, sig binary, sketch binary")


def _children(nodes: np.ndarray, sketch: np.ndarray, similar: float, root: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of every place that a row's node picks; a root picks one place at least."""
    places = sketch.shape[1]
    draw = mix64(nodes[:, None] ^ _odd(places, 31)[None, :], 32)
    picked = draw < np.uint64(int(2**64 / (similar * places)))
    if root:
        picked |= ~picked.any(axis=1, keepdims=True) & (draw == draw.min(axis=1, keepdims=True))
    row, place = np.nonzero(picked)
    with np.errstate(over="ignore"):
        child = mix64(nodes[row] ^ mix64(sketch[row, place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)), 33), 34)
    return row, child


def _split(members: DataFrame, similar: float, runs: int = 0) -> DataFrame:
    """Members (sig, sketch[, node]) to (node, sig) of the next level; `runs` starts at the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                sig = batch.column(0)
                sketch = np.stack([np.frombuffer(x, dtype=np.uint32) for x in batch.column(1).to_pylist()])
                starts = [mix64(np.full(len(sig), r), 35) for r in range(runs)] or [batch.column(2).to_numpy().view(np.uint64)]
                for nodes in starts:
                    row, child = _children(nodes, sketch, similar, runs > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), sig.take(pa.array(row))], ["node", "sig"])

    return members.mapInArrow(run, "node long, sig binary")


def _compare(similar: float):
    """Stars of a bucket: every pair whose sketches agree is joined, itself or through others.

    Each set in turn meets all that are not joined yet; pairs of joined sets need no look, as
    the exact stage compares all of a component. Stars are around the least signature, which
    other buckets mostly share.
    """

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pairs = sorted(zip(rows.column("sig").to_pylist(), rows.column("sketch").to_pylist()))
        if len(pairs) < 2:
            return
        sketch = np.stack([np.frombuffer(x, dtype=np.uint32) for _, x in pairs])
        free, a, b = np.arange(len(pairs)), [], []
        while len(free) > 1:
            start, free = int(free[0]), free[1:]
            queue = [start]
            while queue and len(free):
                near = (sketch[free] == sketch[queue.pop()]).mean(axis=1) >= similar
                joined, free = free[near].tolist(), free[~near]
                queue += joined
                a += [pairs[start][0]] * len(joined)
                b += [pairs[k][0] for k in joined]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def candidate_edges(sets: DataFrame, similar: float = SIMILAR, runs: int | None = None, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) that join all sets (sig, sketch) met on a chosen path and alike by their sketches."""
    runs = runs or runs_for(RECALL, depth)
    found = []
    members = _split(sets.select("sig", "sketch"), similar, runs)
    for level in range(1, depth + 1):
        members = store(members, "paths")
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = members.join(sizes, "node").join(sets.select("sig", "sketch"), "sig")
        shared = store(shared.select("node", "sig", "n", "sketch"), "buckets")
        last = level == depth
        found.append(_brute_force(shared if last else shared.where(F.col("n") <= leaf), similar, leaf))
        large = shared.where(F.col("n") > leaf)
        if last or large.isEmpty():
            break
        members = _split(large.select("sig", "sketch", "node"), similar)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _brute_force(buckets: DataFrame, similar: float, leaf: int) -> DataFrame:
    """Compare buckets; one of more than `leaf` members goes in pairs of blocks."""
    blocks = F.ceil(F.col("n") / F.lit(max(1, leaf // 2))).cast("int")
    own = F.when(F.col("n") <= leaf, F.lit(0)).otherwise(F.pmod(F.xxhash64("sig"), blocks).cast("int"))
    other = F.when(F.col("n") <= leaf, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))
    rows = buckets.select("node", "sig", "sketch", own.alias("part"), F.explode(other).alias("o"))
    rows = rows.select("node", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "sig", "sketch", "part")
    return grouped(rows, ["node", "i", "j"], _compare(similar - MARGIN), "a binary, b binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of token columns."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, token = row[n[token] > 1], token[n[token] > 1]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    np.fill_diagonal(out, 0)
    if len(token):
        names, token = np.unique(token, return_inverse=True)
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        width = 4096
        for start in range(0, len(names), width):
            a, b = np.searchsorted(token, (start, start + width))
            dense = np.zeros((len(sets), min(width, len(names) - start)), dtype=np.float32)
            dense[row[a:b], token[a:b] - start] = 1
            out += dense @ dense.T
    np.fill_diagonal(out, sizes)
    return out


def _exact(similar: float, width: int):
    """Exact links of one component or pair of its blocks: counts by sig, and joining edges."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, texts = rows.column("sig").to_pylist(), rows.column("text").to_pylist()
        copies, part = np.array(rows.column("copies").to_pylist()), np.array(rows.column("part").to_pylist())
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        own = [np.unique(s) for s in shingles([words_of(t) for t in texts], width)]
        keep = [k for k, s in enumerate(own) if len(s) and signature(s) == sig[k]]
        keep = list({sig[k]: k for k in keep}.values())  # an id given to several rows brings each
        if len(keep) < 2:
            return
        sig, own, copies, part = [sig[k] for k in keep], [own[k] for k in keep], copies[keep], part[keep]
        both, sizes = overlaps(own), np.array([len(s) for s in own])
        links = both >= similar * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        np.fill_diagonal(links, False)
        if i != j:
            links &= part[:, None] != part[None, :]
        a, b, seen = [], [], np.zeros(len(sig), dtype=bool)
        for start in sorted(range(len(sig)), key=sig.__getitem__):  # stars around the least of what is joined
            queue = [] if seen[start] else [start]
            seen[start] = True
            while queue:
                for x in np.flatnonzero(links[queue.pop()] & ~seen).tolist():
                    seen[x] = True
                    queue.append(x)
                    a.append(sig[start])
                    b.append(sig[x])
        n = links.any(axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*(s for s, x in zip(sig, n) if x), *a], pa.binary()), pa.array([None] * int(n.sum()) + b, pa.binary()),
                pa.array(np.concatenate([links.sum(axis=1)[n], np.zeros(len(a))]).astype(np.int64)),
                pa.array(np.concatenate([(links @ copies)[n], np.zeros(len(a))]).astype(np.int64)),
            ],
            ["a", "b", "sets", "docs"],
        )

    return run


def jaccard_classes(docs: DataFrame, similar: float = SIMILAR, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(id, class_id, copy_of, n_links, n_text_links) of every document.

    Two documents are linked if the Jaccard similarity of their sets of `width`-word
    shingles is `similar` or more (a shorter text is one shingle). `class_id` is the least id
    of all documents that links join, `copy_of` the least id among equal sets, `n_links` the
    linked documents (copies included), `n_text_links` the linked sets that differ. Texts
    without words, null texts included, are linked to nothing and are their own class; null
    ids never name a class of others; repeated rows are copies. Other columns are not read.
    """
    known = store(sets_of(docs, id_col, text_col, width), "sets")
    sets = store(known.where("sig is not null").groupBy("sig").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch")), "classes")
    edges = candidate_edges(sets, similar, runs, leaf)
    joined = components(edges)
    size = joined.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = (
        joined.join(size, "component").join(sets.select(F.col("sig").alias("node"), "first", "copies"), "node")
        .withColumn("part", F.when(blocks > 1, F.pmod(F.xxhash64("node", F.lit(7)), blocks)).otherwise(F.lit(0)).cast("int"))
        .withColumn("blocks", blocks)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = placed.join(texts, placed["first"].eqNullSafe(texts["id"]))
    rows = met.select("component", F.col("node").alias("sig"), "copies", "part", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    rows = rows.select(F.col("component").alias("c"), F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "sig", "copies", "part", "text")
    checked = store(grouped(rows, ["c", "i", "j"], _exact(similar, width), "a binary, b binary, sets long, docs long"), "links")
    counts = checked.where("b is null").groupBy(F.col("a").alias("sig")).agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    final = components(checked.where("b is not null").select("a", "b"))
    named = sets.join(final.withColumnRenamed("node", "sig"), "sig")
    least = named.groupBy("component").agg(F.min("first").alias("class_id"))
    linked = named.join(least, "component").select("sig", "class_id").join(counts, "sig")
    per_set = sets.select("sig", "first", "copies").join(linked, "sig", "left")
    out = known.select("id", "sig").join(per_set, "sig", "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "first", "id").alias("class_id"), F.coalesce("first", "id").alias("copy_of"),
        (F.coalesce("docs", none) + F.coalesce(F.col("copies") - 1, none)).alias("n_links"), F.coalesce("sets", none).alias("n_text_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the least id of each class; columns unchanged.

    A row is known by its id and a hash of its text; rows that repeat both count as one
    document. Ids stand before null ids.
    """
    text = F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0))
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("unknown"), F.col(f"`{id_col}`").alias("id"), text.alias("h"))
    rows = docs.select(key.alias("_k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = jaccard_classes(docs.select(key.alias("_k"), F.col(f"`{text_col}`").alias("_t")), id_col="_k", text_col="_t", **options)
    found = store(found.select("_k", "class_id"), "kept")
    kept = found.where(F.col("_k").eqNullSafe(F.col("class_id"))).groupBy("_k").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_k", "_kept")
    met = rows.join(kept, F.col("_k").eqNullSafe(F.col("_kept")))
    return met.where("n = 1").select("row.*").unionByName(met.where("n > 1").dropDuplicates(["_k"]).select("row.*"))


@query("op8_chosen_path_join")
def op8(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))
