"""Document chunks and retrieval."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame, Row, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from icestats.functions.scalars import hashed_key

# Chunk length and overlap in characters, separators from coarse to fine
CHUNK_SIZE, CHUNK_OVERLAP = 800, 150
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# Words that mark an explanation, phrases worth more and their bonus
EXPLANATORY = (
    "invented", "created", "developed", "designed", "originally", "system", "formula", "calculate",
    "measure", "rating", "method", "used in chess",
)
PHRASES, PHRASE_BONUS = ("elo rating", "elo system"), 5


def parsed_text(parsed: Column) -> Column:
    """Text of a parsed document variant: its elements' contents joined by blank lines."""
    elements = F.try_variant_get(parsed, "$.document.elements", "array<struct<type:string,content:string>>")
    return F.array_join(F.transform(elements, lambda e: e["content"]), "\n\n")


def parsed_documents(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Documents with text; those that report an error status are left out."""
    failed = F.try_variant_get(F.col(parsed), "$.error_status", "string").isNotNull()
    return df.filter(~failed).withColumn("text", parsed_text(F.col(parsed)))


def stride_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks at a fixed stride; the last one starts where it still adds new text."""
    last = F.greatest(F.lit(1), F.length(text) - overlap)
    starts = F.sequence(F.lit(1), last, F.lit(size - overlap))
    return F.when(F.length(F.trim(text)) > 0, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>")
    )


def separator_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks that break at the coarsest separator which makes the pieces fit."""

    def run(texts: pd.Series) -> pd.Series:
        def pieces(t: str, sep: str) -> list[str]:
            if not sep:
                return list(t)
            head, *rest = t.split(sep)
            return [p for p in [head, *[sep + r for r in rest]] if p]

        def pack(parts: list[str]) -> list[str]:
            done, held, total = [], [], 0
            for p in parts:
                if held and total + len(p) > size:
                    done.append("".join(held))
                    while held and (total > overlap or total + len(p) > size):
                        total -= len(held.pop(0))
                held.append(p)
                total += len(p)
            if held:
                done.append("".join(held))
            return done

        def split(t: str, seps: Sequence[str]) -> list[str]:
            at = next(i for i, s in enumerate(seps) if s in t)
            out: list[str] = []
            small: list[str] = []
            for p in pieces(t, seps[at]):
                if len(p) < size:
                    small.append(p)
                    continue
                out += pack(small)
                small = []
                out += split(p, seps[at + 1 :]) if at + 1 < len(seps) else [p]
            return out + pack(small)

        return texts.map(lambda t: [c.strip() for c in split(t, SEPARATORS) if c.strip()] if t and t.strip() else [])

    return pandas_udf(run, "array<string>")(text)


def chunk_table(df: DataFrame, chunks: Column, *, doc: str, name: str, created: Column | None = None) -> DataFrame:
    """One row per chunk with key, position, metadata and time."""
    out = df.select(F.col(doc).alias("document"), F.col(name).alias("file_name"), F.posexplode(chunks).alias("chunk_index", "chunk_text"))
    meta = F.create_map(
        F.lit("source"), F.col("file_name"), F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("length"), F.length("chunk_text").cast("string"),
    )
    return out.select(
        hashed_key(F.col("document"), F.col("chunk_index")).alias("document_id"), "document", "file_name", "chunk_text", "chunk_index",
        meta.alias("metadata"), (created if created is not None else F.current_timestamp()).alias("created_at"),
    )


def relevance(text: Column) -> Column:
    """One point per explanatory word, five for one of the phrases."""
    low = F.lower(text)
    points = sum((F.contains(low, F.lit(w)).cast("int") for w in EXPLANATORY), F.lit(0))
    bonus = F.contains(low, F.lit(PHRASES[0])) | F.contains(low, F.lit(PHRASES[1]))
    return points + bonus.cast("int") * PHRASE_BONUS


def keyword_search(chunks: DataFrame, keyword: str, top_k: int = 5, score: Column | None = None) -> DataFrame:
    """Chunks matching the keyword, most explanatory first; all scoring stays on the cluster."""
    hits = chunks.filter(F.col("chunk_text").rlike(f"(?i){keyword}")).withColumn("score", score if score is not None else relevance(F.col("chunk_text")))
    return hits.orderBy(F.desc("score"), "document", "chunk_index").limit(top_k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(vectors: DataFrame, query: Column, top_k: int = 5, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact nearest vectors by cosine: one scan, every task keeps its best k."""
    found = vectors.withColumn("_q", query).withColumn("similarity", cosine(F.col(vector), F.col("_q")))
    return found.drop("_q").orderBy(F.desc("similarity"), key).limit(top_k)


#: Queries that one pass over the table carries to the tasks.
QUERIES_PER_PASS = 512


def _passes(queries: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """The queries in blocks of about `size` rows, spread by hash; a block is what a pass carries."""
    blocks = max(1, -(-queries.count() // size))
    for b in range(blocks):
        found = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        if found:
            yield found


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def best_per_query(hits: DataFrame, query: str, order: Sequence[Column], top_k: int) -> DataFrame:
    """The first `top_k` hits of each query with their rank; every task keeps its own best first."""
    w = W.partitionBy(query).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def keyword_search_many(chunks: DataFrame, queries: DataFrame, top_k: int = 5, *, query: str = "query_id", keyword: str = "keyword") -> DataFrame:
    """Keyword search for every row of `queries`: (query, rank, chunk columns, score).

    A pass reads the chunks once for a block of distinct keywords; queries with equal
    keywords share their hits until these are ranked.
    """
    asked = queries.filter(F.length(keyword) > 0).select(query, keyword)
    parts = []
    for block in _passes(asked.select(keyword).distinct(), keyword, QUERIES_PER_PASS):
        found = F.array_compact(F.array(*[F.when(F.col("chunk_text").rlike(f"(?i){r[0]}"), F.lit(r[0])) for r in block]))
        hits = chunks.withColumn("_found", found).filter(F.size("_found") > 0).withColumn("score", relevance(F.col("chunk_text")))
        parts.append(hits.withColumn(keyword, F.explode("_found")).drop("_found"))
    if not parts:
        parts = [chunks.limit(0).withColumns({"score": F.lit(0), keyword: F.lit(None).cast("string")})]
    best = best_per_query(_union(parts), keyword, [F.desc("score"), F.col("document"), F.col("chunk_index")], top_k)
    return asked.join(best, keyword).drop(keyword)


def vector_search_many(
    vectors: DataFrame, queries: DataFrame, top_k: int = 5, *, keys: Sequence[str] = ("vec_id",), vector: str = "embedding", query: str = "query_id", query_vector: str = "query_vector",
) -> DataFrame:
    """Exact nearest vectors by cosine for every row of `queries`: (query, rank, keys, similarity).

    A pass multiplies each Arrow batch with a block of query vectors and keeps a bounded list
    per query and task; the lists are merged by query. Vectors that are null, zero or of
    another length than the query have no similarity. Similarities that agree to nine
    digits are ties and go by the keys.
    """
    rows = vectors.select(*keys, vector)
    schema = T.StructType([queries.schema[query], *[rows.schema[k] for k in keys], T.StructField("similarity", T.DoubleType())])
    asked = queries.filter(F.col(query_vector).isNotNull()).select(query, query_vector)
    parts = [rows.mapInArrow(_nearest(block, list(keys), top_k, schema), schema) for block in _passes(asked, query, QUERIES_PER_PASS)]
    hits = _union(parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    return best_per_query(hits, query, [F.desc(F.round("similarity", 9)), *[F.col(k) for k in keys]], top_k)


def _nearest(block: list[Row], keys: list[str], top_k: int, schema: T.StructType):
    groups: dict[int, list[Row]] = {}
    for r in block:
        groups.setdefault(len(r[1]), []).append(r)
    sides = {}
    for width, members in groups.items():
        q = np.array([m[1] for m in members], float).reshape(len(members), width)
        norm = np.sqrt((q * q).sum(axis=1))
        sides[width] = ([m[0] for m, n in zip(members, norm) if n > 0], q[norm > 0] / norm[norm > 0][:, None])
    names = schema.names
    kinds = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            vectors = batch.column(len(keys))
            width = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
            for size, (ids, q) in sides.items():
                at = np.flatnonzero(width == size)
                if not len(at) or not ids:
                    continue
                x = vectors.take(pa.array(at)).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                norm = np.sqrt((x * x).sum(axis=1))
                at, x, norm = at[norm > 0], x[norm > 0], norm[norm > 0]
                near = np.round(x @ q.T / norm[:, None], 12)
                own = [batch.column(k).take(pa.array(at)).to_pylist() for k in range(len(keys))]
                for j, query_id in enumerate(ids):
                    best = held.get(query_id, [])
                    least = -best[-1][0] if len(best) == top_k else -2.0
                    new = np.flatnonzero(np.round(near[:, j], 9) >= least)
                    if len(new) > 4 * top_k:  # all that can be among the first, ties included
                        cut = np.partition(near[new, j], len(new) - top_k)[len(new) - top_k]
                        new = new[near[new, j] >= cut - 1e-9]
                    more = [(-round(float(near[i, j]), 9), tuple(o[i] for o in own), float(near[i, j])) for i in new.tolist()]
                    held[query_id] = heapq.nsmallest(top_k, best + more, key=lambda h: h[:2])
        rows = [(query_id, *key, value) for query_id, best in held.items() for _, key, value in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def hybrid_search(chunks: DataFrame, queries: DataFrame, top_k: int = 5, *, query: str = "query_id", keyword: str = "keyword", query_vector: str = "query_vector") -> DataFrame:
    """(query, branch, rank, document, chunk_index, file_name, chunk_text) of every query.

    A query with a keyword is a keyword search, any other one a search over the chunks'
    `embedding`.
    """
    keep = [query, "branch", "rank", "document", "chunk_index", "file_name", "chunk_text"]
    has = F.coalesce(F.length(keyword) > 0, F.lit(False))
    words = keyword_search_many(chunks, queries.filter(has), top_k, query=query, keyword=keyword).withColumn("branch", F.lit("keyword"))
    near = vector_search_many(chunks, queries.filter(~has), top_k, keys=("document", "chunk_index"), query=query, query_vector=query_vector)
    texts = chunks.select("document", "chunk_index", "file_name", "chunk_text")
    near = near.join(texts, ["document", "chunk_index"]).withColumn("branch", F.lit("vector"))
    return words.select(*keep).unionByName(near.select(*keep))


def context_text(hits: DataFrame, top_k: int = 5, *, query: str = "query_id") -> DataFrame:
    """(query, context): numbered blocks of each query's first `top_k` chunks as one text."""
    block = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit(": "), F.col("file_name"), F.lit("]\n"), F.col("chunk_text"))
    rows = hits.filter(F.col("rank") <= top_k).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))).alias("b"))
    return rows.select(query, F.array_join(F.transform("b", lambda x: x["t"]), "\n\n---\n\n").alias("context"))
