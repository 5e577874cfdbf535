"""Helpers of the text operators: words, stored stages, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one pass over an Arrow batch holds at once.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may go without and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    What the write has shuffled is not needed once it is stored, so Spark may drop it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean, "false")
    conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(clean, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text (null: 0): the blanks that stand before a word, plus one for the first."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """`bytes.split` cuts at exactly the separators of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch holding about `limit` bytes of `column` each."""
    limit = limit or SLICE_BYTES
    if not batch.num_rows:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """Apply `fn` to pieces of at most SLICE_BYTES of `column` (longer single rows stay whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; equal on every machine."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


SHINGLE = 5
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(lists: list[list[bytes]], width: int = SHINGLE) -> list[np.ndarray]:
    """Per text, a 64-bit hash of the `width` words from each position on.

    A shorter text has one shingle of all its words, a text without words none.
    """
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = [w for x in lists for w in x]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in lists]
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    word = pd.util.hash_array(np.array([w.decode("latin-1") for w in distinct], dtype=object), categorize=False)[codes]
    n, ends = len(word), np.cumsum(sizes)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            rolled = rolled * _STEP + word[k : n - width + 1 + k] if n >= width else rolled
        rolled = mix64(rolled, 1)
        for size, end in zip(sizes.tolist(), ends.tolist()):
            if size >= width:
                out.append(rolled[end - size : end - width + 1])
            elif size:
                short = np.uint64(size)
                for w in word[end - size : end]:
                    short = short * _STEP + w
                out.append(mix64(np.array([short], dtype=np.uint64), 2))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 0) -> DataFrame:
    """Call `fn` with the rows of each key, streaming over sorted partitions (keys are not null).

    With `rows`, `fn` gets as many whole keys at once as it takes to reach that number.
    """
    ready = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.schema.get_field_index(k) for k in keys]
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for k in at:
                c = batch.column(k)
                change |= pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            if rows:  # only the cuts at which enough rows have gathered, and the last key's start
                cuts = [0, *(c for c, b in zip(cuts[1:-1], cuts[:-2]) if c // rows != b // rows or c == cuts[-2]), cuts[-1]]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                key = tuple(part.column(k)[0].as_py() for k in at)
                if held and key != mark and sum(x.num_rows for x in held) >= rows:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                mark = tuple(part.column(k)[len(part) - 1].as_py() for k in at)
                held.append(part)
        if held:
            yield from fn(pa.Table.from_batches(held))

    return ready.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the least node that each node is joined with.

    Neighbours move to the least neighbour in turns of large and small stars; every turn is
    written, so its plan stays short. Ends when all edges form stars around a least node.
    """
    now = store(_both_ways(edges).where("a > b").distinct(), "edges")
    while _tangled(now):
        for larger in (True, False):
            around = _both_ways(now) if larger else now
            least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("m", "a").alias("m"))
            hung = around.join(least, F.col("a") == F.col("c"))
            if larger:
                moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
            now = moved.where("a <> b").distinct()
        now = store(now, "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _tangled(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one and others on it."""
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast(edges.schema["b"].dataType).alias("b")))
    seen = ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("b").alias("up"), F.count(F.lit(1)).alias("n"))
    return not seen.where("low <> high or (up > 0 and up < n)").isEmpty()
