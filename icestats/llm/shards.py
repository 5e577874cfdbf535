"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into cells; each cell belongs to the next virtual node clockwise. A row's
key (its text, so that copies meet) picks the cell. Shards hold a bounded number of rows:
what finds its shard full goes on clockwise to the next shard with room. Rows of a cell are
spread over sub-cells, so that a text with very many copies is counted and numbered in
parts; only counts per sub-cell, a number fixed by the ring, reach the driver.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import store, table

POINTS = 64
COUNTED = 32768  # sub-cells at most


def ring(shards: int, points: int = POINTS, seed: int = 17) -> list[int]:
    """The owner of each cell, clockwise."""
    cells = 2
    while cells < 2 * shards * points:
        cells *= 2
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "big"), s)
        for s in range(shards) for v in range(points)
    )
    owner, at = [], 0
    for c in range(cells):
        while at < len(nodes) and nodes[at][0] * cells < c << 64:
            at += 1
        owner.append(nodes[at % len(nodes)][1])
    return owner


def room(total: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold: with no slack they differ by one at most."""
    if slack > 0:
        return [-(-int(total * (1 + slack) + shards) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[tuple[int, int], int], owner: list[int], shards: int, slack: float) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (cell, sub, first rank, end rank, shard, first slot) in the order of the ring."""
    left, held, out = room(sum(counts.values()), shards, slack), [0] * shards, []
    for (cell, sub), n in sorted(counts.items()):
        done, at = 0, cell
        while done < n:
            s = owner[at % len(owner)]
            take = min(left[s], n - done)
            if take:
                out.append((cell, sub, done, done + take, s, held[s]))
                left[s] -= take
                held[s] += take
                done += take
            at += 1
            if at > cell + len(owner):  # a shard without a cell of its own
                owner = [*owner, *(s for s in range(shards) if left[s])]
    return out


def ring_shards(docs: DataFrame, shards: int = 8, key: Column | None = None, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS, slack: float = 0.0, seed: int = 17) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slots are gapless from 0 in a shard.

    `key` (default: the text) picks the place on the ring. Null texts count as empty ones;
    repeated rows are placed each; ties are broken by id and size, and equal rows are
    interchangeable. An empty table gives an empty result. `slack` 0.05 lets a shard
    exceed the mean by 5 %, which moves fewer rows when shards are added.
    """
    owner = ring(shards, points, seed)
    subs = max(1, COUNTED // len(owner))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = text if key is None else key
    rows = store(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 65 - len(owner).bit_length()).cast("int").alias("_cell"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(subs)).cast("int").alias("_sub"),
    ), "ring")
    counts = {(r["_cell"], r["_sub"]): r["n"] for r in rows.groupBy("_cell", "_sub").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = walk(counts, owner, shards, slack)
    names = ("_cell", "_sub", "_from", "_end", "_shard", "_slot")
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    cols = list(zip(*pieces)) if pieces else [()] * 6
    plan = docs.sparkSession.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}))
    order = Window.partitionBy("_cell", "_sub").orderBy("_id", "_size", "_crc")
    numbered = rows.withColumn("_rank", (F.row_number().over(order) - 1).cast("long"))
    placed = numbered.join(plan, ["_cell", "_sub"]).where("_rank >= _from and _rank < _end")
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"),
    )


@query("op7_ring_shards")
def op7(spark, sf_dir):
    placed = ring_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
