"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph (a line, cut further at sentence ends) is hashed into three cells, each holding
a count, the XOR of digests and the XOR of their check hashes. The cells of two versions
subtract; a cell left with one digest gives it away, taking it out of its other cells may
leave more such cells, and so on. What cannot be peeled is tried again with larger sketches.
DataFrame functions only: cells are rows, and all rows of a document stay in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import store, table

BREAK = r"\n|(?<=[.!?])[\x20\t]+"
CELLS = 4  # per hash function in the stored fingerprint
ROUNDS = 2
GROW = 4
SLICE_ROWS, MOST_SLICES = 2000, 1024


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs that are not blank, in text order."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BREAK), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _cell(key: str, j: int, m: str) -> str:
    return f"cast({j} * {m} + pmod(xxhash64({key}, {j}), {m}) as bigint)"


def fingerprint(keys: Column, cells: int = CELLS) -> Column:
    """Hex text of the sketch: the number of digests, then count, digests and checks of each cell."""
    def one(c: Column) -> Column:
        def inside(k: Column) -> Column:
            return F.pmod(F.xxhash64(k, F.floor(c / cells).cast("int")), F.lit(cells)) == c % cells

        own = F.filter(keys, inside)
        xor = F.aggregate(own, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(k))
        check = F.aggregate(own, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.xxhash64(k, F.lit(99))))
        return F.concat_ws(".", F.hex(F.size(own)), F.hex(xor), F.hex(check))

    return F.lower(F.concat_ws("-", F.hex(F.size(keys)), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 * cells - 1)), one), "-")))


def differences(pairs: DataFrame, rounds: int = ROUNDS, grow: int = GROW) -> DataFrame:
    """(rid, t, n_a, n_b, n_diff) of pairs (rid, t, a, b) of digest arrays; (rid, t) names a pair.

    Pairs that do not peel go on with sketches `grow` times as large.
    """
    left, found = pairs.withColumn("m", F.greatest(F.lit(CELLS), F.size("a") + F.size("b")).cast("long")), []
    while True:
        rows = store(_peel(left, rounds).groupBy("rid", "t").agg(
            F.max(F.when(F.col("cell") == -2, F.col("cnt"))).alias("n_a"), F.max(F.when(F.col("cell") == -2, F.col("key"))).alias("n_b"),
            F.coalesce(F.max(F.when(F.col("cell") == -1, F.col("cnt"))), F.lit(0)).alias("n_diff"), F.count(F.when(F.col("cell") >= 0, 1)).alias("stuck"),
        ), "peeled")
        found.append(rows.where("stuck = 0").drop("stuck"))
        failed = rows.where("stuck > 0").select("rid", "t")
        if failed.isEmpty():
            break
        left = left.join(failed, ["rid", "t"], "left_semi").withColumn("m", F.col("m") * grow)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def recovered(pairs: DataFrame, rounds: int = 6 * ROUNDS) -> DataFrame:
    """(rid, t, digest, side) that one sketch of each pair gives away; side 1: only in a, -1: only in b."""
    sized = pairs.withColumn("m", F.greatest(F.lit(CELLS), F.size("a") + F.size("b")).cast("long"))
    return _peel(sized, rounds, True).where("cell = -1").select("rid", "t", F.col("tag").alias("digest"), F.col("cnt").cast("int").alias("side"))


def _peel(pairs: DataFrame, rounds: int, name: bool = False) -> DataFrame:
    """Cells of a minus cells of b, peeled: rows (cell -1: recovered, -2: sizes, else what is left).

    Recovered digests are counted in one row of a pair, or with `name` stand in rows of their own.
    """
    def puts(side: str, sign: int) -> str:
        return f"flatten(transform({side}, k -> array(" + ", ".join(
            f"named_struct('cell', {_cell('k', j, 'm')}, 'tag', 0L, 'cnt', {sign}L, 'key', k, 'chk', xxhash64(k, 99))" for j in range(3)
        ) + ")))"

    sizes = "array(named_struct('cell', -2L, 'tag', 0L, 'cnt', cast(size(a) as bigint), 'key', cast(size(b) as bigint), 'chk', 0L))"
    keys = ("rid", "t", "m", "cell", "tag")
    sums = (F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    rows = pairs.repartition("rid").select("rid", "t", "m", F.expr(f"inline(concat({sizes}, {puts('a', 1)}, {puts('b', -1)}))"))
    full = "cell < 0 or cnt <> 0 or key <> 0 or chk <> 0"
    rows = rows.groupBy(*keys).agg(*sums).where(full)
    for step in range(3 * rounds):
        s = step % 3  # one hash function at a time: a digest stands in one of its cells
        others = ", ".join(
            f"named_struct('cell', {_cell('key', j, 'm')}, 'tag', 0L, 'cnt', -cnt, 'key', key, 'chk', chk)" for j in range(3) if j != s
        )
        pure = f"cell >= {s} * m and cell < {s + 1} * m and abs(cnt) = 1 and xxhash64(key, 99) = chk"
        own = "named_struct('cell', cell, 'tag', tag, 'cnt', cnt, 'key', key, 'chk', chk)"
        gone = "named_struct('cell', -1L, 'tag', key, 'cnt', cnt, 'key', key, 'chk', chk)" if name else "named_struct('cell', -1L, 'tag', 0L, 'cnt', 1L, 'key', 0L, 'chk', 0L)"
        rows = rows.select("rid", "t", "m", F.expr(f"inline(if({pure}, array({gone}, {others}), array({own})))"))
        rows = rows.groupBy(*keys).agg(*sums).where(full)
    return rows


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, keys, next_text, next_keys): the next row by descending id, after the last the first.

    The ids are cut into slices at their quantiles; each slice gets one more row, the first
    of the next slice. Null ids come last, equal ids are ordered by a hash of the text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.agg(F.count(F.lit(1))).first()[0]
    count = max(1, min(MOST_SLICES, n // SLICE_ROWS))
    edges = (rows.agg(F.percentile_approx("id", [i / count for i in range(1, count)], 10000)).first()[0] if count > 1 else None) or []
    at = F.lit(0)
    if edges:
        edge = F.array(*map(F.lit, sorted(set(edges))))
        at = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(edge, lambda e: e <= F.col("id"))))
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", F.xxhash64("text").alias("h"))
    rows = rows.select("id", "text", digests(F.col("text")).alias("keys"), at.cast("int").alias("slice"), order.alias("o"))
    heads = rows.groupBy("slice").agg(F.max(F.struct("o", "text", "keys")).alias("top"))
    by_slice = Window.orderBy("slice")  # one row per slice
    wrap = F.coalesce(F.lead("slice").over(by_slice), F.min("slice").over(Window.partitionBy()))
    heads = heads.select(wrap.alias("slice"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "top.text", "top.keys", F.lit(True).alias("head"), F.lit(None).cast(rows.schema["o"].dataType).alias("o"))
    both = rows.withColumn("head", F.lit(False)).unionByName(heads)
    after = Window.partitionBy("slice").orderBy(F.col("head"), F.col("o").desc())
    following = F.lead(F.struct("text", "keys")).over(after)
    return both.withColumn("f", following).where("not head").select("id", "text", "keys", F.col("f.text").alias("next_text"), F.col("f.keys").alias("next_keys"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text replaces the last half by as much of the next document's start. Likeness
    is the share of common paragraph digests among all of both texts, from the peeled
    difference; two texts without paragraphs are alike (1). Null texts count as empty, a
    single document is its own next one, equal rows give equal rows, an empty table an
    empty result.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    known = with_next(docs, id_col, text_col).withColumn("edited", edited)
    known = store(known.select(
        F.monotonically_increasing_id().alias("rid"), "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.size("keys").alias("na"), F.size("next_keys").alias("nn"), F.concat("keys", "next_keys", digests(F.col("edited"))).alias("all"),
    ), "versions")
    cut = known.withColumn("a", F.expr("slice(all, 1, na)")).withColumn("e", F.expr("slice(all, na + nn + 1, size(all))")).withColumn("b", F.expr("slice(all, na + 1, nn)"))
    pairs = cut.select("rid", "a", F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("e").alias("b")), F.struct(F.lit(1).alias("t"), F.col("b").alias("b")))).alias("p")).select("rid", "p.t", "a", "p.b")
    got = differences(pairs)
    total = F.col("n_a") + F.col("n_b")
    likeness = F.when(total == 0, 1.0).otherwise((total - F.col("n_diff")) / (total + F.col("n_diff")))
    near = got.withColumn("near", likeness).groupBy("rid").agg(F.max(F.when(F.col("t") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("t") == 1, F.col("near"))).alias("near_next"))
    prints = cut.select("rid", F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("a"), cells).alias("fingerprint"), fingerprint(F.col("e"), cells).alias("edited_fingerprint"))
    return prints.join(near, "rid").drop("rid")


@query("op10_paragraph_sketches")
def op10(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
