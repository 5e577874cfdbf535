"""Mixing sources to target weights by pivotal dependent rounding.

Each document should stand in the mix r = target / size of its source times. The whole part
is sure; the fractions are rounded so that a source's taken words stay at their target: two
documents trade words at random until the fraction of one becomes 0 or 1, the other goes on
as the residual. Blocks of documents reduce to one residual each, blocks of residuals to one
again, up a tree. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import store, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 64


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n), one row per source.

    The total share goes by weight; a target stops at `most` times its source's size and
    the excess is shared again: the level at which it all fits comes from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("_full", "_at").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_full", "_at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_full", "_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*map(F.lit, weights))
    return (
        sizes.withColumn("_at", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(cycle, (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_full", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_at", "_level"))).over(everything)["_level"])
        .select("source", "source_size", "n", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))
    )


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pivot(seed: int) -> str:
    """Fold of a sorted array `_block` of (h, s, p): (decided h and bit, residual)."""
    one = "named_struct('h', {0}.h, 'bit', cast({0}.p as int))"
    draw = f"pmod(xxhash64(cast({seed} as int), acc.cur.h, x.h), 9007199254740992) / 9007199254740992D"
    after = (  # d words go from x to the residual (up) or back
        "named_struct('a', named_struct('h', acc.cur.h, 's', acc.cur.s, 'p', "
        "if(m.up, if(m.d1 >= m.roomy, 1D, acc.cur.p + m.d1 / acc.cur.s), if(m.d2 >= acc.cur.p * acc.cur.s, 0D, acc.cur.p - m.d2 / acc.cur.s))), "
        "'b', named_struct('h', x.h, 's', x.s, 'p', "
        "if(m.up, if(m.d1 >= x.p * x.s, 0D, x.p - m.d1 / x.s), if(m.d2 >= (1D - x.p) * x.s, 1D, x.p + m.d2 / x.s))))"
    )
    settle = (
        "if(n.a.p = 0D or n.a.p = 1D, "
        f"named_struct('done', concat(acc.done, array({one.format('n.a')})), 'cur', n.b), "
        f"named_struct('done', concat(acc.done, array({one.format('n.b')})), 'cur', n.a))"
    )
    moves = (
        "named_struct('roomy', (1D - acc.cur.p) * acc.cur.s, 'd1', least((1D - acc.cur.p) * acc.cur.s, x.p * x.s), "
        "'d2', least(acc.cur.p * acc.cur.s, (1D - x.p) * x.s))"
    )
    chance = f"named_struct('roomy', q.roomy, 'd1', q.d1, 'd2', q.d2, 'up', q.d1 + q.d2 > 0 and {draw} < q.d2 / (q.d1 + q.d2))"
    step = _let(moves, "q", _let(chance, "m", _let(after, "n", settle)))
    empty = "cast(array() as array<struct<h:bigint,bit:int>>)"
    return f"aggregate(slice(_block, 2, size(_block)), named_struct('done', {empty}, 'cur', _block[0]), (acc, x) -> {step})"


def pivotal_round(units: DataFrame, largest: int, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """(source, h, bit) from units (source, h, s, p, n): fraction p of s words in a source of n units.

    `largest` is the greatest n: it fixes the height of the tree. The last residual of a
    source is rounded to the nearer side.
    """
    current, decided, level, width = units, [], 0, block
    while True:
        spread = F.greatest(F.ceil(F.col("n") / F.lit(width)), F.lit(1)).cast("long")
        rows = current.withColumn("_b", F.pmod(F.xxhash64("h", F.lit(seed + level)), spread))
        folded = rows.groupBy("source", "n", "_b").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "h", "s", "p"))).alias("_block"))
        folded = folded.withColumn("_block", F.expr("transform(_block, x -> named_struct('h', x.h, 's', x.s, 'p', x.p))"))
        folded = store(folded.select("source", "n", F.expr(_pivot(seed + level)).alias("f")).select("source", "n", "f.done", "f.cur"), "pivot")
        decided.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.h", "d.bit"))
        current = folded.select("source", "n", "cur.*")
        if width >= largest:
            break
        level, width = level + 1, width * block
    out = current.select("source", "h", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("bit"))
    for part in decided:
        out = out.unionByName(part)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """One row per different (source, id, size): n_rows, copies, source_size, target.

    `copies` counts the copies of all `n_rows` equal rows together. Null sources are one
    source, last in order; null texts have size 0; equal rows are rounded together (their
    whole part is sure), so a row repeated very often stays one unit. An empty table gives
    an empty result. Reruns agree: draws depend on ids, sizes and the seed only.
    """
    unit = (
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
        .groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("h", F.xxhash64("source", "id", "size"))
    )
    unit = store(unit, "units")
    sizes = unit.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = store(targets(sizes, weights, share, most), "goal")
    largest = goal.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = (
        unit.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_mass", F.round(rate * F.col("n_rows"), 9))
        .withColumn("sure", F.floor("_mass")).withColumn("p", F.col("_mass") - F.col("sure"))
        .drop("_source", "_mass")
    )
    open_ = full.where("p > 0").select("source", "n", "h", F.greatest("size", F.lit(1)).cast("double").alias("s"), "p")
    bits = pivotal_round(open_, largest, block, seed).withColumnRenamed("source", "_source").withColumnRenamed("h", "_h")
    joined = full.join(bits, full["source"].eqNullSafe(bits["_source"]) & (full["h"] == bits["_h"]), "left")
    drawn = store(joined.select("source", "id", "size", "n_rows", "h", "n", "source_size", "target", "sure", "p", F.coalesce("bit", F.lit(0)).alias("bit")), "drawn")
    # the rest of a source's last residual goes to the one document whose change closes the gap best
    gap = drawn.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * (F.col("sure") + F.col("bit")))).alias("gap"))
    gap = gap.withColumnRenamed("source", "_source")
    change = F.col("size") * (1 - 2 * F.col("bit"))
    closing = (
        drawn.where("p > 0").join(gap, drawn["source"].eqNullSafe(gap["_source"]))
        .groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - change).alias("left"), F.col("h"), F.abs("gap").alias("now"))).alias("c"))
        .where("c.left < c.now").select(F.col("source").alias("_source"), F.col("c.h").alias("_h"))
    )
    out = drawn.join(closing, drawn["source"].eqNullSafe(closing["_source"]) & (drawn["h"] == closing["_h"]), "left")
    bit = F.when(F.col("_h").isNotNull(), 1 - F.col("bit")).otherwise(F.col("bit"))
    return out.select("source", "id", "size", "n_rows", (F.col("sure") + bit).cast("long").alias("copies"), "source_size", "target")


def per_row(units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document again: id, size, source_size, target, taken words."""
    each = units.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    base = F.floor(F.col("copies") / F.col("n_rows"))
    copies = base + F.when(F.col("_i") <= F.col("copies") - base * F.col("n_rows"), 1).otherwise(0)
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of `docs` left out, once or repeated; columns unchanged."""
    units = mixed(docs, id_col, text_col, source_col, **options).select(
        F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("n_rows").alias("_n"), F.col("copies").alias("_copies")
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("size", word_count(F.col(f"row.`{text_col}`")))
    same = rows["row"][source_col].eqNullSafe(units["_source"]) & rows["row"][id_col].eqNullSafe(units["_id"]) & (rows["size"] == units["_size"])
    met = rows.join(units.where("_copies > 0"), same)
    once = met.where("_n = 1").select("row", F.col("_copies").alias("k"))
    order = Window.partitionBy("_source", "_id", "_size").orderBy(F.xxhash64(F.col(f"row.`{text_col}`")))
    base = F.floor(F.col("_copies") / F.col("_n"))
    more = met.where("_n > 1").withColumn("_i", F.row_number().over(order))
    more = more.select("row", (base + F.when(F.col("_i") <= F.col("_copies") - base * F.col("_n"), 1).otherwise(0)).cast("long").alias("k"))
    return once.unionByName(more).where("k > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select("row.*")


@query("op6_pivotal_mix")
def op6(spark, sf_dir):
    return per_row(mixed(table(spark, sf_dir, "documents")))
