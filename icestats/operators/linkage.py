"""Record linkage on person names.

Fuzzy pairs are found exactly, without comparing all pairs of a block. Two texts within
k edits share at least one of k+1 equal pieces of either, at nearly the same place. Each
right name is cut into such pieces; each left name sends the substrings that could equal
one. They meet in an equi-join on (block, length, piece number, text), which spreads over
the cluster whatever the size of a block. Names are made distinct first, so repeated
names are compared once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from icestats.functions.names import strip_accents

# Scores (0-100) above which a pair counts as the same person
LINK_THRESHOLD, BEST_THRESHOLD = 78, 85


def token_sort(name: Column) -> Column:
    """Lower case, no accents or punctuation, words in alphabetical order."""
    clean = F.regexp_replace(strip_accents(name), "[^\\p{L}\\p{N}]+", " ")
    return F.array_join(F.array_sort(F.split(F.trim(clean), " +")), " ")


def edit_score(a: Column, b: Column) -> Column:
    """100 · (1 − edit distance / longer length), rounded to whole."""
    top = F.greatest(F.length(a), F.length(b))
    return F.round(F.try_divide((top - F.levenshtein(a, b)) * F.lit(100.0), top.cast("double"))).cast("int")


def indel_score(a: Column, b: Column) -> Column:
    """100 · (1 − insertions and deletions / total length), rounded to whole."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def score(x: str, y: str) -> int:
            # longest common subsequence, one machine integer per text
            spots: dict[str, int] = {}
            for i, ch in enumerate(x):
                spots[ch] = spots.get(ch, 0) | (1 << i)
            full = (1 << len(x)) - 1
            row = full
            for ch in y:
                u = row & spots.get(ch, 0)
                row = ((row + u) | (row - u)) & full
            lcs = len(x) - bin(row).count("1")
            return int(200.0 * lcs / (len(x) + len(y)) + 0.5)

        return pd.Series([score(x, y) if x and y else None for x, y in zip(left, right)], dtype="Int64").astype("float64")

    return pandas_udf(run, "double")(a, b).cast("int")


def _budget(a: Column, b: Column, slack: float, method: str) -> Column:
    """Most edits a qualifying pair of these lengths can have."""
    total = F.greatest(a, b) if method == "edit" else a + b
    return F.floor(total * slack + 1e-9).cast("int")


def _partner_lengths(length: Column, slack: float, method: str) -> tuple[Column, Column]:
    """Shortest and longest partner of a text of this length."""
    factor = 1 / (1 - slack) if method == "edit" else (1 + slack) / (1 - slack)
    return F.greatest(F.lit(1), F.ceil(length / factor - 1e-9).cast("int")), F.floor(length * factor + 1e-9).cast("int")


def _piece_start(i: Column, length: Column, n: Column) -> Column:
    """Start (1-based) of piece i of n; the last pieces take the remainder."""
    return i * F.floor(length / n).cast("int") + F.greatest(F.lit(0), i - (n - length % n)) + 1


def _piece_length(i: Column, length: Column, n: Column) -> Column:
    return F.floor(length / n).cast("int") + F.when(i >= n - length % n, 1).otherwise(0)


def _each(df: DataFrame, out: str, low: Column, high: Column) -> DataFrame:
    """One row per whole number between low and high; none if the range is empty."""
    return df.withColumn("_lo", low).withColumn("_hi", high).filter(F.col("_lo") <= F.col("_hi")).withColumn(
        out, F.explode(F.sequence("_lo", "_hi"))
    ).drop("_lo", "_hi")


def similar_names(
    left: DataFrame, right: DataFrame, block: Sequence[str], *, threshold: int = LINK_THRESHOLD, method: str = "edit"
) -> DataFrame:
    """All pairs (block, name_l, name_r, score) of distinct names scoring above the threshold.

    Inputs hold the block columns and `name` (already in token order). With k the edits a
    pair of lengths may have, the right name is cut into k+1 pieces. Some piece i is then
    unchanged with i edits before it and at most k-i after, which bounds where the left
    name can hold it.
    """
    # scores are rounded to whole, so a pair may fall short of the next whole by half a point
    slack = 1 - (threshold + 0.5) / 100.0
    cols = list(block)
    names = lambda df: df.select(*cols, "name").filter(F.length("name") > 0).distinct().withColumn("_n", F.length("name"))
    n, k, i, m = F.col("_n"), F.col("_k"), F.col("_i"), F.col("_m")

    short, long = _partner_lengths(n, slack, method)
    index = _each(names(right), "_k", _budget(short, n, slack, method), _budget(long, n, slack, method))
    index = _each(index, "_i", F.lit(0), k).select(
        *cols, F.col("name").alias("name_r"), n.alias("_m"), "_k", "_i",
        F.substring(F.col("name"), _piece_start(i, n, k + 1), _piece_length(i, n, k + 1)).alias("_text"),
    )
    probe = _each(names(left), "_m", short, long).withColumn("_k", _budget(n, m, slack, method))
    probe = _each(probe, "_i", F.lit(0), k)
    start, size = _piece_start(i, m, k + 1), _piece_length(i, m, k + 1)
    shift_low, shift_high = F.greatest(-i, n - m - (k - i)), F.least(i, n - m + (k - i))
    probe = _each(probe, "_p", F.greatest(F.lit(1), start + shift_low), F.least(n - size + 1, start + shift_high)).select(
        *cols, F.col("name").alias("name_l"), "_m", "_k", "_i", F.substring(F.col("name"), F.col("_p"), size).alias("_text")
    )
    pairs = probe.join(index, [*cols, "_m", "_k", "_i", "_text"]).select(*cols, "name_l", "name_r", "_k").distinct()
    # the edit distance is never larger than insertions plus deletions: most pairs leave before they are scored
    pairs = pairs.filter(F.levenshtein("name_l", "name_r") <= k).drop("_k")
    score = edit_score if method == "edit" else indel_score
    return pairs.withColumn("score", score(F.col("name_l"), F.col("name_r"))).filter(F.col("score") > threshold)


#: Joined rows that one piece of a key makes, and that one task makes.
PIECE_ROWS, TASK_ROWS = 1_000_000, 4_000_000


def _multiplied(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """An equi-join whose output grows with the square of a repeated key, spread by its output.

    Its input is small, so Spark would leave it to few tasks. The joined rows are counted first;
    the left rows of a key that makes many are dealt over pieces, and its right rows meet each.
    """
    keys = list(on)
    count = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    sizes = count(left, "_a").join(count(right, "_b"), keys).select(*keys, (F.col("_a") * F.col("_b")).alias("_rows"))
    total = int(sizes.agg(F.sum(F.col("_rows").cast("decimal(38,0)"))).first()[0] or 0)
    if total <= PIECE_ROWS:
        return left.join(right, keys, how)
    # a key never needs more pieces than it has left rows
    pieces = sizes.filter(F.col("_rows") > PIECE_ROWS).select(*keys, F.ceil(F.col("_rows") / PIECE_ROWS).cast("int").alias("_n"))
    n, tasks = F.coalesce("_n", F.lit(1)), -(-total // TASK_ROWS)
    tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    l = left.join(pieces, keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop("_n")
    r = right.join(pieces, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    keys.append("_piece")
    return l.repartition(tasks, *keys).join(r.repartition(tasks, *keys), keys, how).drop("_piece")


def exact_links(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows with their exact partner, or a null partner; repeated names multiply."""
    return _multiplied(left, right, on, "left")


class Links(NamedTuple):
    """Links in factors: edges between distinct names, and the ids that bear each name.

    `edges` (block, name_l, name_r, score), `left` (block, name_l, id), `right` (block, name_r, id).
    """

    edges: DataFrame
    left: DataFrame
    right: DataFrame
    block: tuple[str, ...]
    left_id: str
    right_id: str


def fuzzy_links(
    left: DataFrame, right: DataFrame, block: Sequence[str], *, left_id: str, right_id: str, name: str,
    threshold: int = LINK_THRESHOLD, method: str = "edit",
) -> Links:
    """Links of all rows of one block whose names score above the threshold.

    Rows with equal names share their edges, so the size grows with names and rows, not with
    pairs of rows; `pairs` writes them out.
    """
    l, r = (d.select(*block, i, token_sort(F.col(name)).alias("name")) for d, i in ((left, left_id), (right, right_id)))
    edges = similar_names(l, r, block, threshold=threshold, method=method)
    return Links(edges, l.withColumnRenamed("name", "name_l"), r.withColumnRenamed("name", "name_r"), tuple(block), left_id, right_id)


def pairs(links: Links) -> DataFrame:
    """Every linked pair of ids; repeated names multiply."""
    out = _multiplied(links.edges.join(links.left, [*links.block, "name_l"]), links.right, [*links.block, "name_r"], "inner")
    return out.select(*links.block, links.left_id, links.right_id, "score")


def _classes(rows: DataFrame, block: Sequence[str], name: str, key: str, least: str, n: str) -> DataFrame:
    return rows.groupBy(*block, name).agg(F.min(key).alias(least), F.count(F.lit(1)).alias(n))


def class_links(links: Links) -> DataFrame:
    """Edges between classes of equal names: (block, left_rep, right_rep, n_left, n_right, score); a
    class is named by its least id."""
    l = _classes(links.left, links.block, "name_l", links.left_id, "left_rep", "n_left")
    r = _classes(links.right, links.block, "name_r", links.right_id, "right_rep", "n_right")
    out = links.edges.join(l, [*links.block, "name_l"]).join(r, [*links.block, "name_r"])
    return out.select(*links.block, "left_rep", "right_rep", "n_left", "n_right", "score")


def members(links: Links) -> DataFrame:
    """(block, left id, left_rep, n_links) of every left row: its class and how many right rows it is linked with."""
    l = _classes(links.left, links.block, "name_l", links.left_id, "left_rep", "_n").drop("_n")
    r = _classes(links.right, links.block, "name_r", links.right_id, "_least", "_n").drop("_least")
    n = links.edges.join(r, [*links.block, "name_r"]).groupBy(*links.block, "name_l").agg(F.sum("_n").alias("n_links"))
    rows = links.left.join(l, [*links.block, "name_l"]).join(n, [*links.block, "name_l"], "left")
    return rows.select(*links.block, links.left_id, "left_rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def best_links(links: Links, threshold: int = BEST_THRESHOLD) -> DataFrame:
    """(block, left id, right id, score, n_partners): best partner of each left row at or above the
    threshold; ties go to the lower id, `n_partners` rows bear its name.

    The best is picked per name, among one row per right name; ids follow for the winner.
    """
    block, right_id = list(links.block), links.right_id
    r = _classes(links.right, block, "name_r", right_id, "_r", "n_partners")
    top = links.edges.filter(F.col("score") >= threshold).join(r, [*block, "name_r"]).groupBy(*block, "name_l").agg(
        F.min_by(F.struct(F.col("_r").alias(right_id), "score", "n_partners"), F.struct(-F.col("score"), "_r")).alias("b")
    )
    return links.left.join(top, [*block, "name_l"]).select(*block, links.left_id, "b.*")


def _two_phases(left: DataFrame, right: DataFrame, exact: DataFrame, block: Sequence[str], left_id: str, right_id: str, name: str, method: str) -> tuple[DataFrame, Links]:
    """Left rows with their partners in `exact` (of the same name), and the fuzzy links of those without."""
    first = exact_links(left.select(*block, name, left_id), exact, [*block, name])
    found = first.filter(F.col(right_id).isNotNull()).withColumns({"score": F.lit(100), "phase": F.lit("exact")})
    rest = first.filter(F.col(right_id).isNull()).select(*block, name, left_id)
    return found, fuzzy_links(rest, right.select(*block, name, right_id), block, left_id=left_id, right_id=right_id, name=name, method=method)


def linked_people(left: DataFrame, right: DataFrame, block: Sequence[str], *, left_id: str, right_id: str, name: str, method: str = "edit") -> DataFrame:
    """Every link: all exact matches first, all fuzzy ones for the rest, in one table with its `phase`."""
    found, links = _two_phases(left, right, right.select(*block, name, right_id), block, left_id, right_id, name, method)
    columns = [*block, left_id, right_id, "score", "phase"]
    return found.select(*columns).unionByName(pairs(links).withColumn("phase", F.lit("fuzzy")).select(*columns))


def link_people(left: DataFrame, right: DataFrame, block: Sequence[str], *, left_id: str, right_id: str, name: str, method: str = "edit") -> DataFrame:
    """One row per linked left row: exact name first, for the rest the best fuzzy partner, with its `phase`."""
    exact = right.groupBy(*block, name).agg(F.min(right_id).alias(right_id), F.count(F.lit(1)).alias("n_partners"))
    found, links = _two_phases(left, right, exact, block, left_id, right_id, name, method)
    fuzzy = best_links(links, LINK_THRESHOLD + 1).withColumn("phase", F.lit("fuzzy"))
    columns = [*block, left_id, right_id, "score", "n_partners", "phase"]
    return found.select(*columns).unionByName(fuzzy.select(*columns))
