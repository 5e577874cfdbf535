"""Distribution tests and resampling on value counts.

Everything starts from counts of distinct values per group, so the work after the
first aggregation depends on distinct values and no group is gathered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icestats.functions.tails import kolmogorov_tail, normal_tail_column
from icestats.plans.slicing import SLICE_ROWS, exact_quantiles, running_total, slices_needed, value_slices


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )


def ecdf(df: DataFrame, group: str, value: str, slice_by: Column | str | None = None) -> DataFrame:
    """Share of values at or below each distinct value."""
    counts = value_counts(df, group, value)
    total = counts.groupBy("g").agg(F.sum("c").alias("n"))
    run = running_total(counts, ["g"], ["v"], {"cum": "c"}, slice_by=slice_by)
    return run.join(total, "g").select(F.col("g").alias(group), F.col("v").alias(value), (F.col("cum") / F.col("n")).alias("share"))


def ks_pairs(df: DataFrame, group: str, value: str, slice_by: Column | str | None = None) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov statistic for every unordered pair of groups.

    `group` holds a few labels (categories); each count row is sent to the pairs its
    label takes part in.
    """
    counts = value_counts(df, group, value)
    labels = counts.agg(F.array_sort(F.collect_set("g"))).scalar()
    other = F.explode(F.filter(F.col("_l"), lambda x: x != F.col("g")))
    rows = counts.withColumn("_l", labels).withColumn("o", other).drop("_l").withColumns(
        {"a": F.least("g", "o"), "b": F.greatest("g", "o")}
    )
    merged = rows.groupBy("a", "b", "v").agg(
        F.sum(F.when(F.col("g") == F.col("a"), F.col("c")).otherwise(0)).alias("ca"),
        F.sum(F.when(F.col("g") == F.col("b"), F.col("c")).otherwise(0)).alias("cb"),
    )
    run = running_total(merged, ["a", "b"], ["v"], {"ra": "ca", "rb": "cb"}, slice_by=slice_by)
    sizes = merged.groupBy("a", "b").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    gap = F.abs(F.col("ra") / F.col("na") - F.col("rb") / F.col("nb"))
    out = run.join(sizes, ["a", "b"]).groupBy("a", "b").agg(F.max(gap).alias("ks"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    return out.withColumn("p", kolmogorov_tail(en * F.col("ks")))


def mann_whitney(df: DataFrame, flag: str, value: str, slice_by: Column | str | None = None) -> DataFrame:
    """U statistic of two groups (`flag` true / false) with tie-corrected normal p-value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.lit(1).alias("k"), F.col(value).cast("double").alias("v")).agg(
        F.sum(F.col(flag).cast("bigint")).alias("c1"), F.count(F.lit(1)).alias("c")
    )
    run = running_total(counts, ["k"], ["v"], {"before": "c"}, include_current=False, slice_by=slice_by)
    rank = F.col("before") + (F.col("c") + 1) / 2
    agg = run.agg(
        F.sum(F.col("c1") * rank).alias("r1"), F.sum("c1").cast("double").alias("n1"), F.sum("c").cast("double").alias("n"),
        F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("ties"),
    )
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    top = F.greatest(u, n1 * n2 - u)
    z = (top - n1 * n2 / 2 - 0.5) / sigma
    return agg.select(u.alias("u"), n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), z.alias("z")).withColumn("p", F.least(F.lit(1.0), normal_tail_column("z")))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, *, descending: bool = True) -> DataFrame:
    """Rank with ties sharing their mean position, from counts of distinct values."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", -F.col("_v") if descending else F.col("_v"))
    cut = value_slices(counts, keys, "_o", slices_needed(counts, keys, SLICE_ROWS))
    run = running_total(cut, keys, ["_o"], {"_before": "_c"}, include_current=False, slice_by=F.col("_share_slice"))
    ranks = run.select(*keys, F.col("_v").alias(value), (F.col("_before") + (F.col("_c") + 1) / 2).alias("rank"))
    return df.join(ranks, [*keys, value])


def maxwell_fit(df: DataFrame, keys: Sequence[str], value: str, loc: float = 0.0) -> DataFrame:
    """Moment fit of the Maxwell–Boltzmann scale and the log-likelihood at it.

    All needed sums come from one aggregation: Σ1, Σ(x-loc)², Σ ln(x-loc).
    """
    d = F.col(value) - loc
    s = df.filter(F.col(value) > loc).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("s2"), F.sum(F.ln(d)).alias("sl")
    )
    scale = F.sqrt(F.col("s2") / F.col("n") / 3)
    like = F.col("n") * (F.ln(F.sqrt(F.lit(2.0) / F.pi())) - 3 * F.ln(F.col("scale"))) + 2 * F.col("sl") - F.col("s2") / (2 * F.col("scale") * F.col("scale"))
    return s.withColumn("scale", scale).withColumn("log_likelihood", like).select(*keys, "n", "scale", "log_likelihood")


def proportion_error(hits: Column, n: Column) -> tuple[Column, Column]:
    """Share and its standard error."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    return p, F.sqrt(p * (1 - p) / n)


def conditional_shares(df: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """P(outcome | keys) from counts; totals per key come from a window over the counts."""
    from pyspark.sql import Window as W

    c = df.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(*keys))
    return c.withColumn("total", total).withColumn("p", F.col("count") / F.col("total"))


def bootstrap_shares(
    df: DataFrame, keys: Sequence[str], outcome: str, *, replicates: int = 10_000, sample: int = 5_000, alpha: float = 0.1, seed: int = 7
) -> DataFrame:
    """Bootstrap interval of P(outcome | keys).

    Drawing rows with replacement only changes the cell counts, which are multinomial.
    The table of cells has one row per label combination; replicates are spread over tasks.
    """
    cells = df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys], F.col(outcome).cast("string").alias(outcome)).agg(F.count(F.lit(1)).alias("n")).toPandas()
    cells = cells.sort_values([*keys, outcome], na_position="first").reset_index(drop=True)
    share = (cells["n"] / cells["n"].sum()).to_numpy()
    group = cells.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
    spark = df.sparkSession

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for r in pdf["id"]:
                c = np.random.default_rng([seed, int(r)]).multinomial(sample, share)
                total = np.bincount(group, weights=c)[group]
                parts.append(pd.DataFrame({"cell": np.arange(len(c), dtype="int32"), "p": np.where(total > 0, c / np.maximum(total, 1), np.nan)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"cell": [], "p": []})

    drawn = spark.range(replicates).mapInPandas(draw, "cell int, p double").filter(~F.isnan("p"))
    q = exact_quantiles(drawn, ["cell"], "p", {"low": alpha / 2, "median": 0.5, "high": 1 - alpha / 2})
    names = spark.createDataFrame(cells.assign(cell=np.arange(len(cells), dtype="int32")))
    return names.join(q, "cell").drop("cell")
