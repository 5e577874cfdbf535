"""Small relational operators: top-k, latest row, lags, ranks, set operations, widening."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from icestats.plans.slicing import lagged


def top_k(df: DataFrame, k: int, by: str, key: str) -> DataFrame:
    """Global top-k with a stable tie-break; each task keeps k rows."""
    return df.orderBy(F.desc(by), key).limit(k)


def row_of_maximum(df: DataFrame, keys: Sequence[str], by: str, tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, tie)).alias("b")).select(*keys, "b.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the earliest: an aggregate, so copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b")).select(*keys, "b.*")


def lag_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], depth: int = 2, slice_by=None) -> DataFrame:
    """`c_lag1` … `c_lagN` of the rows before."""
    return lagged(df, keys, order, columns, depth, slice_by=slice_by)


def dense_rank_of(df: DataFrame, keys: Sequence[str], by: str, out: str) -> DataFrame:
    """Dense rank from the distinct values of a key."""
    d = df.select(*keys, by).distinct().withColumn(out, F.dense_rank().over(W.partitionBy(*keys).orderBy(by)))
    return df.join(d, [*keys, by])


def values_of(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Distinct values over several columns."""
    return reduce(DataFrame.unionByName, [df.select(F.col(c).alias(out)) for c in columns]).distinct()


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def not_in(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def widen(base: DataFrame, reports: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Left joins on the key; of a repeated column the first copy stays."""
    out = base
    for r in reports:
        new = [c for c in r.columns if c not in out.columns]
        out = out.join(r.select(*key, *new), list(key), "left")
    return out


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Remove a name suffix as a whole, not its letters."""
    return df.toDF(*[c[: -len(suffix)] if suffix and c.endswith(suffix) else c for c in df.columns])
