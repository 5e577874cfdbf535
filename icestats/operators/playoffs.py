"""Playoff series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icestats.plans.slicing import running_total


def with_series(rows: DataFrame) -> DataFrame:
    """Series label of a game row: both teams in alphabetical order."""
    return rows.withColumn("series", F.concat_ws("-", F.least("team", "opponent"), F.greatest("team", "opponent")))


def series_games(rows: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Game number within the series and the length of the series (two rows per game)."""
    length = rows.groupBy("season", "series").agg((F.count(F.lit(1)) / 2).alias("series_length"))
    out = running_total(rows, ("season", "series", "team"), ("game_date", "gameid"), {"series_game": F.lit(1)}, slice_by=slice_by)
    return out.withColumn("series_game", F.col("series_game").cast("int")).join(length, ["season", "series"])


def rounds_reached(rows: DataFrame) -> DataFrame:
    return rows.groupBy("season", "team").agg(F.count_distinct("series").alias("rounds"))


def series_lengths(rows: DataFrame) -> DataFrame:
    """How many series of each length a season had."""
    n = rows.groupBy("season", "series").agg((F.count(F.lit(1)) / 2).cast("int").alias("games"))
    return n.groupBy("season", "games").agg(F.count(F.lit(1)).alias("series"))


def champion(rows: DataFrame) -> DataFrame:
    """Winner of the last game of the season."""
    return rows.filter(F.col("win") == 1).groupBy("season").agg(F.max_by("team", F.struct("game_date", "gameid")).alias("champion"))


def in_playoffs(regular: DataFrame, playoff: DataFrame) -> DataFrame:
    return regular.join(playoff.select("season", "team").distinct(), ["season", "team"], "left_semi")


def parity(table: DataFrame, measures: Sequence[str], base: int) -> DataFrame:
    """Range and deviation of each measure per season, relative to a base season."""
    wide = table.groupBy("season").agg(*[x for m in measures for x in ((F.max(m) - F.min(m)).cast("double").alias(f"{m}|r"), F.stddev_samp(m).alias(f"{m}|s"))])
    long = wide.select("season", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}|r`").alias("spread"), F.col(f"`{m}|s`").alias("std")) for m in measures])))
    ref = long.filter(F.col("season") == base).select("measure", F.col("spread").alias("_r"), F.col("std").alias("_s"))
    return long.join(ref, "measure").withColumns({"spread_index": F.try_divide(F.col("spread"), F.col("_r")), "std_index": F.try_divide(F.col("std"), F.col("_s"))}).drop("_r", "_s")
