"""Distances between arenas, road trips, home-ice summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.functions.geo import ellipsoidal, great_circle, point_lon_lat, travel_hours
from icestats.plans.slicing import exact_quantiles, since_marker


def arena_points(arenas: DataFrame) -> DataFrame:
    lon, lat = point_lon_lat(F.col("geometry"))
    return arenas.select("team", lon.alias("lon"), lat.alias("lat"))


def distance_table(schedule: DataFrame, arenas: DataFrame) -> DataFrame:
    """Both distances for every ordered pair (home, away) of the schedule.

    Pairs come from the games, so they are an aggregate of the data and no cross join;
    in a full schedule they are all ordered pairs of teams.
    """
    pts = arena_points(arenas)
    side = lambda n: pts.select(F.col("team").alias(n), F.col("lon").alias(f"lon_{n}"), F.col("lat").alias(f"lat_{n}"))
    p = schedule.select("home", "away").distinct().join(side("home"), "home").join(side("away"), "away")
    args = [F.col(c) for c in ("lon_home", "lat_home", "lon_away", "lat_away")]
    return p.select("home", "away", great_circle(*args).alias("haversine"), ellipsoidal(*args).alias("ellipsoidal")).withColumn("hours", travel_hours(F.col("haversine")))


def with_distance(games: DataFrame, distances: DataFrame) -> DataFrame:
    return games.join(distances.select("home", "away", "haversine"), ["home", "away"], "left")


def mean_distance(distances: DataFrame) -> DataFrame:
    return distances.groupBy("home").agg(F.avg("haversine").alias("mean_distance")).orderBy(F.desc("mean_distance"))


def flown(games: DataFrame, arenas: DataFrame) -> DataFrame:
    """`games` with the haversine `distance` between both teams' arenas; null where one is unknown."""
    at = lambda end: arenas.select(F.col("team").alias(end), F.col("lon").alias(f"_lon_{end}"), F.col("lat").alias(f"_lat_{end}"))
    out = games.join(at("home"), "home", "left").join(at("away"), "away", "left")
    metres = great_circle(*(F.col(f"_{c}_{end}") for end in ("home", "away") for c in ("lon", "lat")))
    return out.withColumn("distance", metres).drop(*[f"_{c}_{end}" for end in ("home", "away") for c in ("lon", "lat")])


def road_trips(rows: DataFrame, distance: str = "distance", slice_by=None) -> DataFrame:
    """Position within the current run of away games and the distance so far in it.

    Both are sums since the last home game, so neither a long trip nor a team with very
    many games ends in one task. A home game has 0 of both.
    """
    sums = {"trip_game": F.lit(1), "trip_distance": F.col(distance)}
    return since_marker(rows, ("season", "team"), ("game_date", "gameid"), F.col("side") != "away", sums, slice_by=slice_by)


def equal_count_bucket(df: DataFrame, value: str, n: int, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bucket 0..n-1 by quantile edges, right-closed; equal values stay together."""
    by = list(keys) or ["_k"]
    rows = df if keys else df.withColumn("_k", F.lit(1))
    edges = exact_quantiles(rows, by, value, {f"_e{i}": i / n for i in range(1, n)})
    below = sum((F.when(F.col(f"_e{i}") < F.col(value), 1).otherwise(0) for i in range(1, n)), F.lit(0))
    b = rows.join(edges, by).withColumn(out, F.when(F.col(value).isNotNull(), below))
    return b.drop("_k", *[f"_e{i}" for i in range(1, n)])


def win_rate(df: DataFrame, keys: Sequence[str], win: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(win).alias("win_rate"), F.count(F.lit(1)).alias("games"))


def nearest_date(df: DataFrame, date: str, target: str) -> DataFrame:
    """The stored date closest to the target; of two equally close ones the newer."""
    gap = F.date_diff(F.col(date), F.lit(target).cast("date"))
    return df.agg(F.min_by(date, F.struct(F.abs(gap), -gap)).alias(date))


def trusted_places(places: DataFrame, key: str, confidence: str) -> DataFrame:
    """Rows of the highest confidence per key; ties stay."""
    top = places.groupBy(key).agg(F.max(confidence).alias("_top"))
    return places.join(top, key).filter(F.col(confidence) == F.col("_top")).drop("_top")
