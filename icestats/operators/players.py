"""Player tables: seasons, game logs, weekly roll-ups, indices, spread within teams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from icestats.functions.clock import clock_seconds, seconds_text
from icestats.functions.scalars import ratio, split_saves
from icestats.plans.slicing import exact_quantiles, ranked, tasks_for

# Skater positions and the measures of the two indices
SKATERS = ("C", "L", "R", "D")
SKATER_INDEX = ("points_per_game", "goals_per_game", "assists_per_game", "plus_minus", "shots_per_game", "shooting_pct", "toi_per_game")
GOALIE_INDEX = ("save_pct", "gaa_inv", "wins", "shutouts", "saves_per_game")
MIN_INDEX_ROWS = 5
# Games needed for an index, and the summed measures of skater tables
SKATER_GAMES, GOALIE_GAMES = 20, 15
SKATER_SUMS = (
    "goals", "assists", "points", "plus_minus", "pim", "hits", "power_play_goals", "shots", "blocked_shots", "shifts", "giveaways", "takeaways",
)


def regular_seasons(df: DataFrame, kind: str = "season_type") -> DataFrame:
    """Regular season only; a missing type counts as regular (2)."""
    return df.filter(F.coalesce(F.col(kind).try_cast("int"), F.lit(2)) == 2)


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coercing cast of text measures to double."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def skater_rates(df: DataFrame) -> DataFrame:
    gp = F.col("games_played")
    return df.filter(F.col("position").isin(*SKATERS)).withColumns(
        {
            **{f"{m}_per_game": ratio(F.col(m), gp) for m in ("points", "goals", "assists", "shots")},
            "shooting_pct": ratio(F.col("goals"), F.col("shots")), "toi_per_game": ratio(F.col("time_on_ice"), gp),
        }
    ).withColumn("toi_text", seconds_text(F.col("toi_per_game")))


def goalie_rates(df: DataFrame) -> DataFrame:
    gp = F.col("games_played")
    return df.filter(F.col("position") == "G").withColumns(
        {
            "saves_per_game": ratio(F.col("saves"), gp), "win_pct": ratio(F.col("wins"), gp),
            "save_pct": ratio(F.col("saves"), F.col("saves") + F.col("goals_against")), "gaa_inv": -ratio(F.col("goals_against"), gp),
        }
    )


def performance_index(df: DataFrame, measures: Sequence[str], *, season: str = "season", min_games: int = 20) -> DataFrame:
    """Mean z-score over the measures within a season; empty for seasons of under five rows.

    Means and deviations come from one aggregation joined back, not from a window that
    would hold a season in one task.
    """
    rows = df.filter(F.col("games_played") >= min_games)
    stat = rows.groupBy(season).agg(
        F.count(F.lit(1)).alias("_n"), *[f(m).alias(f"{p}_{m}") for m in measures for p, f in (("_mu", F.avg), ("_sd", F.stddev_samp))]
    ).filter(F.col("_n") >= MIN_INDEX_ROWS)
    z = lambda m: F.when(F.col(f"_mu_{m}").isNotNull(), F.when(F.col(f"_sd_{m}") > 0, (F.col(m) - F.col(f"_mu_{m}")) / F.col(f"_sd_{m}")).when(F.col(f"_sd_{m}") == 0, F.lit(0.0)))
    joined = rows.join(stat, season).withColumn("_z", F.array_compact(F.array(*[z(m) for m in measures])))
    mean = F.try_divide(F.aggregate("_z", F.lit(0.0), lambda a, x: a + x), F.size("_z").cast("double"))
    return joined.withColumn("ppi", F.round(mean, 3)).select(*df.columns, "ppi")


def team_codes(rows: DataFrame) -> DataFrame:
    """Own and opponent code on every row of a game, from the one row per side that has it.

    The rows are counted first, so that they set the number of tasks that sort them.
    """
    tasks, _ = tasks_for(rows)
    if tasks:
        # where rows come from a join by game, Spark would drop a shuffle into as many partitions as its own have, which it deals out by bytes
        own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks - (tasks == own), "gameid")
    w = W.partitionBy("gameid")
    code = lambda s: F.max(F.when(F.col("side") == s, F.col("code"))).over(w)
    out = rows.withColumns({"_h": code("home"), "_a": code("away")})
    home = F.col("side") == "home"
    return out.withColumns({"own_team": F.when(home, F.col("_h")).otherwise(F.col("_a")), "opp_team": F.when(home, F.col("_a")).otherwise(F.col("_h"))}).drop("_h", "_a")


def seasons(df: DataFrame) -> DataFrame:
    return df.select("season").distinct().orderBy(F.col("season").desc())


def player_list(df: DataFrame, key: str = "player_id") -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def game_log(df: DataFrame, player: int) -> DataFrame:
    return df.filter(F.col("player_id") == player)


def _weekly_frame(df: DataFrame) -> DataFrame:
    return df.withColumn("week_start", F.to_date(F.date_trunc("week", "game_date")))


def _opponents() -> Column:
    # a set of team codes: its size is that of the league, not of the data
    return F.array_join(F.array_sort(F.collect_set("opponent")), ", ").alias("opponents")


def weekly_skater(df: DataFrame) -> DataFrame:
    """Player weeks (from Monday): sums, games, ice time, mean faceoff share, opponents, first team."""
    first = F.struct("game_date", "gameid", "team")
    return _weekly_frame(df).groupBy("player_id", "week_start").agg(
        *[F.sum(m).alias(m) for m in SKATER_SUMS], F.count(F.lit(1)).alias("games"),
        seconds_text(F.sum(F.coalesce(clock_seconds(F.col("toi")), F.lit(0)))).alias("toi"), F.avg("faceoff_pct").alias("faceoff_pct"),
        _opponents(), F.min_by("team", first).alias("team"),
    )


def weekly_goalie(df: DataFrame) -> DataFrame:
    """Goalie weeks: saves, shots, goals against, decisions, save share, goals per game, opponents, first team."""
    s, f = split_saves(F.col("save_text"))
    rows = _weekly_frame(df).withColumns({"_s": s, "_f": f})
    out = rows.groupBy("player_id", "week_start").agg(
        F.count(F.lit(1)).alias("games"), F.sum("_s").alias("saves"), F.sum("_f").alias("faced"), F.sum("goals_against").alias("ga_week"),
        F.count_if(F.col("decision") == "W").alias("wins"), F.count_if(F.col("decision") == "L").alias("losses"), _opponents(),
        F.min_by("team", F.struct("game_date", "gameid", "team")).alias("team"),
    )
    return out.withColumns({"save_pct": F.round(ratio(F.col("saves"), F.col("faced")), 3), "gaa": F.round(ratio(F.col("ga_week"), F.col("games")), 2)})


def mode_by(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Most frequent value; the smallest of equally frequent ones."""
    c = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_c"), F.col(column))).alias(out))


def season_rollup(df: DataFrame) -> DataFrame:
    """Player season over all teams: sums, means and the last team by games."""
    return df.groupBy("player_id", "season").agg(
        *[F.sum(m).alias(m) for m in ("games_played", "goals", "assists", "points", "plus_minus", "shots")],
        F.avg("time_on_ice").alias("mean_toi"), F.max_by("team", F.struct("games_played", "team")).alias("team"),
    )


def summary_with_mode(df: DataFrame) -> DataFrame:
    """Player season: sums and means of all skater measures, ice time, modal name, last team in date order.

    The mean share is taken over decimals, so that it does not depend on the order of rows.
    """
    keys = ["player_id", "season"]
    rows = df.withColumn("season", F.year("game_date"))
    last = F.struct("game_date", "gameid", "team")
    s = rows.groupBy(*keys).agg(
        F.max_by("team", last).alias("team"), F.count(F.lit(1)).alias("games"), *[F.sum(m).alias(m) for m in SKATER_SUMS],
        *[F.avg(m).alias(f"mean_{m}") for m in SKATER_SUMS], F.sum(F.coalesce(clock_seconds(F.col("toi")), F.lit(0))).alias("toi_seconds"),
        F.avg(F.col("faceoff_pct").cast("decimal(20,10)")).alias("faceoff_pct"),
    )
    return s.join(mode_by(rows, keys, "name", "name"), keys)


def within_team(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sum, deviation, mean, 95th and 40th percentile and minimum per team-season and measure."""
    keys = ["season", "team"]
    long = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(keys, list(measures), "measure", "v")
    by = [*keys, "measure"]
    base = long.groupBy(*by).agg(F.sum("v").alias("total"), F.stddev_samp("v").alias("std"), F.avg("v").alias("mean"), F.min("v").alias("low"))
    return base.join(exact_quantiles(long, by, "v", {"p95": 0.95, "p40": 0.40}), by)


def split_at_p95(df: DataFrame, measure: str) -> DataFrame:
    """Players at or above and at or below their team's 95th percentile (equal ones in both)."""
    cut = exact_quantiles(df, ["season", "team"], measure, {"p95": 0.95})
    rows = df.join(cut, ["season", "team"])
    side = F.explode(F.array_compact(F.array(F.when(F.col(measure) >= F.col("p95"), F.lit("high")), F.when(F.col(measure) <= F.col("p95"), F.lit("low")))))
    return rows.withColumn("side", side)


def position_spread(df: DataFrame, measure: str) -> DataFrame:
    return df.groupBy("season", "team", "position").agg(F.stddev_samp(measure).alias("std"))


def median_minutes(df: DataFrame) -> DataFrame:
    """Player-team-season: games, goals and the exact median of minutes."""
    keys = ["player_id", "season", "team"]
    rows = df.withColumns({"season": F.year("game_date"), "minutes": clock_seconds(F.col("toi")) / F.lit(60.0)})
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), F.sum("goals").alias("goals"))
    return base.join(exact_quantiles(rows, keys, "minutes", {"median_minutes": 0.5}), keys)


def origin_table(df: DataFrame, origin: str, top: int = 8) -> DataFrame:
    """Origins (colleges) by distinct players, the first `top`."""
    return df.groupBy(origin).agg(F.count_distinct("player_id").alias("players")).orderBy(F.desc("players"), origin).limit(top)


def career_means(df: DataFrame, top: int = 20) -> DataFrame:
    """Career means per player with the last position, best point means first."""
    c = df.groupBy("player_id").agg(
        F.max_by("position", "season").alias("position"), F.sum("games_played").alias("games"), F.avg("points").alias("mean_points"), F.count(F.lit(1)).alias("seasons")
    )
    return c.orderBy(F.desc("mean_points"), "player_id").limit(top)


def goalies_by_gaa(df: DataFrame, min_games: int = 10) -> DataFrame:
    """Goalies with enough games, ranked by goals against per game within the season."""
    g = df.filter((F.col("position") == "G")).groupBy("player_id", "season").agg(F.sum("games_played").alias("games"), F.sum("goals_against").alias("ga"))
    g = g.filter(F.col("games") >= min_games).withColumn("gaa", ratio(F.col("ga"), F.col("games")))
    return ranked(g, ["season"], "gaa", "player_id", "rank", descending=False)
