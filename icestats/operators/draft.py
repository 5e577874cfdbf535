"""Draft classes and careers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from icestats.functions.scalars import at_most, bucket, recode
from icestats.operators.rows import dense_rank_of
from icestats.plans.slicing import exact_quantiles

# Buckets of years since the draft and of the pick, games needed to count as
# active, bins of career games, position groups
YEAR_CUTS, YEAR_REST = ((3, "0-3"), (6, "4-6"), (9, "7-9")), "10+"
PICK_CUTS, PICK_REST = ((5, "1-5"), (10, "6-10")), "11+"
ACTIVE_GAMES, LAST_YEAR = 40, 10
GAME_EDGES, GAME_LABELS = (-1, 0, 99, 399, 799, float("inf")), ("0", "1-99", "100-399", "400-799", "800+")
POSITION_GROUPS = {"Center": ("C", "C/RW", "C/LW"), "Winger": ("LW", "RW", "LW/RW", "F"), "Defenseman": ("D",)}
MERGED_FORWARDS = {"F": "F (multiple)", "C/RW": "F (multiple)", "C/LW": "F (multiple)", "LW/RW": "F (multiple)"}


def draft_with_points(draft: DataFrame, points: DataFrame, keys: Sequence[str] = ("first_name", "last_name")) -> DataFrame:
    """Draft rows with season points by name; unmatched rows leave.

    Names alone are not unique: add the draft year to `keys` where the points have it.
    """
    p = points.select(*keys, *[F.col(c).alias(f"{c}_stats") for c in points.columns if c not in keys])
    return draft.join(p, list(keys))


def career_attributes(career: DataFrame, draft: DataFrame, league: str = "NHL", game_type: int = 2) -> DataFrame:
    """Regular-season career lines with years since the draft, year in the league and buckets."""
    rows = career.filter((F.col("league") == league) & (F.col("game_type") == game_type) & F.col("season").isNotNull())
    rows = rows.join(draft, "id").withColumn("years_since_draft", F.col("season") - F.col("draft_year"))
    rows = dense_rank_of(rows, ["id"], "season", "league_year")
    return rows.filter(F.col("years_since_draft") >= 0).withColumns(
        {
            "since_bucket": at_most(F.col("years_since_draft"), YEAR_CUTS, YEAR_REST),
            "pick_bucket": at_most(F.col("overall_pick"), PICK_CUTS, PICK_REST),
            "points_per_game": F.try_divide(F.col("points").cast("double"), F.col("games_played").cast("double")),
        }
    )


def exceptional_seasons(attrs: DataFrame, q: float = 0.95) -> DataFrame:
    """Seasons above the percentile of points of their year in the league."""
    cut = exact_quantiles(attrs, ["league_year"], "points", {"cut": q})
    return attrs.join(cut, "league_year").filter(F.col("points") > F.col("cut")).drop("cut")


def repeatedly_exceptional(exceptional: DataFrame) -> DataFrame:
    n = exceptional.groupBy("id", "first_name", "last_name", "overall_pick").agg(F.count(F.lit(1)).alias("seasons"))
    return n.filter(F.col("seasons") > 1).orderBy(F.desc("seasons"), "overall_pick", "id")


def progression(attrs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean points with the distances from the median to the 2.5 and 97.5 percentiles."""
    base = attrs.groupBy(*keys).agg(F.avg("points").alias("mean"), F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(attrs, keys, "points", {"_l": 0.025, "_m": 0.5, "_h": 0.975})
    out = base.join(q, list(keys))
    enough = F.col("n") >= 2
    gap = lambda a, b: F.when(enough, F.greatest(F.lit(0.0), F.col(a) - F.col(b))).otherwise(0.0)
    return out.select(*keys, "mean", "n", gap("_m", "_l").alias("below"), gap("_h", "_m").alias("above"))


def position_mix(draft: DataFrame) -> DataFrame:
    return recode(draft, "position", MERGED_FORWARDS, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def early_outliers(attrs: DataFrame, first: int = 50, second: int = 60) -> DataFrame:
    """Whole careers of players above 50 points in year one or 60 in year two."""
    hit = ((F.col("league_year") == 1) & (F.col("points") > first)) | ((F.col("league_year") == 2) & (F.col("points") > second))
    return attrs.join(attrs.filter(hit).select("id").distinct(), "id", "left_semi")


def cohort(draft: DataFrame, *, rounds: Sequence[int] | None = None, picks: tuple[int, int] | None = None, groups: Sequence[str] = tuple(POSITION_GROUPS), years: tuple[int, int] = (0, 9999)) -> DataFrame:
    """Drafted players by rounds or pick range, position groups and draft years."""
    codes = [c for g in groups for c in POSITION_GROUPS[g]]
    keep = F.col("draft_round").isin(*rounds) if rounds is not None else F.col("overall_pick").between(*picks)
    return draft.filter(keep & F.col("position").isin(*codes) & F.col("draft_year").between(*years))


def cohort_games(cohort_rows: DataFrame, career: DataFrame) -> DataFrame:
    """Games per season of the cohort, zero to ten years after the draft."""
    c = career.filter(F.col("league") == "NHL").groupBy("id", "season").agg(F.sum("games_played").alias("games"))
    j = c.join(cohort_rows.select("id", "draft_year"), "id").withColumn("ysd", F.col("season") - F.col("draft_year"))
    return j.filter(F.col("ysd").between(0, LAST_YEAR))


def _years(df: DataFrame) -> DataFrame:
    return df.withColumn("ysd", F.explode(F.sequence(F.lit(0), F.lit(LAST_YEAR))))


def survival(cohort_rows: DataFrame, games: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Active share of drafted players by years since the draft (optionally per draft year)."""
    by = list(keys) or ["_k"]
    tag = lambda d: d if keys else d.withColumn("_k", F.lit(1))
    drafted = tag(cohort_rows).groupBy(*by).agg(F.count(F.lit(1)).alias("drafted"))
    active = tag(games).filter(F.col("games") >= ACTIVE_GAMES).groupBy(*by, "ysd").agg(F.count_distinct("id").alias("active"))
    out = _years(drafted).join(active, [*by, "ysd"], "left").fillna(0, ["active"])
    return out.withColumn("percent", F.col("active") / F.col("drafted") * 100).drop("_k")


def first_active(cohort_rows: DataFrame, games: DataFrame) -> DataFrame:
    """Running share of drafted players who have been active once."""
    first = games.filter(F.col("games") >= ACTIVE_GAMES).groupBy("id").agg(F.min("ysd").alias("first"))
    counts = first.groupBy("first").agg(F.count(F.lit(1)).alias("c"))
    drafted = cohort_rows.agg(F.count(F.lit(1)).alias("drafted"))
    years = _years(drafted)
    # eleven years at most: each count is spread over the years from its own on
    later = counts.select("c", F.explode(F.sequence(F.col("first"), F.lit(LAST_YEAR))).alias("ysd")).groupBy("ysd").agg(F.sum("c").alias("reached"))
    return years.join(later, "ysd", "left").fillna(0, ["reached"]).withColumn("percent", F.col("reached") / F.col("drafted") * 100)


def career_distribution(cohort_rows: DataFrame, career: DataFrame) -> DataFrame:
    """Players by career games in fixed bins, empty bins included."""
    total = career.filter(F.col("league") == "NHL").groupBy("id").agg(F.sum("games_played").alias("g"))
    rows = cohort_rows.join(total, "id", "left").withColumn("games_group", bucket(F.coalesce(F.col("g"), F.lit(0)), GAME_EDGES, GAME_LABELS))
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("games_group") == b).alias(f"b{i}") for i, b in enumerate(GAME_LABELS)])
    items = [F.struct(F.lit(b).alias("games_group"), F.col(f"b{i}").alias("players"), (F.try_divide(F.col(f"b{i}").cast("double"), F.col("n").cast("double")) * 100).alias("percent")) for i, b in enumerate(GAME_LABELS)]
    return wide.select(F.inline(F.array(*items)))


def top_per_season(df: DataFrame, k: int, by: str, *, best: bool = True, key: str = "player_id") -> DataFrame:
    """Top (or bottom) k per season; the rank filter lets Spark cut each map task to k rows."""
    order = F.col(by).desc() if best else F.col(by).asc()
    return df.withColumn("rank", F.row_number().over(W.partitionBy("season").orderBy(order, key))).filter(F.col("rank") <= k)


def one_season_wonders(tops: DataFrame, key: str = "player_id") -> DataFrame:
    """Players in the top list of exactly one season."""
    return tops.groupBy(key).agg(F.count_distinct("season").alias("n")).filter(F.col("n") == 1).select(key)


def map_of_names(df: DataFrame) -> DataFrame:
    """One id per (first, last, draft year): the lowest."""
    return df.groupBy("first_name", "last_name", "draft_year").agg(F.min("id").alias("id"))
