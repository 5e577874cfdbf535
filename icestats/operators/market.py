"""Betting lines: selection, joins with outcomes, margin removal, market accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icestats.functions import odds as O
from icestats.plans.slicing import running_total


def load_odds(odds: DataFrame, exclude_country: str = "CA") -> DataFrame:
    """Decimal odds of both sides, one country left out (a missing tag stays)."""
    keep = F.coalesce(F.col("country") != exclude_country, F.lit(True)) if "country" in odds.columns else F.lit(True)
    return odds.filter(keep).withColumns(
        {"dec_home": O.american_to_decimal(F.col("home_line")), "dec_away": O.american_to_decimal(F.col("away_line"))}
    )


def load_outcomes(games: DataFrame, game_type: Column | None = None) -> DataFrame:
    """Finished regular-season games with win flags of both sides."""
    rows = games if game_type is None else games.filter(game_type == 2)
    h, a = F.col("home_goals"), F.col("away_goals")
    return rows.select(
        "gameid", "season", "game_date", "home", "away", "home_goals", "away_goals",
        (h > a).cast("bigint").alias("home_win"), (a > h).cast("bigint").alias("away_win"),
    )


LINE_KEYS = ("gameid", "description", "partner")


def latest_by_key(odds: DataFrame, keys: tuple[str, ...] = LINE_KEYS) -> DataFrame:
    """(keys, b): the other columns of each key's latest update; for tables and streams."""
    rest = [c for c in odds.columns if c not in keys]
    return odds.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated", "home_line", "away_line")).alias("b"))


def latest_lines(odds: DataFrame, keys: tuple[str, ...] = LINE_KEYS, tasks: int | None = None) -> DataFrame:
    """Latest update per key; a map-side aggregate, so repeated pulls never pile up in one task.

    The aggregate sorts its rows; where pulls seldom repeat, `tasks` deals them out first.
    """
    return latest_by_key(odds if tasks is None else odds.repartition(tasks, *keys), keys).select(*keys, "b.*")


def closing_lines(odds: DataFrame, keys: tuple[str, ...] = ("gameid", "description")) -> DataFrame:
    """Latest update strictly before the start of the game."""
    return latest_lines(odds.filter(F.col("updated") < F.col("start_time")), keys)


def scoreboard_lines(odds: DataFrame) -> DataFrame:
    """Two-way money line, one row per game: the latest, then the first partner by name."""
    rows = odds.filter((F.col("description") == "MONEY_LINE_2_WAY") & F.col("updated").isNotNull())
    latest = rows.groupBy("gameid", "partner").agg(F.max(F.struct("updated", "home_line", "away_line")).alias("b")).select("gameid", "partner", "b.*")
    newest = latest.groupBy("gameid").agg(F.max("updated").alias("updated"))
    pick = F.min_by(F.struct("home_line", "away_line", "partner"), "partner")
    return latest.join(newest, ["gameid", "updated"]).groupBy("gameid").agg(pick.alias("b")).select("gameid", "b.*")


def natural_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], slice_by: Column | str | None = None) -> DataFrame:
    """Left rows with the right row of the same natural key, one to one, where the key repeats.

    The repeats of a key are numbered on both sides in the given orders and paired by number; left
    rows beyond the right side's repeats keep nulls. `slice_by` cuts a key with very many repeats.
    """
    one = lambda df, order: running_total(df, keys, order, {"_repeat": F.lit(1)}, slice_by=slice_by)
    r = one(right, right_order).select("_repeat", *keys, *[c for c in right.columns if c not in keys])
    return one(left, left_order).join(r, [*keys, "_repeat"], "left").drop("_repeat")


def odds_with_outcomes(odds: DataFrame, outcomes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Lines joined to outcomes on game, season and both teams; one row per (game, description).

    `tasks` deals out the lines by game before they are sorted, as in `latest_lines`.
    """
    game = ["gameid", "season", "home", "away"]
    lines = odds if tasks is None else odds.repartition(tasks, *game)
    return latest_lines(lines, (*game, "description")).join(outcomes.drop("game_date"), game)


def analytical_matrix(outcomes: DataFrame, priors: DataFrame) -> DataFrame:
    """Home and away pre-game measures on each game and their home − away deltas.

    Joined on (game, team), so a game keeps one row.
    """
    measures = ("cf_pct", "ff_pct", "pythagorean")

    def side(s: str) -> DataFrame:
        return priors.select(
            "gameid", F.col("team").alias(s), F.col("p_games").alias(f"n_{s}"), *[F.col(m).alias(f"{s}_{m}") for m in measures]
        )

    out = outcomes.join(side("home"), ["gameid", "home"], "left").join(side("away"), ["gameid", "away"], "left")
    return out.withColumns({f"delta_{m}": F.col(f"home_{m}") - F.col(f"away_{m}") for m in measures})


def remove_margin(rows: DataFrame, dec_home: str = "dec_home", dec_away: str = "dec_away", vig: str = "shin") -> DataFrame:
    """Probabilities of both sides without the margin, and the margin itself."""
    a, b = F.lit(1.0) / F.col(dec_home), F.lit(1.0) / F.col(dec_away)
    if vig == "shin":
        pa, pb, z = O.shin_two_way(a, b)
        return rows.withColumns({"prob_home": pa, "prob_away": pb, "margin": a + b - 1, "shin_z": z})
    return rows.withColumns({"prob_home": a / (a + b), "prob_away": b / (a + b), "margin": a + b - 1})


def sides_long(games: DataFrame, columns: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Game rows to (team, venue) rows; `columns` maps out-name → (home, away) columns."""
    def one(i: int, venue: str) -> Column:
        return F.struct(F.lit(venue).alias("venue"), *[F.col(c[i]).alias(o) for o, c in columns.items()])

    return games.select(*keys, F.inline(F.array(one(0, "home"), one(1, "away"))))


def sides_wide(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Home and away rows of a game back to one row, by conditional aggregation."""
    pick = lambda c, v: F.max(F.when(F.col("side") == v, F.col(c))).alias(f"{v}_{c}")
    return rows.groupBy(key).agg(*[pick(c, v) for c in columns for v in ("home", "away")])


def pair_visitor_home(rows: DataFrame, block: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Visitor row followed by home row → one game row.

    `seq` is the row number within the block (a season's sheet), starting at 0;
    consecutive rows share seq div 2, which is the pairing key.
    """
    pair = F.floor(F.col(seq) / 2)
    pick = lambda c, odd: F.max(F.when(F.col(seq) % 2 == odd, F.col(c)))
    return rows.groupBy(*block, pair.alias("pair")).agg(
        *[pick(c, 0).alias(f"{c}_away") for c in columns], *[pick(c, 1).alias(f"{c}_home") for c in columns]
    )


def market_accuracy(lines: DataFrame) -> DataFrame:
    """Outcome (0.5 for ties), favourite by the lower line and whether it came true, per side."""
    h, a = F.col("home_goals"), F.col("away_goals")
    lh, la = F.col("home_line"), F.col("away_line")
    win_h = F.when(h > a, 1.0).when(h < a, 0.0).otherwise(0.5)
    out = lines.withColumns(
        {
            "win_home": win_h, "win_away": 1 - win_h,
            "fav_home": (lh < la).cast("double"), "fav_away": (lh > la).cast("double"),
        }
    )
    return out.withColumns(
        {"hit_home": (F.col("win_home") == F.col("fav_home")).cast("bigint"), "hit_away": (F.col("win_away") == F.col("fav_away")).cast("bigint")}
    )


def accuracy_by(rows: DataFrame, keys: list[str], hit: str, line: str, win: str) -> DataFrame:
    """Share of right predictions per group with the side the market leans to."""
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("games"),
            F.sum((F.col(line) < 100).cast("bigint")).alias("fav_win"), F.sum((F.col(line) > 100).cast("bigint")).alias("fav_loss"),
            F.sum(win).alias("wins"),
        )
        .withColumns(
            {
                "rate": F.col("hits") / F.col("games") * 100,
                "expectation": F.when(F.col("fav_win") < F.col("fav_loss"), "Lose Favorite").otherwise("Win Favorite"),
                "rate_game": F.col("wins") / F.col("games") * 100,
            }
        )
    )


# Thresholds 1, 11, ..., 591
SWEEP_FIRST, SWEEP_STEP, SWEEP_COUNT = 1, 10, 60


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """Confusion shares for every threshold, for lines that call a win and a loss.

    A row is called the same way for all thresholds below some position, so rows are
    first counted by (side, outcome, position); only these few hundred counts are
    spread over the thresholds. Input: spread, alone, win (0, 0.5, 1).
    """
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(SWEEP_COUNT), c)).cast("int")
    s = F.col("spread")
    side = F.when(F.col("alone") < 0, "win").when(F.col("alone") > 0, "loss")
    # thresholds t_j = 1 + 10 j: "win" is called while t_j < -spread, "loss" side while t_j <= spread is not met
    position = F.when(side == "win", clamp(F.ceil((-s - SWEEP_FIRST) / SWEEP_STEP))).otherwise(
        clamp(F.floor((s - SWEEP_FIRST) / SWEEP_STEP) + 1)
    )
    counts = (
        rows.withColumns({"side": side, "pos": position}).filter(F.col("side").isNotNull())
        .groupBy("side", "win", "pos").agg(F.count(F.lit(1)).alias("n"))
    )
    spread = counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SWEEP_COUNT - 1))))
    cut = F.when(F.col("side") == "win", F.col("j") < F.col("pos")).otherwise(F.col("j") >= F.col("pos")).cast("double")
    target = F.when(F.col("side") == "win", F.lit(1.0)).otherwise(F.lit(0.0))
    w = F.col("win").cast("double")
    same, mine = w == cut, w == target
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    return spread.groupBy("side", (F.col("j") * SWEEP_STEP + SWEEP_FIRST).alias("threshold")).agg(
        share(same & mine).alias("tp"), share(~same & ~mine).alias("fp"), share(~same & mine).alias("fn"), share(same & ~mine).alias("tn")
    )


def line_game_numbers(rows: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Per-team game number within the season."""
    out = running_total(rows, ("season", "team"), ("start_time", "gameid"), {"game_no": F.lit(1)}, slice_by=slice_by)
    return out.withColumn("game_no", F.col("game_no").cast("int"))
