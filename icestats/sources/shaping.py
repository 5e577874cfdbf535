"""Nested league feeds to flat tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icestats.functions.names import drop_columns_like
from icestats.schemas import BOX_FEED, ODDS_FEED, PLAY, PLAY_FEED


def owner_code(owner: Column, home_id: Column, home: Column, away_id: Column, away: Column) -> Column:
    """Team code of an owner id; an unknown or missing id stays null."""
    return F.when(owner == home_id, home).when(owner == away_id, away)


def play_rows(feeds: DataFrame, json: str = "json") -> DataFrame:
    """Play-by-play feed texts to the 33 play columns."""
    f = feeds.select(F.from_json(F.col(json), PLAY_FEED).alias("g")).select("g.*")
    p = f.select("id", "season", "gameType", "gameDate", "homeTeam", "awayTeam", F.explode("plays").alias("p"))
    d = lambda n: F.col(f"p.details.{n}")
    values = {
        "gameid": F.col("id"), "idx_season": F.col("season"), "season_idx": F.col("gameType"), "game_date": F.to_date("gameDate"),
        "event_id": F.col("p.eventId"), "time_in_period": F.col("p.timeInPeriod"), "time_remaining": F.col("p.timeRemaining"),
        "period_number": F.col("p.periodDescriptor.number"), "period_type": F.col("p.periodDescriptor.periodType"),
        "type_desc_key": F.col("p.typeDescKey"), "reason": d("reason"),
        "event_owner_team": owner_code(d("eventOwnerTeamId"), F.col("homeTeam.id"), F.col("homeTeam.abbrev"), F.col("awayTeam.id"), F.col("awayTeam.abbrev")),
        "x_coord": d("xCoord"), "y_coord": d("yCoord"), "zone_code": d("zoneCode"), "home_team_defending_side": F.col("p.homeTeamDefendingSide"),
        "losing_player_id": d("losingPlayerId"), "winning_player_id": d("winningPlayerId"), "shot_type": d("shotType"),
        "away_sog": d("awaySOG"), "home_sog": d("homeSOG"), "shooting_player_id": d("shootingPlayerId"), "blocking_player_id": d("blockingPlayerId"),
        "goalie_in_net_id": d("goalieInNetId"), "scoring_player_id": d("scoringPlayerId"), "assist1_player_id": d("assist1PlayerId"),
        "assist2_player_id": d("assist2PlayerId"), "hitting_player_id": d("hittingPlayerId"), "hittee_player_id": d("hitteePlayerId"),
        "desc_key": d("descKey"), "duration": d("duration"), "committed_by_player_id": d("committedByPlayerId"), "drawn_by_player_id": d("drawnByPlayerId"),
    }
    names = [c.strip().split(" ")[0] for c in PLAY.split(",")]
    return p.select(*[values[n].alias(n) for n in names])


def roster_rows(feeds: DataFrame, json: str = "json") -> DataFrame:
    """Roster part of the feed to one row per player."""
    f = feeds.select(F.from_json(F.col(json), PLAY_FEED).alias("g"))
    r = f.select("g.id", "g.homeTeam", "g.awayTeam", F.explode("g.rosterSpots").alias("r"))
    return r.select(
        F.col("id").alias("gameid"), "r.headshot",
        owner_code(F.col("r.teamId"), F.col("homeTeam.id"), F.col("homeTeam.abbrev"), F.col("awayTeam.id"), F.col("awayTeam.abbrev")).alias("team_tri"),
        F.col("r.playerId").alias("player_id"), F.col("r.sweaterNumber").alias("sweater_number"), F.col("r.positionCode").alias("position_code"),
        F.col("r.firstName.default").alias("first_name"), F.col("r.lastName.default").alias("last_name"),
    )


def box_player_rows(feeds: DataFrame, json: str = "json") -> DataFrame:
    """Box feed: both sides × position groups to player rows with team, venue and date."""
    g = feeds.select(F.from_json(F.col(json), BOX_FEED).alias("g")).select("g.*")

    def side(s: str, name: str) -> Column:
        lines = F.col(f"playerByGameStats.{s}")
        everyone = F.flatten(F.array_compact(F.array(lines["forwards"], lines["defense"], lines["goalies"])))
        return F.struct(F.lit(name).alias("side"), F.col(f"{s}.abbrev").alias("team"), everyone.alias("players"))

    sides = g.select("id", "gameDate", F.explode(F.array(side("awayTeam", "away"), side("homeTeam", "home"))).alias("s"))
    return sides.select(F.col("id").alias("gameid"), F.to_date("gameDate").alias("game_date"), "s.side", "s.team", F.explode("s.players").alias("p")).select(
        "gameid", "game_date", "side", "team", "p.*"
    )


def team_box_rows(players: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Player rows summed to team rows."""
    return players.groupBy("gameid", "game_date", "side", "team").agg(*[F.sum(m).alias(m) for m in measures])


def odds_rows(feeds: DataFrame, json: str = "json") -> DataFrame:
    """Odds feed: one row per game and description with both sides' values.

    Both odds lists of a game are at hand in one row, so they are matched on the
    description inside the row; nothing is joined.
    """
    f = feeds.select(F.from_json(F.col(json), ODDS_FEED).alias("o")).select("o.*")
    g = f.select("lastUpdatedUTC", "bettingPartner", F.explode("games").alias("g"))
    # a description that a side repeats counts with its first value
    names = F.array_distinct(F.transform("g.awayTeam.odds", lambda x: x["description"]))
    first = lambda d: F.get(F.filter("g.awayTeam.odds", lambda x: x["description"] == d), F.lit(0))["value"]
    away = F.map_from_arrays(names, F.transform(names, first))
    h = g.withColumn("_away", away).select("*", F.explode("g.homeTeam.odds").alias("h"))
    return h.filter(F.map_contains_key("_away", F.col("h.description"))).select(
        F.col("g.gameType").alias("game_type"), F.col("g.gameId").alias("gameid"), F.col("g.homeTeam.abbrev").alias("home"),
        F.col("g.awayTeam.abbrev").alias("away"), F.col("h.description").alias("description"), F.col("h.value").alias("home_line"),
        F.element_at("_away", F.col("h.description")).alias("away_line"), F.col("bettingPartner.name").alias("partner"),
        F.col("g.startTimeUTC").alias("start_time"), F.col("lastUpdatedUTC").alias("updated"),
    )


def club_rows(skaters: DataFrame, goalies: DataFrame) -> DataFrame:
    """Skaters and goalies in one table; goalies get their position, localised names leave."""
    both = drop_columns_like(skaters, r"^(first|last)Name\.(?!default)").unionByName(
        drop_columns_like(goalies, r"^(first|last)Name\.(?!default)").withColumn("position", F.lit("G")), allowMissingColumns=True
    )
    return both
