"""Typed schemas of the entities and a conform step for drifting files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAME = "gameid bigint, season int, game_date date, home string, away string, home_goals bigint, away_goals bigint"
BOX_TEAM = (
    "gameid bigint, season int, game_date date, team string, side string, goals bigint, shots bigint, blocked bigint, "
    "missed bigint, win bigint, game_end string"
)
# The 33 columns of the play-by-play files
PLAY = (
    "gameid bigint, idx_season bigint, season_idx bigint, game_date date, event_id bigint, time_in_period string, "
    "time_remaining string, period_number bigint, period_type string, type_desc_key string, reason string, "
    "event_owner_team string, x_coord double, y_coord double, zone_code string, home_team_defending_side string, "
    "losing_player_id int, winning_player_id int, shot_type string, away_sog bigint, home_sog bigint, "
    "shooting_player_id int, blocking_player_id int, goalie_in_net_id int, scoring_player_id int, assist1_player_id int, "
    "assist2_player_id int, hitting_player_id int, hittee_player_id int, desc_key string, duration int, "
    "committed_by_player_id int, drawn_by_player_id int"
)
# Nested feeds as the league publishes them
_TEAM = "struct<id:int,abbrev:string>"
_DETAILS = (
    "struct<eventOwnerTeamId:int,xCoord:double,yCoord:double,zoneCode:string,reason:string,losingPlayerId:int,winningPlayerId:int,"
    "shotType:string,awaySOG:bigint,homeSOG:bigint,shootingPlayerId:int,blockingPlayerId:int,goalieInNetId:int,scoringPlayerId:int,"
    "assist1PlayerId:int,assist2PlayerId:int,hittingPlayerId:int,hitteePlayerId:int,descKey:string,duration:int,"
    "committedByPlayerId:int,drawnByPlayerId:int>"
)
PLAY_FEED = (
    f"struct<id:bigint,season:bigint,gameType:bigint,gameDate:string,homeTeam:{_TEAM},awayTeam:{_TEAM},"
    "plays:array<struct<eventId:bigint,timeInPeriod:string,timeRemaining:string,periodDescriptor:struct<number:bigint,periodType:string>,"
    f"typeDescKey:string,homeTeamDefendingSide:string,details:{_DETAILS}>>,"
    "rosterSpots:array<struct<teamId:int,playerId:bigint,sweaterNumber:int,positionCode:string,headshot:string,"
    "firstName:struct<default:string>,lastName:struct<default:string>>>>"
)
_PLAYERS = "array<struct<playerId:bigint,position:string,goals:bigint,assists:bigint,shots:bigint,toi:string>>"
_SIDE = f"struct<forwards:{_PLAYERS},defense:{_PLAYERS},goalies:{_PLAYERS}>"
BOX_FEED = (
    f"struct<id:bigint,gameDate:string,awayTeam:{_TEAM},homeTeam:{_TEAM},"
    f"playerByGameStats:struct<awayTeam:{_SIDE},homeTeam:{_SIDE}>>"
)
_ODDS = "struct<id:int,abbrev:string,odds:array<struct<description:string,value:double>>>"
ODDS_FEED = (
    f"struct<currentOddsDate:string,lastUpdatedUTC:string,bettingPartner:struct<name:string>,"
    f"games:array<struct<gameId:bigint,gameType:int,startTimeUTC:string,homeTeam:{_ODDS},awayTeam:{_ODDS}>>>"
)


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Exactly the schema's columns: missing ones null, bad values null, extra ones dropped."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    have = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields
    ])
