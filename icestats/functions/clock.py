"""Game clocks, season keys and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_SECONDS, PERIOD_MINUTES = 1200, 20


def clock_seconds(mmss: Column) -> Column:
    """`MM:SS` text to seconds; text of another form gives null."""
    part = lambda i: F.regexp_extract(mmss, r"^(\d+):(\d+)$", i).try_cast("bigint")
    return part(1) * 60 + part(2)


def clock_minutes(mmss: Column) -> Column:
    """`MM:SS` text to decimal minutes."""
    return clock_seconds(mmss) / F.lit(60.0)


def elapsed_seconds(period: Column, mmss: Column) -> Column:
    return (period - 1) * PERIOD_SECONDS + clock_seconds(mmss)


def elapsed_minutes(period: Column, mmss: Column) -> Column:
    return (period - 1) * PERIOD_MINUTES + clock_minutes(mmss)


def seconds_text(seconds: Column) -> Column:
    """Seconds to `m:ss`, both parts floored."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def season_label(start_year: Column) -> Column:
    """2024 → `2024-25`."""
    return F.concat(start_year.cast("string"), F.lit("-"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def season_key_label(key: Column) -> Column:
    """20242025 → `2024-2025`."""
    text = key.cast("string")
    return F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 4))


def season_of(date: Column, first_month: int = 10, first_day: int = 1) -> Column:
    """Year in which the season of `date` began; the cut is a parameter.

    Cuts in use: October 1, August 1, October 3 and October 15.
    """
    md = F.month(date) * 100 + F.dayofmonth(date)
    return F.when(md >= first_month * 100 + first_day, F.year(date)).otherwise(F.year(date) - 1)


def game_id_season(game_id: Column) -> Column:
    """Season from the first four digits of a ten-digit game id."""
    return F.substring(game_id.cast("string"), 1, 4).cast("int")


def game_id_type(game_id: Column) -> Column:
    """Game type (02 regular, 03 playoff) from digits five and six."""
    return F.substring(game_id.cast("string"), 5, 2).cast("int")


def mmdd_date(mmdd: Column, year: Column) -> Column:
    """`MMDD` number plus season year to a date; three digits belong to the next year."""
    text = mmdd.cast("string")
    yr = F.when(F.length(text) == 3, year + 1).otherwise(year)
    full = F.concat(yr.cast("string"), F.lpad(text, 4, "0"))
    return F.to_date(F.try_to_timestamp(full, F.lit("yyyyMMdd")))
