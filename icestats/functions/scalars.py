"""Small numeric and text expressions used across the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_or(text: Column, kind: str = "bigint", default=None) -> Column:
    """Coercing cast: what cannot be read becomes null, or `default`."""
    out = text.try_cast(kind)
    return out if default is None else F.coalesce(out, F.lit(default))


def ratio(a: Column, b: Column, fallback: float | None = None) -> Column:
    """a / b; a zero denominator gives null or the fallback."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if fallback is None else F.coalesce(out, F.lit(fallback))


def split_saves(text: Column) -> tuple[Column, Column]:
    """`saves/total` text to two integers."""
    return tuple(F.regexp_extract(text, r"(\d+)/(\d+)", i).try_cast("bigint") for i in (1, 2))


def bucket(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets: label i where edges[i] < value <= edges[i+1]; else null."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (value > lo) & (value <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def at_most(value: Column, cuts: Sequence[tuple[float, str]], other: str) -> Column:
    """First label whose cut is not exceeded, else `other`."""
    out = None
    for cut, label in cuts:
        out = F.when(value <= cut, label) if out is None else out.when(value <= cut, label)
    return out.otherwise(other)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def winner(home: Column, away: Column, home_score: Column, away_score: Column) -> Column:
    """Home if it scored strictly more, else away."""
    return F.when(home_score > away_score, home).otherwise(away)


def game_key(away: Column, home: Column, date: Column) -> Column:
    return F.concat_ws("_", away, home, date.cast("string"))


def hashed_key(*parts: Column) -> Column:
    """md5 of the parts joined by `_`; null parts are skipped."""
    return F.md5(F.concat_ws("_", *parts))


def focal_value(value: Column, home: Column, focal: Column) -> Column:
    """Home-perspective value turned to the focal team."""
    return F.when(home == focal, value).otherwise(-value)


def recode(df: DataFrame, column: str, lookup: Mapping[str, str], out: str) -> DataFrame:
    """Replace labels through a small fixed lookup; unknown labels stay."""
    pairs = [F.lit(x) for kv in lookup.items() for x in kv]
    return df.withColumn(out, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)))


def strength_digits(code: Column) -> dict[str, Column]:
    """Situation code such as 1551: away goalie, away skaters, home skaters, home goalie."""
    names = ("away_goalie", "away_skaters", "home_skaters", "home_goalie")
    return {n: F.substring(code, i + 1, 1).try_cast("int") for i, n in enumerate(names)}


def even_strength(df: DataFrame, code: str = "situation_code", period: str = "period") -> DataFrame:
    """Five against five in regulation (code 1551)."""
    return df.filter((F.col(code) == "1551") & (F.col(period) <= 3))
