"""Event sequences: context of earlier events, state carried forward, trailing windows.

An event row is (gameid, event_id, period, elapsed, type, owner, zone, ...); `elapsed`
counts whole seconds. Simultaneous events are ordered by `event_id`. Every function
takes `slice_by` or `slice_width`, which cut a long game into blocks of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from icestats.functions.scalars import clip, focal_value
from icestats.plans.slicing import context, neighbour_row, range_frame, running_total, slices_needed, tasks_for

GAME = ("gameid",)
ORDER = ("elapsed", "event_id")
# The four shot-attempt events and the nine- and thirteen-flag sets
SHOT_ATTEMPTS = ("blocked-shot", "missed-shot", "shot-on-goal", "goal")
ZONES = ("O", "D", "N")
PRIOR_DELTAS = ("delta_pythagorean", "delta_shot_share")


def attach_roles(plays: DataFrame, roster: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Team of each player role (`{out: id column}`) by one join with a game's roster map.

    A roster has a few dozen entries per game, so its map is small; a game with very
    many events is split by the skew join.
    """
    maps = (
        roster.groupBy("gameid", "player_id").agg(F.min("team").alias("team"))
        .groupBy("gameid").agg(F.map_from_entries(F.collect_list(F.struct("player_id", "team"))).alias("_m"))
    )
    out = plays.join(maps, "gameid", "left")
    return out.withColumns({o: F.try_element_at("_m", F.col(c)) for o, c in roles.items()}).drop("_m")


def attach_role(plays: DataFrame, roster: DataFrame, column: str, out: str) -> DataFrame:
    """Team of one role by a plain left join on (game, player)."""
    r = roster.select(F.col("gameid"), F.col("player_id").alias(column), F.col("team").alias(out))
    return plays.join(r, ["gameid", column], "left")


def _scorer() -> dict[str, Column]:
    return {"last_scorer": F.when(F.col("type") == "goal", F.col("owner"))}


def _penalty() -> dict[str, Column]:
    return {"_end": F.col("elapsed") + F.col("duration") * 60, "_team": F.col("drawn_team")}


def _lagged(columns: Sequence[str]) -> dict[str, str]:
    return {"_period": "period", **{f"{c}_lag1": c for c in columns}}


def _close_penalty(df: DataFrame) -> DataFrame:
    over = F.coalesce(F.col("elapsed") > F.col("_end"), F.lit(False))
    return df.withColumns({"penalty_end": F.when(~over, F.col("_end")), "penalty_team": F.when(~over, F.col("_team"))}).drop("_end", "_team")


def _same_period(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    same = F.col("_period") == F.col("period")
    return df.withColumns({f"{c}_lag1": F.when(same, F.col(f"{c}_lag1")) for c in columns}).drop("_period")


def last_scorer(plays: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Team of the latest goal strictly before the event."""
    return context(plays, GAME, ORDER, carry_before=_scorer(), slice_by=slice_by)


def penalty_state(plays: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """End and drawing team of the latest penalty; null once the end has passed."""
    return _close_penalty(context(plays, GAME, ORDER, carry=_penalty(), slice_by=slice_by))


def previous_event(plays: DataFrame, columns: Sequence[str], slice_by: Column | str | None = None) -> DataFrame:
    """Columns of the previous event of the same period (`*_lag1`)."""
    return _same_period(context(plays, GAME, ORDER, previous=_lagged(columns), slice_by=slice_by), columns)


def attribution(owner: Column, previous_owner: Column, previous_blocker: Column) -> Column:
    """Whose action follows: own, opponent's or neutral; turned around after a block."""
    own, opp = F.lit("Own action"), F.lit("Opponent action")
    differ = owner != previous_owner
    plain = F.when(owner.isNull() | previous_owner.isNull(), F.lit("Neutral")).otherwise(F.when(differ, opp).otherwise(own))
    return F.when(previous_blocker.isNotNull() & differ, own).when(previous_blocker.isNotNull() & ~differ, opp).otherwise(plain)


def posture(kind: Column, owner: Column, zone: Column, blocker: Column, previous_blocker: Column) -> Column:
    """Posture of the team that blocked before: defence, offence or neutral.

    A further block is judged by its blocker; any other event by owner and zone.
    """
    block = kind == "blocked-shot"
    mine = owner == previous_blocker
    in_d, in_o = zone == "D", zone == "O"
    defend = F.coalesce((block & (blocker == previous_blocker)), F.lit(False))
    attack = F.coalesce((block & (blocker != previous_blocker)), F.lit(False))
    by_zone = F.when((mine & in_d) | (~mine & in_o), "Defense").when((mine & in_o) | (~mine & in_d), "Offense").otherwise("Neutral")
    return F.when(defend, "Defense").when(attack, "Offense").otherwise(by_zone)


def enrich(plays: DataFrame, roster: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """The enriched event table: roles, scorer, penalty state, previous event, attribution, tags."""
    roles = {"shooter_team": "shooter_id", "blocker_team": "blocker_id", "committed_team": "committed_id", "drawn_team": "drawn_id"}
    tasks, size = tasks_for(plays)
    if tasks is not None and slices_needed(plays, GAME, size) == 1:
        plays = plays.repartition(tasks, *GAME)  # larger games are left to the skew join
    out = attach_roles(plays, roster, roles).withColumn("minutes", F.col("elapsed") / F.lit(60.0))
    lagged = ["owner", "zone", "type", "blocker_team", "blocker_id", "shooter_team", "shooter_id"]
    out = context(out, GAME, ORDER, carry_before=_scorer(), carry=_penalty(), previous=_lagged(lagged), slice_by=slice_by, tasks=tasks)
    out = _same_period(_close_penalty(out), lagged)
    return out.withColumn("action", attribution(F.col("owner"), F.col("owner_lag1"), F.col("blocker_team_lag1")))


def power_play_tags(enriched: DataFrame) -> DataFrame:
    """Power play running, goal in it, and the goal against it."""
    on = F.col("penalty_end").isNotNull()
    goal = (F.col("type") == "goal") & on
    tag = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    return enriched.withColumns(
        {"power_play": on.cast("bigint"), "pp_goal": tag(goal & (F.col("owner") == F.col("penalty_team"))), "pk_goal": tag(goal & (F.col("owner") != F.col("penalty_team")))}
    )


def event_flags(plays: DataFrame, focal: str, by_zone: bool = True) -> DataFrame:
    """0/1 flags of the focal team: 13 with hits by zone, 9 without."""
    mine, theirs = F.col("owner") == focal, F.col("owner") != focal
    flag = lambda kind, who, *more: F.when((F.col("type") == kind) & who & (more[0] if more else F.lit(True)), 1.0).otherwise(0.0)
    hits = (
        {f"hit_{n}_{z}": flag("hit", w, F.col("zone") == z) for n, w in (("for", mine), ("against", theirs)) for z in ZONES}
        if by_zone
        else {"hit_for": flag("hit", mine), "hit_against": flag("hit", theirs)}
    )
    return plays.withColumns(
        {
            **hits,
            "shot_for": flag("shot-on-goal", mine), "shot_against": flag("shot-on-goal", theirs),
            "takeaway": flag("takeaway", mine), "giveaway": flag("giveaway", mine),
            "block_for": flag("blocked-shot", mine), "block_against": flag("blocked-shot", theirs),
            "faceoff_win": flag("faceoff", mine),
        }
    )


def zone_entries(plays: DataFrame, focal: str, max_gap: int = 10, slice_by: Column | str | None = None) -> DataFrame:
    """Entry by the focal team: now in O, before in N or D, gap at most `max_gap` seconds."""
    return _zone_entry(neighbour_row(plays, GAME, ORDER, {"_z": "zone", "_t": "elapsed"}, slice_by=slice_by), focal, max_gap, "_z", "_t")


def _zone_entry(out: DataFrame, focal: str, max_gap: int, zone_before: str, time_before: str) -> DataFrame:
    """The entry flag from the previous event's zone and time, which are dropped."""
    near = F.col("elapsed") - F.col(time_before) <= max_gap
    hit = (F.col("zone") == "O") & F.col(zone_before).isin("N", "D") & near & (F.col("owner") == focal)
    return out.withColumn("zone_entry", F.when(hit, 1.0).otherwise(0.0)).drop(zone_before, time_before)


def possession(plays: DataFrame, focal: str, window: int = 90, *, left_open: bool = False, slice_by: Column | str | None = None, slice_width: int | None = None) -> DataFrame:
    """Possession gains and the focal share of events over the trailing window.

    The frame is closed at both ends; `left_open` leaves out its first second.
    """
    out = context(plays, GAME, ORDER, previous={"_o": "owner"}, slice_by=slice_by)
    return _trailing_share(out, focal, window, left_open, slice_width)


def _trailing_share(out: DataFrame, focal: str, window: int, left_open: bool, slice_width: int | None) -> DataFrame:
    """Gains from the previous owner `_o`, then the trailing frame."""
    gain = (F.col("owner") != F.col("_o")) & (F.col("owner") == focal)
    out = out.withColumn("possession_gain", F.when(gain, 1.0).otherwise(0.0)).drop("_o")
    mine = F.when(F.col("owner") == focal, 1.0).otherwise(0.0)
    out = range_frame(
        out, GAME, "elapsed", -window + int(left_open), 0,
        {"_n": F.count(F.lit(1)), "_f": F.sum(mine), "gains_trailing": F.sum("possession_gain")}, slice_width=slice_width,
    )
    return out.withColumn("zone_share", F.col("_f") / F.col("_n")).drop("_n", "_f")


def _goals(focal: str) -> dict[str, Column]:
    goal = F.col("type") == "goal"
    count = lambda who: F.when(goal & who, 1).otherwise(0)
    return {"goals_for": count(F.col("owner") == focal), "goals_against": count(F.col("owner") != focal)}


def _score(df: DataFrame) -> DataFrame:
    goals = {c: F.col(c).cast("bigint") for c in ("goals_for", "goals_against")}
    return df.withColumns(goals).withColumn("score_state", clip(F.col("goals_for") - F.col("goals_against"), -2, 2))


def score_before(plays: DataFrame, focal: str, slice_by: Column | str | None = None) -> DataFrame:
    """Goals for and against before each event, within the game, and the clipped difference."""
    return _score(context(plays, GAME, ORDER, totals_before=_goals(focal), slice_by=slice_by))


def _gap(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", F.col("elapsed") - F.coalesce(F.col("_t"), F.lit(0))).drop("_t")


def time_gap(plays: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Seconds since the previous event; the first gap is the event's own second."""
    return _gap(context(plays, GAME, ORDER, previous={"_t": "elapsed"}, slice_by=slice_by))


def running_hits(plays: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Cumulative hits of the game and of each period."""
    hit = F.when(F.col("type") == "hit", 1).otherwise(0)
    out = running_total(plays, GAME, ORDER, {"hits_so_far": hit}, slice_by=slice_by)
    out = running_total(out, ("gameid", "period"), ORDER, {"hits_in_period": hit}, slice_by=slice_by)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("hits_so_far", "hits_in_period")})


def sessions(plays: DataFrame, home: str, marker: str = "faceoff", slice_by: Column | str | None = None) -> DataFrame:
    """One row per stretch from a marker event up to the next."""
    start = F.when(F.col("type") == marker, 1).otherwise(0)
    rows = running_total(plays, GAME, ORDER, {"session": start}, slice_by=slice_by).filter(F.col("session") > 0)
    rank = F.struct(*ORDER)
    goal = F.when(F.col("type") == "goal", F.when(F.col("owner") == home, 1).when(F.col("owner").isNotNull(), -1).otherwise(0)).otherwise(0)
    return rows.groupBy("gameid", F.col("session").cast("bigint").alias("session")).agg(
        F.min("elapsed").alias("start"), (F.max("elapsed") - F.min("elapsed")).alias("duration"), F.count(F.lit(1)).alias("events"),
        F.min_by("zone", rank).alias("zone_faceoff"), F.coalesce((F.min_by("owner", rank) == home).cast("bigint"), F.lit(0).cast("bigint")).alias("won_home"),
        (F.min("zone") != F.max("zone")).cast("bigint").alias("zone_change"), F.sum(goal).cast("bigint").alias("goal"),
    )


def hit_bursts(plays: DataFrame, focal: str, slice_width: int | None = None, span: int = 120, follow: int = 60) -> DataFrame:
    """Three or more hits within `span` seconds, and the opponent's hits in the next `follow`."""
    hit = F.col("type") == "hit"
    mine, theirs = (F.when(hit & (F.col("owner") == focal), 1).otherwise(0), F.when(hit & (F.col("owner") != focal), 1).otherwise(0))
    out = range_frame(plays, GAME, "elapsed", -span, 0, {"hits_span": F.sum(mine)}, slice_width=slice_width)
    out = range_frame(out, GAME, "elapsed", 1, follow, {"_n": F.sum(theirs)}, slice_width=slice_width)
    return out.withColumns({"burst": (F.col("hits_span") >= 3).cast("bigint"), "reply_hits": F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")}).drop("_n")


def early_differential(plays: DataFrame, focal: str, seconds: int = 600) -> DataFrame:
    """Hits of the first seconds against the later share of focal events, per game."""
    hit, early, mine = F.col("type") == "hit", F.col("elapsed") < seconds, F.col("owner") == focal
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return plays.groupBy("gameid").agg(
        (n(hit & early & mine) - n(hit & early & (F.col("owner") != focal))).alias("early_hits"),
        F.try_divide(n(~early & mine).cast("double"), n(~early & F.col("owner").isNotNull()).cast("double")).alias("later_share"),
    )


def goal_soon(plays: DataFrame, focal: str, seconds: int = 60, slice_width: int | None = None) -> DataFrame:
    """1 where the focal team scores within the next seconds."""
    goal = F.when((F.col("type") == "goal") & (F.col("owner") == focal), 1).otherwise(0)
    out = range_frame(plays, GAME, "elapsed", 1, seconds, {"_g": F.max(goal)}, slice_width=slice_width)
    return out.withColumn("goal_soon", F.coalesce(F.col("_g"), F.lit(0)).cast("bigint")).drop("_g")


def next_event_rates(enriched: DataFrame) -> DataFrame:
    """Goals per following event, by previous attempt, game and whose action it is."""
    rows = enriched.filter(F.col("type_lag1").isin(*SHOT_ATTEMPTS))
    g = rows.groupBy(F.col("type_lag1").alias("category"), "gameid", "action").agg(
        F.sum((F.col("type") == "goal").cast("bigint")).alias("goals"), F.count(F.lit(1)).alias("events")
    )
    return g.withColumns({"p_game": F.col("goals") / F.col("events"), "agent": F.when(F.col("action") == "Own action", "Defending team").otherwise("Shot-attempt team")})


def category_shares(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Count, share and share of earlier categories (in order of the count) per key."""
    c = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys)
    run = w.orderBy(F.col("n").desc(), category).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("n").over(w)
    return c.withColumns({"share": F.col("n") / total * 100, "share_before": F.coalesce(F.sum("n").over(run), F.lit(0)) / total * 100})


def mean_counts(plays: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Events of each kind per game and owner, averaged over games."""
    n = {k: k.replace("-", "_") for k in kinds}
    per = plays.groupBy(*keys, "gameid", "owner").agg(*[F.sum((F.col("type") == k).cast("bigint")).alias(v) for k, v in n.items()])
    return per.groupBy(*keys, "owner").agg(*[F.avg(v).alias(v) for v in n.values()])


def count_pivot(plays: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Event counts by game and owner, one column per kind, 0 where there is none."""
    p = plays.groupBy("gameid", "owner").pivot("type", list(kinds)).agg(F.count(F.lit(1)))
    return p.select("gameid", "owner", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k.replace("-", "_")) for k in kinds])


def flow_links(df: DataFrame, layers: Sequence[str], weight: str | None = None) -> DataFrame:
    """Links between neighbouring layers with their share of all, from one count table."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*layers).agg(w.alias("n"))
    links = F.inline(F.array(*[
        F.struct(F.lit(i).alias("layer"), F.col(a).alias("source"), F.col(b).alias("target")) for i, (a, b) in enumerate(zip(layers, layers[1:]))
    ]))
    out = counts.select("n", links).groupBy("layer", "source", "target").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return out.withColumn("percent", F.col("n") / total * 100)


def master_table(plays: DataFrame, priors: DataFrame | None, focal: str, *, home: str | None = None, slice_by: Column | str | None = None, slice_width: int | None = None, window: int = 90, max_gap: int = 10) -> DataFrame:
    """Event flags, zone entries and share, score state, gaps and focal priors: the input of the momentum model.

    `priors` has the home side's differences per game; for another focal side than `home`
    (by default the focal one) they change their sign. A game without priors has 0.
    """
    out = context(
        event_flags(plays, focal), GAME, ORDER, totals_before=_goals(focal), previous={"_o": "owner", "_t": "elapsed", "_pz": "zone", "_pt": "elapsed"}, slice_by=slice_by
    )
    out = _zone_entry(out, focal, max_gap, "_pz", "_pt")
    out = _trailing_share(_gap(_score(out)), focal, window, False, slice_width)
    home = focal if home is None else home
    if priors is not None:
        found = priors.select(F.col("gameid").alias("_game"), *PRIOR_DELTAS)
        out = out.join(found, F.col("gameid") == F.col("_game"), "left").drop("_game")
        out = out.withColumns({c: focal_value(F.coalesce(c, F.lit(0.0)), F.lit(home), F.lit(focal)) for c in PRIOR_DELTAS})
    return out.withColumn("is_home", F.lit(float(focal == home)))
