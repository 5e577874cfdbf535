"""Queries of event sequences."""

from pyspark.sql import functions as F

from icestats.operators import sequence as Q
from icestats.operators import teams as T
from icestats.registry.base import query
from icestats.registry.teams import r6

col = F.col
DAY = 86400
BLOCK = f"floor(elapsed / {5 * DAY})"
WIDTH = 5 * DAY
W = "WINDOW w AS (PARTITION BY gameid ORDER BY elapsed, event_id)"

ROLES = """ro AS (SELECT p.*, a.team AS shooter_team, b.team AS blocker_team, c.team AS committed_team, d.team AS drawn_team FROM plays p
 LEFT JOIN roster a ON a.gameid = p.gameid AND a.player_id = p.shooter_id LEFT JOIN roster b ON b.gameid = p.gameid AND b.player_id = p.blocker_id
 LEFT JOIN roster c ON c.gameid = p.gameid AND c.player_id = p.committed_id LEFT JOIN roster d ON d.gameid = p.gameid AND d.player_id = p.drawn_id)"""
ENR = ROLES + """, e1 AS (SELECT *, last_value(CASE WHEN type = 'goal' THEN owner END IGNORE NULLS) OVER (PARTITION BY gameid ORDER BY elapsed, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_scorer,
 last_value(elapsed + duration * 60 IGNORE NULLS) OVER w AS pend, last_value(drawn_team IGNORE NULLS) OVER w AS pteam,
 lag(owner) OVER v AS owner_lag1, lag(zone) OVER v AS zone_lag1, lag(type) OVER v AS type_lag1, lag(blocker_team) OVER v AS blocker_team_lag1, lag(shooter_id) OVER v AS shooter_id_lag1
 FROM ro WINDOW w AS (PARTITION BY gameid ORDER BY elapsed, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY gameid, period ORDER BY elapsed, event_id)),
en AS (SELECT *, CASE WHEN elapsed > pend THEN NULL ELSE pend END AS penalty_end, CASE WHEN elapsed > pend THEN NULL ELSE pteam END AS penalty_team,
 -- the same owner acts on, and after a block the owner counts the other way round
 CASE (owner = owner_lag1) = (blocker_team_lag1 IS NULL) WHEN TRUE THEN 'Own action' WHEN FALSE THEN 'Opponent action' ELSE 'Neutral' END AS action FROM e1)"""
# whose end the play is in, seen from the team that blocked before: a block happens in the blocker's own end
POST = ENR + """, en2 AS (SELECT *, type = 'blocked-shot' AND blocker_team IS NOT NULL AS is_block FROM en WHERE type_lag1 = 'blocked-shot'),
po AS (SELECT *, CASE ((CASE WHEN is_block THEN blocker_team ELSE owner END) = blocker_team_lag1) = (CASE WHEN is_block THEN TRUE WHEN zone IN ('D', 'O') THEN zone = 'D' END)
 WHEN TRUE THEN 'Defense' WHEN FALSE THEN 'Offense' ELSE 'Neutral' END AS posture FROM en2)"""


def enriched(t):
    return Q.enrich(t.plays, t.roster, BLOCK)


def after_block(t):
    e = enriched(t).filter(col("type_lag1") == "blocked-shot")
    return e.withColumn("posture", Q.posture(col("type"), col("owner"), col("zone"), col("blocker_team"), col("blocker_team_lag1")))


@query("role_teams_c4", f"WITH {ROLES} SELECT event_id, shooter_team, blocker_team, committed_team, drawn_team FROM ro")
def _(t):
    roles = {"shooter_team": "shooter_id", "blocker_team": "blocker_id", "committed_team": "committed_id", "drawn_team": "drawn_id"}
    return Q.attach_roles(t.plays, t.roster, roles).select("event_id", *roles)


@query("role_team_join_c5", f"WITH {ROLES} SELECT event_id, shooter_team FROM ro")
def _(t):
    return Q.attach_role(t.plays, t.roster, "shooter_id", "shooter_team").select("event_id", "shooter_team")


@query("last_scorer_e8", f"WITH {ENR} SELECT event_id, last_scorer FROM en")
def _(t):
    return Q.last_scorer(t.plays, BLOCK).select("event_id", "last_scorer")


@query("penalty_state_e9", f"WITH {ENR} SELECT event_id, penalty_end, penalty_team FROM en")
def _(t):
    p = Q.attach_role(t.plays, t.roster, "drawn_id", "drawn_team")
    return Q.penalty_state(p, BLOCK).select("event_id", "penalty_end", "penalty_team")


@query("previous_event_e10", f"WITH {ENR} SELECT event_id, owner_lag1, zone_lag1, type_lag1, shooter_id_lag1 FROM en")
def _(t):
    return Q.previous_event(t.plays, ["owner", "zone", "type", "shooter_id"], BLOCK).select("event_id", "owner_lag1", "zone_lag1", "type_lag1", "shooter_id_lag1")


@query("enriched_events_i1", f"WITH {ENR} SELECT event_id, last_scorer, penalty_end, penalty_team, type_lag1, blocker_team_lag1, action, round(elapsed / 60.0, 6) AS minutes FROM en")
def _(t):
    return enriched(t).select("event_id", "last_scorer", "penalty_end", "penalty_team", "type_lag1", "blocker_team_lag1", "action", *r6("minutes"))


@query("action_attribution_e31", f"WITH {ENR} SELECT gameid, action, count(*) AS n FROM en GROUP BY gameid, action")
def _(t):
    return enriched(t).groupBy("gameid", "action").agg(F.count(F.lit(1)).alias("n"))


@query("power_play_tags_i15", f"""WITH {ENR} SELECT event_id, CAST(penalty_end IS NOT NULL AS BIGINT) AS power_play, CAST(coalesce(type = 'goal' AND penalty_end IS NOT NULL AND owner = penalty_team, false) AS BIGINT) AS pp_goal,
CAST(coalesce(type = 'goal' AND penalty_end IS NOT NULL AND owner <> penalty_team, false) AS BIGINT) AS pk_goal FROM en""")
def _(t):
    return Q.power_play_tags(enriched(t)).select("event_id", "power_play", "pp_goal", "pk_goal")


@query("penalty_periods_e32", f"WITH {ENR} SELECT gameid, penalty_team, count(*) AS events FROM en WHERE penalty_end IS NOT NULL GROUP BY gameid, penalty_team")
def _(t):
    return enriched(t).filter(col("penalty_end").isNotNull()).groupBy("gameid", "penalty_team").agg(F.count(F.lit(1)).alias("events"))


def flag(kind, who, zone=None):
    z = f" AND zone = '{zone}'" if zone else ""
    return f"CASE WHEN type = '{kind}' AND owner {who} 'HOM'{z} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query("event_flags_i2", f"""SELECT event_id, {flag('hit', '=')} AS hit_for, {flag('hit', '<>')} AS hit_against, {flag('shot-on-goal', '=')} AS shot_for, {flag('shot-on-goal', '<>')} AS shot_against,
{flag('takeaway', '=')} AS takeaway, {flag('giveaway', '=')} AS giveaway, {flag('blocked-shot', '=')} AS block_for, {flag('blocked-shot', '<>')} AS block_against, {flag('faceoff', '=')} AS faceoff_win FROM plays""")
def _(t):
    return Q.event_flags(t.plays, "HOM", by_zone=False).select(
        "event_id", "hit_for", "hit_against", "shot_for", "shot_against", "takeaway", "giveaway", "block_for", "block_against", "faceoff_win")


@query("event_flags_by_zone_i3", f"""SELECT event_id, {', '.join(f"{flag('hit', w, z)} AS hit_{n}_{z}" for n, w in (('for', '='), ('against', '<>')) for z in 'ODN')} FROM plays""")
def _(t):
    return Q.event_flags(t.plays, "HOM").select("event_id", *[f"hit_{n}_{z}" for n in ("for", "against") for z in "ODN"])


@query("zone_entries_e11", f"""SELECT event_id, CASE WHEN zone = 'O' AND z IN ('N', 'D') AND elapsed - e <= 20000 AND owner = 'HOM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS zone_entry
FROM (SELECT *, lag(zone) OVER w AS z, lag(elapsed) OVER w AS e FROM plays {W})""")
def _(t):
    return Q.zone_entries(t.plays, "HOM", 20000, BLOCK).select("event_id", "zone_entry")


GAIN = f"""ga AS (SELECT *, CASE WHEN owner <> lag(owner) OVER w AND owner = 'HOM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS possession_gain FROM plays {W})"""


@query("possession_e12", f"WITH {GAIN} SELECT event_id, possession_gain, sum(possession_gain) OVER (PARTITION BY gameid ORDER BY elapsed RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS gains_trailing FROM ga")
def _(t):
    return Q.possession(t.plays, "HOM", DAY, slice_by=BLOCK, slice_width=WIDTH).select("event_id", "possession_gain", "gains_trailing")


@query("zone_share_e13", f"""SELECT event_id, round(sum(CASE WHEN owner = 'HOM' THEN 1.0 ELSE 0.0 END) OVER v / count(*) OVER v, 6) AS zone_share FROM plays
WINDOW v AS (PARTITION BY gameid ORDER BY elapsed RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""")
def _(t):
    return Q.possession(t.plays, "HOM", DAY, slice_by=BLOCK, slice_width=WIDTH).select("event_id", *r6("zone_share"))


@query("zone_share_left_open_e13", f"""SELECT event_id, round(sum(CASE WHEN owner = 'HOM' THEN 1.0 ELSE 0.0 END) OVER v / count(*) OVER v, 6) AS zone_share FROM plays
WINDOW v AS (PARTITION BY gameid ORDER BY elapsed RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)""")
def _(t):
    return Q.possession(t.plays, "HOM", DAY, left_open=True, slice_by=BLOCK, slice_width=WIDTH).select("event_id", *r6("zone_share"))


SCORE = """sc AS (SELECT event_id, gameid, coalesce(sum(CASE WHEN type = 'goal' AND owner = 'HOM' THEN 1 ELSE 0 END) OVER w, 0) AS gf, coalesce(sum(CASE WHEN type = 'goal' AND owner <> 'HOM' THEN 1 ELSE 0 END) OVER w, 0) AS ga
FROM plays WINDOW w AS (PARTITION BY gameid ORDER BY elapsed, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("score_before_e14", f"WITH {SCORE} SELECT event_id, CAST(gf AS BIGINT) AS goals_for, CAST(ga AS BIGINT) AS goals_against, CAST(greatest(-2, least(2, gf - ga)) AS BIGINT) AS score_state FROM sc")
def _(t):
    return Q.score_before(t.plays, "HOM", BLOCK).select("event_id", "goals_for", "goals_against", "score_state")


@query("time_gap_e15", f"SELECT event_id, elapsed - lag(elapsed, 1, 0) OVER w AS dt FROM plays {W}")
def _(t):
    return Q.time_gap(t.plays, BLOCK).select("event_id", "dt")


@query("running_hits_e16", """SELECT event_id, CAST(sum(CASE WHEN type = 'hit' THEN 1 ELSE 0 END) OVER (PARTITION BY gameid ORDER BY elapsed, event_id) AS BIGINT) AS hits_so_far,
CAST(sum(CASE WHEN type = 'hit' THEN 1 ELSE 0 END) OVER (PARTITION BY gameid, period ORDER BY elapsed, event_id) AS BIGINT) AS hits_in_period FROM plays""")
def _(t):
    return Q.running_hits(t.plays, BLOCK).select("event_id", "hits_so_far", "hits_in_period")


@query("faceoff_sessions_e30", """WITH s AS (SELECT *, sum(CASE WHEN type = 'faceoff' THEN 1 ELSE 0 END) OVER (PARTITION BY gameid ORDER BY elapsed, event_id) AS session FROM plays)
SELECT gameid, CAST(session AS BIGINT) AS session, min(elapsed) AS start, max(elapsed) - min(elapsed) AS duration, count(*) AS events, arg_min(zone, elapsed * 100000000 + event_id) AS zone_faceoff,
CAST(max(CASE WHEN type = 'faceoff' AND owner = 'HOM' THEN 1 ELSE 0 END) AS BIGINT) AS won_home, CAST(min(zone) <> max(zone) AS BIGINT) AS zone_change,
CAST(sum(CASE WHEN type = 'goal' AND owner = 'HOM' THEN 1 WHEN type = 'goal' AND owner IS NOT NULL THEN -1 ELSE 0 END) AS BIGINT) AS goal FROM s WHERE session > 0 GROUP BY gameid, session""")
def _(t):
    return Q.sessions(t.plays, "HOM", slice_by=BLOCK)


@query("hit_bursts_e33", f"""SELECT event_id, CAST(coalesce(sum(CASE WHEN type = 'hit' AND owner = 'HOM' THEN 1 ELSE 0 END) OVER (PARTITION BY gameid ORDER BY elapsed RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW), 0) >= 3 AS BIGINT) AS burst,
CAST(coalesce(sum(CASE WHEN type = 'hit' AND owner <> 'HOM' THEN 1 ELSE 0 END) OVER (PARTITION BY gameid ORDER BY elapsed RANGE BETWEEN 1 FOLLOWING AND {DAY} FOLLOWING), 0) AS BIGINT) AS reply_hits FROM plays""")
def _(t):
    return Q.hit_bursts(t.plays, "HOM", WIDTH, 3 * DAY, DAY).select("event_id", "burst", "reply_hits")


@query("early_differential_e34", f"""SELECT gameid, CAST(sum(CASE WHEN type = 'hit' AND elapsed < {5 * DAY} AND owner = 'HOM' THEN 1 WHEN type = 'hit' AND elapsed < {5 * DAY} AND owner <> 'HOM' THEN -1 ELSE 0 END) AS BIGINT) AS early_hits,
round(CAST(sum(CASE WHEN elapsed >= {5 * DAY} AND owner = 'HOM' THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN elapsed >= {5 * DAY} AND owner IS NOT NULL THEN 1 ELSE 0 END), 6) AS later_share FROM plays GROUP BY gameid""")
def _(t):
    return Q.early_differential(t.plays, "HOM", 5 * DAY).select("gameid", "early_hits", *r6("later_share"))


@query("goal_soon_e35", f"SELECT event_id, CAST(coalesce(max(CASE WHEN type = 'goal' AND owner = 'HOM' THEN 1 ELSE 0 END) OVER (PARTITION BY gameid ORDER BY elapsed RANGE BETWEEN 1 FOLLOWING AND {DAY} FOLLOWING), 0) AS BIGINT) AS goal_soon FROM plays")
def _(t):
    return Q.goal_soon(t.plays, "HOM", DAY, WIDTH).select("event_id", "goal_soon")


@query("posture_after_block_i5", f"WITH {POST} SELECT event_id, posture FROM po")
def _(t):
    return after_block(t).select("event_id", "posture")


@query("posture_shares_d6", f"""WITH {POST}, c AS (SELECT posture, type, count(*) AS n FROM po GROUP BY posture, type)
SELECT posture, type, n, round(n * 100.0 / sum(n) OVER (PARTITION BY posture), 6) AS share, round(coalesce(sum(n) OVER (PARTITION BY posture ORDER BY n DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100.0 / sum(n) OVER (PARTITION BY posture), 6) AS share_before FROM c""")
def _(t):
    return Q.category_shares(after_block(t), ["posture"], "type").select("posture", "type", "n", *r6("share", "share_before"))


NEXT = """nx AS (SELECT type_lag1 AS category, gameid, action, CAST(sum(CASE WHEN type = 'goal' THEN 1 ELSE 0 END) AS BIGINT) AS goals, count(*) AS events FROM en
WHERE type_lag1 IN ('blocked-shot', 'missed-shot', 'shot-on-goal', 'goal') GROUP BY 1, 2, 3)"""


@query("next_event_rates_i6", f"WITH {ENR}, {NEXT} SELECT category, gameid, action, goals, events, round(CAST(goals AS DOUBLE) / events, 6) AS p_game FROM nx")
def _(t):
    return Q.next_event_rates(enriched(t)).select("category", "gameid", "action", "goals", "events", *r6("p_game"))


@query("mean_rate_by_agent_d9", f"WITH {ENR}, {NEXT} SELECT category, CASE WHEN action = 'Own action' THEN 'Defending team' ELSE 'Shot-attempt team' END AS agent, round(avg(CAST(goals AS DOUBLE) / events), 6) AS p FROM nx GROUP BY 1, 2")
def _(t):
    return Q.next_event_rates(enriched(t)).groupBy("category", "agent").agg(F.round(F.avg("p_game"), 6).alias("p"))


@query("mean_counts_d5", """SELECT period, owner, round(avg(b), 6) AS blocked_shot, round(avg(g), 6) AS goal FROM (SELECT period, gameid, owner, sum(CAST(type = 'blocked-shot' AS INT)) AS b, sum(CAST(type = 'goal' AS INT)) AS g
FROM plays GROUP BY period, gameid, owner) GROUP BY period, owner""")
def _(t):
    return Q.mean_counts(t.plays, ["period"], ["blocked-shot", "goal"]).select("period", "owner", *r6("blocked_shot", "goal"))


@query("count_pivot_d10", """SELECT gameid, owner, count(CASE WHEN type = 'hit' THEN 1 END) AS hit, count(CASE WHEN type = 'goal' THEN 1 END) AS goal, count(CASE WHEN type = 'never' THEN 1 END) AS never FROM plays GROUP BY gameid, owner""")
def _(t):
    return Q.count_pivot(t.plays, ["hit", "goal", "never"])


@query("owner_zone_pivot_d7", """SELECT type, period, count(CASE WHEN owner = 'HOM' AND zone = 'O' THEN 1 END) AS hom_o, count(CASE WHEN owner = 'AWY' AND zone = 'D' THEN 1 END) AS awy_d FROM plays GROUP BY type, period""")
def _(t):
    p = t.plays.withColumn("cell", F.concat_ws("|", "owner", "zone")).groupBy("type", "period").pivot("cell", ["HOM|O", "AWY|D"]).agg(F.count(F.lit(1)))
    return p.select("type", "period", F.coalesce(col("`HOM|O`"), F.lit(0)).alias("hom_o"), F.coalesce(col("`AWY|D`"), F.lit(0)).alias("awy_d"))


@query("conditional_goal_shares_d8", "SELECT zone, owner, type, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY zone, owner) AS BIGINT) AS total, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY zone, owner), 6) AS p FROM plays GROUP BY zone, owner, type")
def _(t):
    from icestats.operators.stats import conditional_shares
    return conditional_shares(t.plays, ["zone", "owner"], "type").select("zone", "owner", "type", "count", "total", *r6("p"))


@query("flow_links_d32", f"""WITH {POST}, c AS (SELECT posture, action, type, count(*) AS n FROM po GROUP BY 1, 2, 3), l AS (SELECT 0 AS layer, posture AS source, action AS target, n FROM c UNION ALL SELECT 1, action, type, n FROM c)
SELECT CAST(layer AS INT) AS layer, source, target, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM c) * 100, 6) AS percent FROM l GROUP BY 1, 2, 3""")
def _(t):
    return Q.flow_links(after_block(t), ["posture", "action", "type"]).select("layer", "source", "target", "n", *r6("percent"))


# home-side priors of a game, from the games before it (0 for a game without box score)
PRIORS = """pr AS (SELECT a.*, b.goals AS goals_against, b.shots AS shots_against FROM box a JOIN box b ON a.gameid = b.gameid AND a.side <> b.side),
pq AS (SELECT gameid, side, coalesce(sum(goals) OVER w, 0) AS gf, coalesce(sum(goals_against) OVER w, 0) AS ga, coalesce(sum(shots) OVER w, 0) AS sf, coalesce(sum(shots_against) OVER w, 0) AS sa
 FROM pr WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pri AS (SELECT gameid, 2 * CASE WHEN gf + ga = 0 THEN 0.5 ELSE CAST(gf * gf AS DOUBLE) / CAST(gf * gf + ga * ga AS DOUBLE) END - 1 AS dp,
 2 * CASE WHEN sf + sa = 0 THEN 0.5 ELSE CAST(sf AS DOUBLE) / CAST(sf + sa AS DOUBLE) END - 1 AS ds FROM pq WHERE side = 'home')"""


def priors(t):
    return T.local_priors(T.prior_metrics(T.to_team_rows(t.games), "month(game_date)"))


def master(t, focal="HOM", home="HOM"):
    return Q.master_table(t.plays, priors(t), focal, home=home, slice_by=BLOCK, slice_width=WIDTH, window=DAY, max_gap=20000)


@query("momentum_master_i4", f"""WITH {SCORE}, {PRIORS}, m AS (SELECT event_id, gameid, owner, sum(CASE WHEN owner = 'HOM' THEN 1.0 ELSE 0.0 END) OVER v / count(*) OVER v AS zh,
 sum(CASE WHEN owner = 'AWY' THEN 1.0 ELSE 0.0 END) OVER v / count(*) OVER v AS za, elapsed - lag(elapsed, 1, 0) OVER w AS dt, {flag('hit', '=', 'O')} AS hit_for_O, {flag('hit', '<>', 'O')} AS hit_against_O,
 zone = 'O' AND lag(zone) OVER w IN ('N', 'D') AND elapsed - lag(elapsed) OVER w <= 20000 AS entry FROM plays
 WINDOW v AS (PARTITION BY gameid ORDER BY elapsed RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), w AS (PARTITION BY gameid ORDER BY elapsed, event_id))
SELECT m.event_id, f.focal, CAST(f.s * greatest(-2, least(2, gf - ga)) AS BIGINT) AS score_state, round(CASE WHEN f.focal = 'HOM' THEN zh ELSE za END, 6) AS zone_share, dt,
 CASE WHEN f.focal = 'HOM' THEN hit_for_O ELSE hit_against_O END AS hit_for_O, CAST(coalesce(entry AND owner = f.focal, false) AS DOUBLE) AS zone_entry,
 round(f.s * coalesce(pri.dp, 0) + 0.0, 6) AS delta_pythagorean, round(f.s * coalesce(pri.ds, 0) + 0.0, 6) AS delta_shot_share, CASE WHEN f.focal = 'HOM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_home
FROM m JOIN sc ON sc.event_id = m.event_id JOIN (VALUES ('HOM', 1), ('AWY', -1)) AS f(focal, s) ON true LEFT JOIN pri ON pri.gameid = m.gameid""")
def _(t):
    sides = [master(t, focal).withColumn("focal", F.lit(focal)) for focal in ("HOM", "AWY")]
    return sides[0].unionByName(sides[1]).select(
        "event_id", "focal", "score_state", *r6("zone_share"), "dt", "hit_for_O", "zone_entry", *[F.round(col(c) + 0.0, 6).alias(c) for c in Q.PRIOR_DELTAS], "is_home")


@query("posture_counts_b27", f"WITH {POST} SELECT posture, zone, count(*) AS n FROM po GROUP BY posture, zone")
def _(t):
    return after_block(t).groupBy("posture", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("bootstrap_goal_shares_i14")
def _(t):
    from icestats.operators.stats import bootstrap_shares
    s = Q.sessions(t.plays, "HOM", slice_by=BLOCK)
    return bootstrap_shares(s.withColumn("goal_sign", F.signum("goal")), ["won_home"], "goal_sign")
