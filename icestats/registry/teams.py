"""Queries of the team indicators."""

from pyspark.sql import functions as F

from icestats.operators import teams as T
from icestats.plans.lineage import materialise
from icestats.registry.base import query

MONTH = "month(game_date)"

PAIRED = """paired AS (
  SELECT a.*, b.team AS opponent, b.goals AS goals_against, b.shots AS shots_against,
         b.blocked AS blocked_against, b.missed AS missed_against
  FROM box a JOIN box b ON a.gameid = b.gameid AND a.side <> b.side)"""
RUN = PAIRED + """, run AS (
  SELECT *, CAST(count(*) OVER w AS BIGINT) AS rgame, CAST(sum(win) OVER w AS BIGINT) AS rwin,
         CAST(sum(goals) OVER w AS BIGINT) AS rgf, CAST(sum(goals_against) OVER w AS BIGINT) AS rga
  FROM paired WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid)),
met AS (
  SELECT *, CASE WHEN rgf + rga > 0 THEN CAST(rgf * rgf AS DOUBLE) / (rgf * rgf + rga * rga) END AS rpe FROM run),
tot AS (
  SELECT season, team, CAST(sum(shots - shots_against) AS BIGINT) AS fenwick_lvl,
         CAST(sum(shots + blocked - shots_against - blocked_against) AS BIGINT) AS corsi_lvl,
         arg_max(rpe, rgame) AS rpe, CAST(max(rwin) AS BIGINT) AS rwin, CAST(max(rgame) AS BIGINT) AS rgame,
         CAST(max(rwin) AS DOUBLE) / max(rgame) AS wp
  FROM met GROUP BY season, team),
edges AS (
  SELECT season, team, opponent, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins,
         CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(goals_against) AS BIGINT) AS goals_against,
         CAST(sum(shots) AS BIGINT) AS shots
  FROM paired GROUP BY season, team, opponent),
common AS (
  SELECT a.season, a.team, a.opponent AS rival, b.opponent AS common, b.games AS games_own, b.wins AS wins_own,
         c.games AS games_rival, c.wins AS wins_rival
  FROM edges a JOIN edges b ON a.season = b.season AND a.team = b.team
  JOIN edges c ON c.season = a.season AND c.team = a.opponent AND c.opponent = b.opponent),
pw AS (
  SELECT season, team, CAST(sum(CASE WHEN own > riv THEN 1 ELSE 0 END) AS BIGINT) AS pairwise_win
  FROM (SELECT season, team, rival, CAST(sum(wins_own) AS DOUBLE) / sum(games_own) AS own,
               CAST(sum(wins_rival) AS DOUBLE) / sum(games_rival) AS riv FROM common GROUP BY season, team, rival)
  GROUP BY season, team),
pw_all AS (
  SELECT t.season, t.team, coalesce(pw.pairwise_win, 0) AS pairwise_win
  FROM tot t LEFT JOIN pw ON pw.season = t.season AND pw.team = t.team),
ow AS (
  SELECT season, team, CAST(sum(w) AS DOUBLE) / sum(g) AS wp_ow
  FROM (SELECT m.season, m.team, m.opponent, arg_max(o.rwin, m.rgame) AS w, arg_max(o.rgame, m.rgame) AS g
        FROM met m JOIN met o ON o.gameid = m.gameid AND o.side <> m.side GROUP BY m.season, m.team, m.opponent)
  GROUP BY season, team),
rpi AS (
  SELECT t.season, t.team, t.wp AS wp_own, coalesce(ow.wp_ow, 0) AS wp_ow, coalesce(oow.wp_oow, 0) AS wp_oow,
         t.wp * 0.25 + coalesce(ow.wp_ow, 0) * 0.5 + coalesce(oow.wp_oow, 0) * 0.25 AS rpi
  FROM tot t LEFT JOIN ow ON ow.season = t.season AND ow.team = t.team
  LEFT JOIN (SELECT season, team, CAST(sum(wins_own) AS DOUBLE) / sum(games_own) AS wp_oow FROM common GROUP BY season, team) oow
    ON oow.season = t.season AND oow.team = t.team)"""
STREAK = RUN + """, sr AS (
  SELECT p.season, p.team, p.gameid, p.game_date, p.win, a.rpi, b.rpi AS rpi_against,
         quantile_cont(b.rpi, 0.75) OVER (PARTITION BY p.season) AS q75
  FROM paired p JOIN rpi a ON a.season = p.season AND a.team = p.team
  JOIN rpi b ON b.season = p.season AND b.team = p.opponent),
s3 AS (
  SELECT *, sum(win) OVER w AS w3,
         sum(CASE WHEN rpi_against > q75 THEN win ELSE 0 END) OVER w AS h3,
         sum(CASE WHEN rpi_against < rpi THEN win ELSE 0 END) OVER w AS e3
  FROM sr WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
streaks AS (
  SELECT season, team, CAST(sum(CASE WHEN w3 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS win_streak,
         CAST(sum(CASE WHEN w3 = 3 AND e3 >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS win_streak_expected,
         CAST(sum(CASE WHEN w3 = 3 AND h3 >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS hot_streak
  FROM s3 GROUP BY season, team)"""


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query("team_rows_g5", "SELECT gameid, season, team, side, opponent, goals, goals_against, win FROM (WITH " + PAIRED + " SELECT * FROM paired)")
def _(t):
    return T.to_team_rows(t.games).select("gameid", "season", "team", "side", "opponent", "goals", "goals_against", "win")


@query("opponent_pairing_c1", "WITH " + PAIRED + " SELECT gameid, team, opponent, goals, goals_against, shots_against FROM paired")
def _(t):
    return T.pair_opponent(t.box).select("gameid", "team", "opponent", "goals", "goals_against", "shots_against")


@query("opponent_self_join_c2", "WITH " + PAIRED + " SELECT gameid, team, opponent, blocked, blocked_against FROM paired")
def _(t):
    return T.opponent_join(t.box).select("gameid", "team", "opponent", "blocked", "blocked_against")


@query("opponent_running_record_c3", "WITH " + RUN + """
SELECT m.gameid, m.team, m.rgame, m.rwin, o.rgame AS rgame_oppo, o.rwin AS rwin_oppo, round(o.rpe, 6) AS rpe_oppo
FROM met m JOIN met o ON o.gameid = m.gameid AND o.side <> m.side""")
def _(t):
    m = T.attach_opponent_running(T.running_metrics(T.to_team_rows(t.games).withColumn("game_date", F.col("game_date")), MONTH))
    return m.select("gameid", "team", "rgame", "rwin", "rgame_oppo", "rwin_oppo", *r6("rpe_oppo"))


@query("rest_days_e5", "WITH " + PAIRED + """
SELECT gameid, team, lag(gameid) OVER w AS prev_gameid, lead(gameid) OVER w AS next_gameid,
       CAST(game_date - lag(game_date) OVER w AS INT) AS rest_days
FROM paired WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid)""")
def _(t):
    return T.rest_days(T.to_team_rows(t.games), MONTH).select("gameid", "team", "prev_gameid", "next_gameid", "rest_days")


@query("shot_levels_h1", "WITH " + PAIRED + """
SELECT gameid, team, shots + missed - shots_against - missed_against AS fenwick_lvl,
       round(CAST(shots + missed AS DOUBLE) / (shots + missed + shots_against + missed_against), 6) AS fenwick_pct,
       shots + missed + blocked - shots_against - missed_against - blocked_against AS corsi_lvl,
       round(CAST(shots + missed + blocked AS DOUBLE) / (shots + missed + blocked + shots_against + missed_against + blocked_against), 6) AS corsi_pct
FROM paired""")
def _(t):
    return T.shot_levels(T.to_team_rows(t.games), include_missed=True).select(
        "gameid", "team", "fenwick_lvl", *r6("fenwick_pct"), "corsi_lvl", *r6("corsi_pct"))


@query("running_totals_e1", "WITH " + RUN + " SELECT gameid, team, rgame, rwin, rgf, rga, round(rpe, 6) AS rpe FROM met")
def _(t):
    return T.running_metrics(T.to_team_rows(t.games), MONTH).select("gameid", "team", "rgame", "rwin", "rgf", "rga", *r6("rpe"))


@query("game_number_e2", "SELECT gameid, team, row_number() OVER (PARTITION BY season, team ORDER BY game_date, gameid) AS n FROM box")
def _(t):
    from icestats.plans.slicing import running_total
    out = running_total(t.box, T.TEAM_KEYS, T.TEAM_ORDER, {"n": F.lit(1)}, slice_by=MONTH)
    return out.select("gameid", "team", F.col("n").cast("bigint").alias("n"))


@query("prior_totals_e3", "WITH " + PAIRED + """, p AS (
SELECT *, coalesce(sum(goals) OVER w, 0) AS gf, coalesce(sum(goals_against) OVER w, 0) AS ga, count(*) OVER w AS n
FROM paired WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT gameid, team, CAST(n AS BIGINT) AS p_games, CAST(gf AS BIGINT) AS p_gf, CAST(ga AS BIGINT) AS p_ga,
round(CASE WHEN gf + ga = 0 THEN 0.5 ELSE CAST(gf * gf AS DOUBLE) / CAST(gf * gf + ga * ga AS DOUBLE) END, 6) AS pythagorean FROM p""")
def _(t):
    return T.prior_metrics(T.to_team_rows(t.games), MONTH).select("gameid", "team", "p_games", "p_gf", "p_ga", *r6("pythagorean"))


@query("trailing_expectation_e4", "WITH " + RUN + """, l AS (
SELECT *, rgf - lag(rgf, 10) OVER w AS f, rga - lag(rga, 10) OVER w AS a FROM met WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid))
SELECT gameid, team, round(CASE WHEN f + a > 0 THEN CAST(f * f AS DOUBLE) / (f * f + a * a) END, 6) AS rpe_10 FROM l""")
def _(t):
    return T.trailing_expectation(T.running_metrics(T.to_team_rows(t.games), MONTH)).select("gameid", "team", *r6("rpe_10"))


@query("season_totals_d2", "WITH " + RUN + " SELECT season, team, fenwick_lvl, corsi_lvl, round(rpe, 6) AS rpe, rwin, rgame, round(wp, 6) AS wp FROM tot")
def _(t):
    m = T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), MONTH)
    return T.season_totals(m).select("season", "team", "fenwick_lvl", "corsi_lvl", *r6("rpe"), "rwin", "rgame", *r6("wp"))


@query("pythagorean_gamma_h2", """SELECT season, team, round(CASE WHEN gf + ga > 0 THEN pow(gf, 2.15) / (pow(gf, 2.15) + pow(ga, 2.15)) END, 6) AS pe
FROM (SELECT a.season, a.team, CAST(sum(a.goals) AS DOUBLE) AS gf, CAST(sum(b.goals) AS DOUBLE) AS ga FROM box a JOIN box b ON a.gameid = b.gameid AND a.side <> b.side GROUP BY a.season, a.team)""")
def _(t):
    rows = T.to_team_rows(t.games).groupBy("season", "team").agg(F.sum("goals").alias("gf"), F.sum("goals_against").alias("ga"))
    return rows.select("season", "team", F.round(T.pythagorean(F.col("gf"), F.col("ga"), 2.15), 6).alias("pe"))


@query("fitted_wins_h3", "WITH " + RUN + " SELECT season, team, round((rpe * 0.809623 + 0.042901) * 82, 6) AS fitted FROM tot")
def _(t):
    m = T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), MONTH)
    return T.season_totals(m).select("season", "team", F.round(T.fitted_wins(F.col("rpe")), 6).alias("fitted"))


@query("head_to_head_d3", "WITH " + RUN + " SELECT * FROM edges")
def _(t):
    return T.head_to_head(T.to_team_rows(t.games))


@query("head_to_head_totals_c10", "WITH " + RUN + """
SELECT e.season, e.team, e.opponent, e.games, e.wins, a.rgame AS team_games, a.rwin AS team_wins, b.rgame AS opponent_games, b.rwin AS opponent_wins
FROM edges e JOIN tot a ON a.season = e.season AND a.team = e.team JOIN tot b ON b.season = e.season AND b.team = e.opponent""")
def _(t):
    p = T.to_team_rows(t.games)
    h = T.head_to_head_totals(T.head_to_head(p), T.running_metrics(p, MONTH))
    return h.select("season", "team", "opponent", "games", "wins", "team_games", "team_wins", "opponent_games", "opponent_wins")


@query("common_opponents_c11", "WITH " + RUN + " SELECT * FROM common")
def _(t):
    return T.common_opponents(T.head_to_head(T.to_team_rows(t.games)))


@query("opponent_record_d4", "WITH " + RUN + " SELECT season, team, round(wp_ow, 6) AS wp_ow FROM ow")
def _(t):
    m = T.attach_opponent_running(T.running_metrics(T.to_team_rows(t.games), MONTH))
    return T.opponent_record(m).select("season", "team", *r6("wp_ow"))


@query("rating_percentage_index_h4", "WITH " + RUN + " SELECT season, team, round(wp_own, 6) AS wp_own, round(wp_ow, 6) AS wp_ow, round(wp_oow, 6) AS wp_oow, round(rpi, 6) AS rpi FROM rpi")
def _(t):
    m = T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), MONTH)
    c = T.common_opponents(T.head_to_head(T.to_team_rows(t.games)))
    r = T.rating_percentage_index(T.season_totals(m), T.opponent_record(T.attach_opponent_running(m)), c)
    return r.select("season", "team", *r6("wp_own", "wp_ow", "wp_oow", "rpi"))


@query("rpi_schedule_h5", "WITH " + RUN + """, own AS (SELECT season, team, CAST(sum(win) AS DOUBLE) / count(*) AS wp FROM paired GROUP BY season, team),
oo AS (SELECT a.season, a.team, a.opponent, CAST(sum(c.wp * b.games) AS DOUBLE) / sum(b.games) AS v
  FROM edges a JOIN edges b ON b.season = a.season AND b.team = a.opponent AND b.opponent <> a.team
  JOIN own c ON c.season = b.season AND c.team = b.opponent GROUP BY a.season, a.team, a.opponent)
SELECT e.season, e.team, round(max(o.wp), 6) AS wp_own, round(sum(e.games * p.wp) / sum(e.games), 6) AS wp_ow,
  round(sum(e.games * oo.v) / sum(CASE WHEN oo.v IS NOT NULL THEN e.games END), 6) AS wp_oow
FROM edges e JOIN own o ON o.season = e.season AND o.team = e.team JOIN own p ON p.season = e.season AND p.team = e.opponent
LEFT JOIN oo ON oo.season = e.season AND oo.team = e.team AND oo.opponent = e.opponent GROUP BY e.season, e.team""")
def _(t):
    return T.rpi_schedule(T.head_to_head(T.to_team_rows(t.games))).select("season", "team", *r6("wp_own", "wp_ow", "wp_oow"))


@query("pairwise_wins_h6", "WITH " + RUN + " SELECT * FROM pw_all")
def _(t):
    e = T.head_to_head(T.to_team_rows(t.games))
    return T.pairwise_wins(T.common_opponents(e), e)


@query("normalised_indicators_h7", "WITH " + RUN + """
SELECT season, team, round((corsi_lvl - min(corsi_lvl) OVER s) / CAST(max(corsi_lvl) OVER s - min(corsi_lvl) OVER s AS DOUBLE), 6) AS kpi_corsi,
round((wp - min(wp) OVER s) / (max(wp) OVER s - min(wp) OVER s), 6) AS kpi_wp,
round(CAST(row_number() OVER (PARTITION BY season ORDER BY rwin, fenwick_lvl, corsi_lvl, team) - 1 AS DOUBLE) / (count(*) OVER s - 1), 6) AS final_position
FROM tot WINDOW s AS (PARTITION BY season)""")
def _(t):
    totals = T.totals_of(T.season_edges(T.shot_levels(T.to_team_rows(t.games))))
    return T.with_indicators(totals).select("season", "team", *r6("kpi_corsi", "kpi_wp", "final_position"))


def _rated(t):
    """Game-level metrics and the per-team index, both from written tables."""
    m = T.game_metrics(t.games, MONTH)
    return m, materialise(T.rated(materialise(T.season_edges(m), "edges")), "teams")


@query("streak_flags_e7", "WITH " + STREAK + """
SELECT season, team, gameid, CAST(w3 = 3 AS BIGINT) AS win_streak, CAST(w3 = 3 AND e3 >= 2 AS BIGINT) AS win_streak_expected,
CAST(w3 = 3 AND h3 >= 1 AS BIGINT) AS hot_streak FROM s3""")
def _(t):
    p, r = _rated(t)
    return T.streak_flags(p, r).drop("game_date")


@query("streak_summary_h8", "WITH " + STREAK + """
SELECT *, round(CASE WHEN win_streak > 0 THEN CAST(hot_streak AS DOUBLE) / win_streak END, 6) AS hot_share,
CASE WHEN win_streak > 0 THEN concat(CAST(CAST(floor(CAST(hot_streak AS DOUBLE) / win_streak * 100) AS BIGINT) AS VARCHAR), '%') END AS hot_label FROM streaks""")
def _(t):
    p, r = _rated(t)
    return T.streak_summary(T.streak_flags(p, r)).withColumn("hot_share", F.round("hot_share", 6))


@query("team_season_table_h9", "WITH " + STREAK + """
SELECT t.season, t.team, t.fenwick_lvl, t.corsi_lvl, round(t.rpe, 6) AS rpe, t.rwin, t.rgame, round(t.wp, 6) AS wp,
  round(r.wp_ow, 6) AS wp_ow, round(r.rpi, 6) AS rpi, p.pairwise_win, round((t.rpe * 0.809623 + 0.042901) * 82, 6) AS fitted_wins,
  s.win_streak, s.win_streak_expected, s.hot_streak
FROM tot t JOIN rpi r ON r.season = t.season AND r.team = t.team JOIN pw_all p ON p.season = t.season AND p.team = t.team
JOIN streaks s ON s.season = t.season AND s.team = t.team""")
def _(t):
    return T.team_season(t.games, MONTH).select(
        "season", "team", "fenwick_lvl", "corsi_lvl", *r6("rpe"), "rwin", "rgame", *r6("wp", "wp_ow", "rpi"),
        "pairwise_win", *r6("fitted_wins"), "win_streak", "win_streak_expected", "hot_streak")


@query("local_priors_h10", "WITH " + PAIRED + """, p AS (SELECT *, coalesce(sum(goals) OVER w, 0) AS gf, coalesce(sum(goals_against) OVER w, 0) AS ga,
 coalesce(sum(shots) OVER w, 0) AS sf, coalesce(sum(shots_against) OVER w, 0) AS sa FROM paired
 WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT gameid, team AS home, CASE WHEN gf + ga = 0 THEN 0.5 ELSE CAST(gf * gf AS DOUBLE) / CAST(gf * gf + ga * ga AS DOUBLE) END AS pe,
 CASE WHEN sf + sa = 0 THEN 0.5 ELSE CAST(sf AS DOUBLE) / CAST(sf + sa AS DOUBLE) END AS sh FROM p WHERE side = 'home')
SELECT gameid, home, round(pe, 6) AS pythagorean, round(sh, 6) AS shot_share, round(pe - (1 - pe), 6) AS delta_pythagorean, round(sh - (1 - sh), 6) AS delta_shot_share FROM q""")
def _(t):
    return T.local_priors(T.prior_metrics(T.to_team_rows(t.games), MONTH)).select(
        "gameid", "home", *r6("pythagorean", "shot_share", "delta_pythagorean", "delta_shot_share"))


# a team's place by playoff wins, for teams that have a playoff row
PLACES = """, po AS (SELECT season, team, sum(win) AS w FROM playoff_rows GROUP BY season, team),
ch AS (SELECT season, team, row_number() OVER (PARTITION BY season ORDER BY w DESC, team) AS place FROM po)"""


@query("champion_label_h11", "WITH " + RUN + PLACES + """
SELECT season, team, round(rpe, 6) AS rpe, CASE WHEN place IS NULL THEN 'missed' WHEN place = 1 THEN 'champion' ELSE 'lost' END AS label FROM tot LEFT JOIN ch USING (season, team)""")
def _(t):
    m = T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), MONTH)
    return T.champion_label(T.season_totals(m), t.playoff_rows).select("season", "team", *r6("rpe"), "label")


@query("measures_long_h12", "WITH " + RUN + """
SELECT season, team, 'wp' AS measure, round(wp, 6) AS value FROM tot UNION ALL SELECT season, team, 'rpe', round(rpe, 6) FROM tot
UNION ALL SELECT season, team, 'corsi_lvl', CAST(corsi_lvl AS DOUBLE) FROM tot""")
def _(t):
    m = T.season_totals(T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), MONTH))
    return T.measures_long(m, ["wp", "rpe", "corsi_lvl"]).withColumn("value", F.round("value", 6))


@query("indicator_correlation_d30", "WITH " + RUN + """
SELECT season, 'wp|rpe' AS pair, round(corr(wp, rpe), 6) AS corr FROM tot GROUP BY season
UNION ALL SELECT season, 'wp|corsi_lvl', round(corr(wp, corsi_lvl), 6) FROM tot GROUP BY season
UNION ALL SELECT season, 'rpe|corsi_lvl', round(corr(rpe, corsi_lvl), 6) FROM tot GROUP BY season""")
def _(t):
    m = T.season_totals(T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), MONTH))
    return T.correlation_pairs(m, ["wp", "rpe", "corsi_lvl"], ["season"]).withColumn("corr", F.round("corr", 6))


@query("standings_d11", """
SELECT season, team, CAST(sum(win) AS BIGINT) AS w, CAST(sum(CASE WHEN win = 0 AND game_end = 'REG' THEN 1 ELSE 0 END) AS BIGINT) AS l,
CAST(sum(CASE WHEN win = 0 AND game_end <> 'REG' THEN 1 ELSE 0 END) AS BIGINT) AS otl,
CAST(sum(2 * win + CASE WHEN win = 0 AND game_end <> 'REG' THEN 1 ELSE 0 END) AS BIGINT) AS pts, count(*) AS gp
FROM box GROUP BY season, team""")
def _(t):
    return T.standings(t.games)
