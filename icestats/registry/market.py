"""Queries of betting lines and ratings."""

from pyspark.sql import functions as F

from icestats.functions import odds as O
from icestats.operators import market as M
from icestats.operators import ratings as R
from icestats.operators import teams as T
from icestats.plans.slicing import tasks_for
from icestats.registry.base import query
from icestats.registry.teams import PAIRED, r6

col = F.col
MONTHS = "year(game_date) * 12 + month(game_date)"
DEC = "CASE WHEN {0} > 0 THEN {0} / 100.0 + 1 ELSE 100.0 / -{0} + 1 END"


@query("odds_load_j1", f"""SELECT gameid, description, partner, updated, round({DEC.format('home_line')}, 6) AS dec_home, round({DEC.format('away_line')}, 6) AS dec_away
FROM odds WHERE gameid % 4 <> 0 OR partner <> 'P2'""")
def _(t):
    o = t.odds.withColumn("country", F.when((col("gameid") % 4 == 0) & (col("partner") == "P2"), "CA").when(col("gameid") % 4 == 1, "US"))
    return M.load_odds(o).select("gameid", "description", "partner", "updated", *r6("dec_home", "dec_away"))


@query("outcomes_load_j2", """SELECT gameid, season, game_date, home, away, home_goals, away_goals, CAST(home_goals > away_goals AS BIGINT) AS home_win,
CAST(away_goals > home_goals AS BIGINT) AS away_win FROM games WHERE gameid % 5 <> 0""")
def _(t):
    return M.load_outcomes(t.games, F.when(col("gameid") % 5 == 0, 3).otherwise(2))


def line_tasks(t):
    """Tasks for the lines, of which a game has three."""
    return tasks_for(t.orders, 3)[0]


@query("latest_lines_f5", """SELECT gameid, description, partner, max(updated) AS updated, arg_max(home_line, updated) AS home_line, arg_max(away_line, updated) AS away_line
FROM odds GROUP BY gameid, description, partner""")
def _(t):
    return M.latest_lines(t.odds, tasks=line_tasks(t)).select("gameid", "description", "partner", "updated", "home_line", "away_line")


@query("closing_lines_c24", """SELECT gameid, description, max(updated) AS updated, arg_max(home_line, updated) AS home_line, arg_max(away_line, updated) AS away_line
FROM odds WHERE updated < start_time GROUP BY gameid, description""")
def _(t):
    return M.closing_lines(t.odds).select("gameid", "description", "updated", "home_line", "away_line")


@query("scoreboard_lines_j27", """SELECT gameid, arg_max(home_line, updated) AS home_line, arg_max(away_line, updated) AS away_line, arg_max(partner, updated) AS partner
FROM odds WHERE description = 'MONEY_LINE_2_WAY' GROUP BY gameid""")
def _(t):
    return M.scoreboard_lines(t.odds)


@query("odds_outcomes_c6", """SELECT o.gameid, o.description, o.home, o.away, o.home_line, o.away_line, g.home_goals, g.away_goals,
CAST(g.home_goals > g.away_goals AS BIGINT) AS home_win FROM (SELECT gameid, season, home, away, description, arg_max(home_line, updated) AS home_line, arg_max(away_line, updated) AS away_line
FROM odds GROUP BY gameid, season, home, away, description) o JOIN games g ON g.gameid = o.gameid AND g.season = o.season AND g.home = o.home AND g.away = o.away""")
def _(t):
    return M.odds_with_outcomes(t.odds, M.load_outcomes(t.games), line_tasks(t)).select(
        "gameid", "description", "home", "away", "home_line", "away_line", "home_goals", "away_goals", "home_win")


PRIOR = PAIRED + """, p AS (SELECT gameid, team, side, coalesce(sum(goals) OVER w, 0) AS gf, coalesce(sum(goals_against) OVER w, 0) AS ga,
 coalesce(sum(shots) OVER w, 0) AS sf, coalesce(sum(shots_against) OVER w, 0) AS sa, coalesce(sum(shots + blocked) OVER w, 0) AS cf, coalesce(sum(shots_against + blocked_against) OVER w, 0) AS ca, count(*) OVER w AS n
 FROM paired WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pr AS (SELECT gameid, team, side, CAST(n AS BIGINT) AS p_games, CASE WHEN gf + ga = 0 THEN 0.5 ELSE CAST(gf * gf AS DOUBLE) / CAST(gf * gf + ga * ga AS DOUBLE) END AS pythagorean,
 CASE WHEN sf + sa = 0 THEN 0.5 ELSE CAST(sf AS DOUBLE) / CAST(sf + sa AS DOUBLE) END AS ff_pct, CASE WHEN cf + ca = 0 THEN 0.5 ELSE CAST(cf AS DOUBLE) / CAST(cf + ca AS DOUBLE) END AS cf_pct FROM p)"""


@query("team_panel_j3", "WITH " + PRIOR + " SELECT gameid, team, p_games, round(cf_pct, 10) AS cf_pct, round(ff_pct, 10) AS ff_pct, round(pythagorean, 10) AS pythagorean FROM pr")
def _(t):
    return T.prior_metrics(T.to_team_rows(t.games), F.month("game_date")).select("gameid", "team", "p_games", *[F.round(c, 10).alias(c) for c in ("cf_pct", "ff_pct", "pythagorean")])


@query("analytical_matrix_j4", "WITH " + PRIOR + """ SELECT g.gameid, h.p_games AS n_home, a.p_games AS n_away, round(h.cf_pct - a.cf_pct, 6) AS delta_cf_pct,
round(h.ff_pct - a.ff_pct, 6) AS delta_ff_pct, round(h.pythagorean - a.pythagorean, 6) AS delta_pythagorean
FROM games g LEFT JOIN pr h ON h.gameid = g.gameid AND h.team = g.home LEFT JOIN pr a ON a.gameid = g.gameid AND a.team = g.away""")
def _(t):
    p = T.prior_metrics(T.to_team_rows(t.games), F.month("game_date"))
    return M.analytical_matrix(M.load_outcomes(t.games), p).select(
        "gameid", "n_home", "n_away", *r6("delta_cf_pct", "delta_ff_pct", "delta_pythagorean"))


RAW = f"raw AS (SELECT gameid, description, partner, updated, 1 / ({DEC.format('home_line')}) AS a, 1 / ({DEC.format('away_line')}) AS b FROM odds)"


@query("margin_proportional_j5", f"WITH {RAW} SELECT gameid, description, partner, updated, round(a / (a + b), 6) AS prob_home, round(b / (a + b), 6) AS prob_away, round(a + b - 1, 6) AS margin FROM raw")
def _(t):
    return M.remove_margin(M.load_odds(t.odds), vig="proportional").select("gameid", "description", "partner", "updated", *r6("prob_home", "prob_away", "margin"))


@query("margin_shin_j6", f"""WITH {RAW}, z AS (SELECT *, a + b AS s, ((a + b - 1) * ((a - b) * (a - b) - (a + b))) / ((a + b) * ((a - b) * (a - b) - 1)) AS z FROM raw)
SELECT gameid, description, partner, updated, round((sqrt(z * z + 4 * (1 - z) * a * a / s) - z) / (2 * (1 - z)), 6) AS prob_home,
round((sqrt(z * z + 4 * (1 - z) * b * b / s) - z) / (2 * (1 - z)), 6) AS prob_away, round(z, 6) AS shin_z FROM z""")
def _(t):
    return M.remove_margin(M.load_odds(t.odds)).select("gameid", "description", "partner", "updated", *r6("prob_home", "prob_away", "shin_z"))


@query("implied_probabilities_j7", f"""WITH {RAW}, z AS (SELECT *, a + b AS s, ((a + b - 1) * ((a - b) * (a - b) - (a + b))) / ((a + b) * ((a - b) * (a - b) - 1)) AS z FROM raw)
SELECT gameid, description, partner, updated, round(a / (a + b), 6) AS basic_home, round((sqrt(z * z + 4 * (1 - z) * a * a / s) - z) / (2 * (1 - z)), 6) AS shin_home, round((a + b) / a, 6) AS fair_home, 1.0::DOUBLE AS three_sum FROM z""")
def _(t):
    lines = F.array(col("home_line"), col("away_line"))
    basic = O.implied_probabilities(lines, "american", "proportional")
    o = t.odds.withColumns({"_b": basic, "_s": O.implied_probabilities(lines, "american", "shin"),
                            "_t": O.implied_probabilities(F.array(col("home_line"), col("away_line"), F.lit(900)), "american", "shin")})
    return o.select("gameid", "description", "partner", "updated", F.round(col("_b")[0], 6).alias("basic_home"),
                    F.round(col("_s")[0], 6).alias("shin_home"), F.round(O.odds_from_probabilities(col("_b"))[0], 6).alias("fair_home"),
                    F.round(F.aggregate("_t", F.lit(0.0), lambda a, x: a + x), 6).alias("three_sum"))


ELO_GAMES = "SELECT gameid, season, game_date, home, away, CAST(CASE WHEN home_goals > away_goals THEN 1 WHEN home_goals = away_goals THEN 0.5 ELSE 0 END AS DOUBLE) AS outcome, p_market"


def elo_games(t):
    h, a = col("home_goals"), col("away_goals")
    g = t.games.select("gameid", "season", "game_date", "home", "away", F.when(h > a, 1.0).when(h == a, 0.5).otherwise(0.0).alias("outcome"), F.lit("L").alias("league"))
    return g.join(t.forecasts.select("gameid", "p_market"), "gameid")


ELO_SUMS = """g AS (SELECT gameid, game_date, home, away, CAST(CASE WHEN home_goals > away_goals THEN 1 WHEN home_goals = away_goals THEN 0.5 ELSE 0 END AS DOUBLE) AS outcome FROM games),
gm AS (SELECT g.*, f.p_market FROM g JOIN forecasts f ON f.gameid = g.gameid),
lg AS (SELECT gameid, game_date, home AS team, 'home' AS side, outcome - p_market AS d FROM gm UNION ALL SELECT gameid, game_date, away, 'away', p_market - outcome FROM gm),
su AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY team ORDER BY game_date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lg),
sm AS (SELECT gm.gameid, gm.game_date, gm.outcome, a.s AS sh, b.s AS sa FROM gm JOIN su a ON a.gameid = gm.gameid AND a.side = 'home' JOIN su b ON b.gameid = gm.gameid AND b.side = 'away')"""


@query("market_elo_j9", f"WITH {ELO_SUMS} SELECT gameid, round(1500 + 10 * sh, 6) AS r_home, round(1500 + 10 * sa, 6) AS r_away, round(1 / (1 + pow(10.0, -(10 * sh - 10 * sa + 25) / 400.0)), 6) AS p_bors FROM sm")
def _(t):
    return R.market_elo(elo_games(t), slice_by=MONTHS).select("gameid", *r6("r_home", "r_away", "p_bors"))


@query("market_elo_grid_j10", f"""WITH {ELO_SUMS}, ix AS (SELECT *, row_number() OVER (ORDER BY game_date, gameid) - 1 AS i, count(*) OVER () AS n FROM sm),
cells AS (SELECT k, h FROM range(4, 34, 4) a(k), range(10, 55, 5) b(h))
SELECT CAST(k AS INT) AS k, CAST(h AS INT) AS hfa, round(avg(pow(outcome - 1 / (1 + pow(10.0, -(k * (sh - sa) + h) / 400.0)), 2)), 6) AS brier
FROM ix, cells WHERE i >= floor(n * 0.25) GROUP BY k, h""")
def _(t):
    return R.market_elo_grid(elo_games(t), slice_by=MONTHS).withColumn("brier", F.round("brier", 6))


@query("advantage_bump_j11", "SELECT DISTINCT n_g_home AS hfa, round(1 / (1 + pow(10.0, -n_g_home / 400.0)) - 0.5, 6) AS bump FROM forecasts")
def _(t):
    return t.forecasts.select(col("n_g_home").alias("hfa"), F.round(R.advantage_bump(col("n_g_home")), 6).alias("bump")).distinct()


@query("expanding_logit_j12")
def _(t):
    f = M.analytical_matrix(M.load_outcomes(t.games), T.prior_metrics(T.to_team_rows(t.games), F.month("game_date")))
    out = R.expanding_logit(f, ["delta_cf_pct", "delta_ff_pct", "delta_pythagorean"], "home_win", block="game_date")
    return out.select("gameid", "game_date", "converged", *r6("p_process"))


@query("team_venue_cube_j22", """SELECT gameid, season, home AS team, 'home' AS venue, home_goals AS goals FROM games UNION ALL SELECT gameid, season, away, 'away', away_goals FROM games""")
def _(t):
    return M.sides_long(t.games, {"team": ("home", "away"), "goals": ("home_goals", "away_goals")}, ["gameid", "season"])


@query("sides_wide_c14", "SELECT gameid, home AS home_team, away AS away_team, home_goals, away_goals FROM games")
def _(t):
    return M.sides_wide(t.box, "gameid", ["team", "goals"])


LINES = """ln AS (SELECT c.gameid, g.season, g.home, g.away, g.game_date, g.home_goals, g.away_goals, c.home_line, c.away_line FROM (SELECT gameid, arg_max(home_line, updated) AS home_line, arg_max(away_line, updated) AS away_line
FROM odds WHERE updated < start_time AND description = 'MONEY_LINE_2_WAY' GROUP BY gameid) c JOIN games g ON g.gameid = c.gameid),
ac AS (SELECT *, CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals < away_goals THEN 0.0 ELSE 0.5 END AS win_home,
CASE WHEN home_goals > away_goals THEN 0.0 WHEN home_goals < away_goals THEN 1.0 ELSE 0.5 END AS win_away FROM ln)"""


def lines(t):
    c = M.closing_lines(t.odds.filter(col("description") == "MONEY_LINE_2_WAY"), ("gameid",)).select("gameid", "home_line", "away_line")
    return M.market_accuracy(c.join(t.games.select("gameid", "season", "game_date", "home", "away", "home_goals", "away_goals"), "gameid"))


@query("market_accuracy_j23", f"""WITH {LINES} SELECT gameid, CAST(win_home AS DOUBLE) AS win_home, CAST(win_home = CAST(home_line < away_line AS INT) AS BIGINT) AS hit_home,
CAST(win_away = CAST(home_line > away_line AS INT) AS BIGINT) AS hit_away FROM ac""")
def _(t):
    return lines(t).select("gameid", "win_home", "hit_home", "hit_away")


@query("accuracy_by_team_d25", f"""WITH {LINES} SELECT season, home AS team, CAST(sum(CASE WHEN win_home = CAST(home_line < away_line AS INT) THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS games,
CASE WHEN sum(CASE WHEN home_line < 100 THEN 1 ELSE 0 END) < sum(CASE WHEN home_line > 100 THEN 1 ELSE 0 END) THEN 'Lose Favorite' ELSE 'Win Favorite' END AS expectation,
round(CAST(sum(win_home) AS DOUBLE) / count(*) * 100, 6) AS rate_game FROM ac GROUP BY season, home""")
def _(t):
    a = M.accuracy_by(lines(t), ["season", "home"], "hit_home", "home_line", "win_home")
    return a.select("season", col("home").alias("team"), "hits", "games", "expectation", *r6("rate_game"))


@query("threshold_sweep_j24", f"""WITH {LINES}, lg AS (SELECT home_line AS own, away_line AS opp, win_home AS win FROM ac UNION ALL SELECT away_line, home_line, win_away FROM ac),
sp AS (SELECT win, CASE WHEN own < 0 AND opp < 0 THEN own - opp WHEN own < 0 THEN own - opp + 200 WHEN own > 0 THEN own - opp - 200 ELSE 0 END AS spread,
 CASE WHEN own < 0 THEN own + 100 WHEN own > 0 THEN own - 100 ELSE 0 END AS alone FROM lg),
th AS (SELECT CAST(v AS INT) AS threshold FROM range(1, 600, 10) r(v)),
e AS (SELECT CASE WHEN alone < 0 THEN 'win' ELSE 'loss' END AS side, threshold, win, CASE WHEN alone < 0 THEN CAST(spread < -threshold AS INT) ELSE CAST(spread < threshold AS INT) END AS cut,
 CASE WHEN alone < 0 THEN 1 ELSE 0 END AS tgt FROM sp, th WHERE alone <> 0)
SELECT side, threshold, round(avg(CAST(win = cut AND win = tgt AS INT)), 6) AS tp, round(avg(CAST(win <> cut AND win <> tgt AS INT)), 6) AS fp,
round(avg(CAST(win <> cut AND win = tgt AS INT)), 6) AS fn, round(avg(CAST(win = cut AND win <> tgt AS INT)), 6) AS tn FROM e GROUP BY side, threshold""")
def _(t):
    s = M.sides_long(lines(t), {"own": ("home_line", "away_line"), "opp": ("away_line", "home_line"), "win": ("win_home", "win_away")}, ["gameid"])
    s = s.select("win", O.line_spread(col("own"), col("opp")).alias("spread"), O.own_spread(col("own")).alias("alone"))
    return M.threshold_sweep(s).select("side", "threshold", *r6("tp", "fp", "fn", "tn"))


@query("line_game_numbers_e29", "SELECT gameid, venue, team, CAST(row_number() OVER (PARTITION BY season, team ORDER BY start_time, gameid) AS INT) AS game_no FROM (SELECT gameid, season, start_time, home AS team, 'home' AS venue FROM games UNION ALL SELECT gameid, season, start_time, away, 'away' FROM games)")
def _(t):
    s = M.sides_long(t.games, {"team": ("home", "away")}, ["gameid", "season", "start_time"])
    return M.line_game_numbers(s, F.month("start_time")).select("gameid", "venue", "team", "game_no")


@query("row_pairs_a22", "SELECT season, gameid AS key, CAST(away AS VARCHAR) AS team_away, home AS team_home, away_goals AS goals_away, home_goals AS goals_home FROM games")
def _(t):
    # two rows per game, visitor first; the sheet position counts up within a season and game key
    seq = F.when(col("side") == "away", 0).otherwise(1) + col("gameid") * 2
    p = M.pair_visitor_home(t.box.withColumn("seq", seq), ["season"], "seq", ["team", "goals"])
    return p.select("season", col("pair").alias("key"), "team_away", "team_home", "goals_away", "goals_home")


# archive lines know their game by date and teams only, which repeat; the n-th line of a key belongs to its n-th game
@query("natural_key_join_c8", """WITH li AS (SELECT CAST(start_time AS DATE) AS game_date, home, away, home_line, away_line, row_number() OVER (PARTITION BY CAST(start_time AS DATE), home, away ORDER BY start_time, home_line, away_line) AS n
 FROM odds WHERE partner = 'P1' AND updated = start_time - INTERVAL '1' HOUR),
ga AS (SELECT gameid, game_date, home, away, row_number() OVER (PARTITION BY game_date, home, away ORDER BY start_time, gameid) AS n FROM games)
SELECT li.game_date, li.home, li.away, home_line, away_line, gameid FROM li LEFT JOIN ga ON ga.game_date = li.game_date AND ga.home = li.home AND ga.away = li.away AND ga.n = li.n""")
def _(t):
    last = (col("partner") == "P1") & (col("updated") == col("start_time") - F.expr("INTERVAL 1 HOUR"))
    lines = t.odds.filter(last).select(col("start_time").cast("date").alias("game_date"), "home", "away", "start_time", "home_line", "away_line")
    games = t.games.select("gameid", "game_date", "home", "away", col("start_time").alias("game_start"))
    out = M.natural_key_join(lines, games, ["game_date", "home", "away"], ["start_time", "home_line", "away_line"], ["game_start", "gameid"])
    return out.select("game_date", "home", "away", "home_line", "away_line", "gameid")


@query("panel_join_c7", "WITH " + PRIOR + """ SELECT g.gameid, h.p_games AS n_home, round(h.pythagorean, 10) AS home_pythagorean, round(a.pythagorean, 10) AS away_pythagorean
FROM games g LEFT JOIN pr h ON h.gameid = g.gameid AND h.team = g.home LEFT JOIN pr a ON a.gameid = g.gameid AND a.team = g.away""")
def _(t):
    p = T.prior_metrics(T.to_team_rows(t.games), F.month("game_date"))
    m = M.analytical_matrix(M.load_outcomes(t.games), p)
    return m.select("gameid", "n_home", *[F.round(c, 10).alias(c) for c in ("home_pythagorean", "away_pythagorean")])


ELO_SEASON = """g AS (SELECT gameid, season, home, away, CAST(CASE WHEN home_goals > away_goals THEN 1 WHEN home_goals = away_goals THEN 0.5 ELSE 0 END AS DOUBLE) AS o,
 row_number() OVER (PARTITION BY season ORDER BY game_date, gameid) AS i FROM games),
r AS (SELECT season, 0::BIGINT AS i, NULL::BIGINT AS gameid, NULL::DOUBLE AS h, NULL::DOUBLE AS a, NULL::DOUBLE AS p, MAP([]::VARCHAR[], []::DOUBLE[]) AS m FROM (SELECT DISTINCT season FROM g)
 UNION ALL SELECT season, i, gameid, h, a, p, map_concat(m, MAP([home, away], [h + 12 * (o - p), a - 12 * (o - p)]))
 FROM (SELECT *, 1 / (1 + pow(10.0::DOUBLE, -(h - a + 30) / 400)) AS p FROM (SELECT g.season, g.i, g.gameid, g.home, g.away, g.o, coalesce(r.m[g.home], 1500)::DOUBLE AS h, coalesce(r.m[g.away], 1500)::DOUBLE AS a, r.m FROM r JOIN g ON g.season = r.season AND g.i = r.i + 1)))"""


@query("elo_by_season_j31", f"WITH RECURSIVE {ELO_SEASON} SELECT gameid, round(h, 6) AS r_home, round(a, 6) AS r_away, round(p, 6) AS p_elo FROM r WHERE i > 0")
def _(t):
    # ratings start anew each season, so seasons run in parallel
    return R.elo(elo_games(t), league=["league"], k=12, hfa=30, carry=0.0).select("gameid", *r6("r_home", "r_away", "p_elo"))


def elo_league(carry: str) -> str:
    """The whole league as a recursion over the game number; the state is a map of ratings."""
    return f"""g AS (SELECT gameid, season, home, away, CAST(CASE WHEN home_goals > away_goals THEN 1 WHEN home_goals = away_goals THEN 0.5 ELSE 0 END AS DOUBLE) AS o,
 row_number() OVER (ORDER BY game_date, gameid) AS i FROM games),
r AS (SELECT 0::BIGINT AS i, NULL::INT AS season, NULL::BIGINT AS gameid, NULL::DOUBLE AS h, NULL::DOUBLE AS a, NULL::DOUBLE AS p, MAP([]::VARCHAR[], []::DOUBLE[]) AS m
 UNION ALL SELECT i, season, gameid, h, a, p, map_concat(m, MAP([home, away], [h + 12 * (o - p), a - 12 * (o - p)]))
 FROM (SELECT *, 1 / (1 + pow(10.0::DOUBLE, -(h - a + 30) / 400)) AS p FROM (SELECT g.i, g.season, g.gameid, g.home, g.away, g.o, q.m, coalesce(q.m[g.home], 1500)::DOUBLE AS h, coalesce(q.m[g.away], 1500)::DOUBLE AS a
 FROM (SELECT r.i, n.season, CASE WHEN r.season IS NULL OR r.season = n.season THEN r.m ELSE {carry} END AS m FROM r JOIN g n ON n.i = r.i + 1) q JOIN g ON g.i = q.i + 1)))"""


KEEP = "MAP(map_keys(r.m), list_transform(map_values(r.m), lambda v: 1500 + 0.75::DOUBLE * (v - 1500)))"


@query("elo_j8", f"WITH RECURSIVE {elo_league('r.m')} SELECT gameid, round(h, 6) AS r_home, round(a, 6) AS r_away, round(p, 6) AS p_elo FROM r WHERE i > 0")
def _(t):
    return R.elo(elo_games(t), league=["league"], k=12, hfa=30).select("gameid", *r6("r_home", "r_away", "p_elo"))


@query("elo_season_carry_j31", f"WITH RECURSIVE {elo_league(KEEP)} SELECT gameid, season, round(h, 6) AS r_home, round(a, 6) AS r_away, round(p, 6) AS p_elo FROM r WHERE i > 0")
def _(t):
    return R.elo(elo_games(t), league=["league"], k=12, hfa=30, carry=0.75).select("gameid", "season", *r6("r_home", "r_away", "p_elo"))


# all 72 cells as lists: ratings per team, squared errors so far
GRID = """c AS (SELECT list(CAST(k AS DOUBLE) ORDER BY k, h) AS ks, list(CAST(h AS DOUBLE) ORDER BY k, h) AS hs, list(1500.0::DOUBLE) AS base FROM range(4, 34, 4) x(k), range(10, 55, 5) y(h)),
g AS (SELECT home, away, CAST(CASE WHEN home_goals > away_goals THEN 1 WHEN home_goals = away_goals THEN 0.5 ELSE 0 END AS DOUBLE) AS o,
 row_number() OVER (ORDER BY game_date, gameid) AS i, count(*) OVER () AS n, ks, hs, base FROM games, c),
r AS (SELECT 0::BIGINT AS i, list_transform(ks, lambda x: 0.0::DOUBLE) AS sq, MAP([]::VARCHAR[], []::DOUBLE[][]) AS m FROM c
 UNION ALL SELECT i, CASE WHEN i > floor(n * 0.25) THEN list_transform(sq, lambda x, j: x + pow(o - p[j], 2)) ELSE sq END,
 map_concat(m, MAP([home, away], [list_transform(p, lambda x, j: h[j] + ks[j] * (o - x)), list_transform(p, lambda x, j: a[j] - ks[j] * (o - x))]))
 FROM (SELECT *, list_transform(hs, lambda x, j: 1 / (1 + pow(10.0::DOUBLE, -(h[j] - a[j] + x) / 400))) AS p FROM (SELECT g.*, r.sq, r.m, coalesce(r.m[g.home], g.base) AS h, coalesce(r.m[g.away], g.base) AS a FROM r JOIN g ON g.i = r.i + 1))),
e AS (SELECT unnest(ks) AS k, unnest(hs) AS h, unnest(sq) AS s, n FROM (SELECT sq FROM r ORDER BY i DESC LIMIT 1), (SELECT ks, hs FROM c), (SELECT count(*) AS n FROM g)),
gr AS (SELECT 'L' AS league, CAST(k AS INT) AS k, CAST(h AS INT) AS hfa, s / (n - floor(n * 0.25)) AS brier FROM e)"""


@query("elo_grid_j10", f"WITH RECURSIVE {GRID} SELECT league, k, hfa, round(brier, 6) AS brier FROM gr")
def _(t):
    return R.elo_grid(elo_games(t), league=["league"]).withColumn("brier", F.round("brier", 6))


@query("best_elo_cell_j10", f"WITH RECURSIVE {GRID} SELECT league, k, hfa, round(brier, 6) AS brier FROM gr ORDER BY gr.brier, k, hfa LIMIT 1")
def _(t):
    return R.best_cell(R.elo_grid(elo_games(t), league=["league"]), ["league"]).withColumn("brier", F.round("brier", 6))
