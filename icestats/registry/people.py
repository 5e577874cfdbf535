"""Queries of players, draft, linkage, travel, playoffs and small relational operators."""

from pyspark.sql import functions as F

from icestats.operators import draft as D
from icestats.operators import linkage as L
from icestats.operators import players as P
from icestats.operators import playoffs as Y
from icestats.operators import rows as R
from icestats.operators import teams as T
from icestats.operators import travel as V
from icestats.plans.slicing import exact_quantiles
from icestats.registry.base import query
from icestats.registry.teams import PAIRED, PLACES, RUN, r6

col = F.col
SEC = "(CAST(split_part(toi, ':', 1) AS BIGINT) * 60 + CAST(split_part(toi, ':', 2) AS BIGINT))"


# -- players ---------------------------------------------------------------
@query("skater_rates_k1", """SELECT player_id, season, team, round(CAST(points AS DOUBLE) / games_played, 6) AS points_per_game, round(CASE WHEN shots > 0 THEN CAST(goals AS DOUBLE) / shots END, 6) AS shooting_pct
FROM player_season WHERE position IN ('C', 'L', 'D') AND player_id % 10 <> 3""")
def _(t):
    d = t.player_season.withColumn("season_type", F.when(col("player_id") % 10 == 3, "3").when(col("player_id") % 10 == 4, F.lit(None)).otherwise("2"))
    d = P.numeric(P.regular_seasons(d).withColumn("points", col("points").cast("string")), ["points"])
    return P.skater_rates(d).select("player_id", "season", "team", *r6("points_per_game", "shooting_pct"))


@query("goalie_rates_k1", "SELECT player_id, season, team, round(CAST(saves AS DOUBLE) / games_played, 6) AS saves_per_game, round(CAST(wins AS DOUBLE) / games_played, 6) AS win_pct FROM player_season WHERE position = 'G'")
def _(t):
    return P.goalie_rates(t.player_season).select("player_id", "season", "team", *r6("saves_per_game", "win_pct"))


def index_sql(measures: dict[str, str], who: str, least: int) -> str:
    """Mean of the z-scores of the measures that a row has, in seasons of five rows or more."""
    m = list(measures)
    z = lambda c: f"CASE WHEN stddev_samp({c}) OVER w = 0 THEN 0 * {c} ELSE ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS z_{c}"
    return f"""WITH s AS (SELECT player_id, season, team, {", ".join(f"{v} AS {k}" for k, v in measures.items())} FROM player_season WHERE {who} AND games_played >= {least}),
z AS (SELECT player_id, season, team, count(*) OVER w AS n, {", ".join(map(z, m))} FROM s WINDOW w AS (PARTITION BY season))
SELECT player_id, season, team, round(({" + ".join(f"coalesce(z_{c}, 0)" for c in m)}) / nullif({" + ".join(f"(z_{c} IS NOT NULL)::INT" for c in m)}, 0), 3) AS ppi FROM z WHERE n >= 5"""


PER_GAME = "CAST({} AS DOUBLE) / games_played"
SKATER_SQL = {
    **{f"{m}_per_game": PER_GAME.format(m) for m in ("points", "goals", "assists", "shots")}, "plus_minus": "CAST(plus_minus AS DOUBLE)",
    "shooting_pct": "CAST(goals AS DOUBLE) / nullif(shots, 0)", "toi_per_game": PER_GAME.format("time_on_ice"),
}
GOALIE_SQL = {
    "save_pct": "CAST(saves AS DOUBLE) / nullif(saves + goals_against, 0)", "gaa_inv": "-" + PER_GAME.format("goals_against"), "wins": "CAST(wins AS DOUBLE)",
    "shutouts": "CAST(shutouts AS DOUBLE)", "saves_per_game": PER_GAME.format("saves"),
}


@query("skater_index_e23", index_sql(SKATER_SQL, "position <> 'G'", P.SKATER_GAMES))
def _(t):
    return P.performance_index(P.skater_rates(t.player_season), P.SKATER_INDEX, min_games=P.SKATER_GAMES).select("player_id", "season", "team", "ppi")


@query("goalie_index_k3", index_sql(GOALIE_SQL, "position = 'G'", P.GOALIE_GAMES))
def _(t):
    return P.performance_index(P.goalie_rates(t.player_season), P.GOALIE_INDEX, min_games=P.GOALIE_GAMES).select("player_id", "season", "team", "ppi")


@query("team_codes_k2", "SELECT gameid, n, home AS own_team, away AS opp_team, 'home' AS side FROM games, range(1, 4) r(n) UNION ALL SELECT gameid, n, away, home, 'away' FROM games, range(1, 4) r(n)")
def _(t):
    # three rows per side; only the first carries the code
    rows = t.box.select("gameid", "side", "team", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("n"))
    rows = rows.withColumn("code", F.when(col("n") == 1, col("team"))).drop("team")
    return P.team_codes(rows).select("gameid", "n", "side", "own_team", "opp_team")


@query("season_list_k4", "SELECT DISTINCT season FROM player_season")
def _(t):
    return P.seasons(t.player_season)


@query("player_list_k4", "SELECT DISTINCT player_id FROM player_season")
def _(t):
    return P.player_list(t.player_season)


@query("game_log_k5", "SELECT gameid, game_date, team, opponent, goals, toi FROM player_game WHERE player_id = 17")
def _(t):
    return P.game_log(t.player_game, 17).select("gameid", "game_date", "team", "opponent", "goals", "toi")


SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in P.SKATER_SUMS)


@query("weekly_skater_d12", f"""SELECT player_id, CAST(date_trunc('week', game_date) AS DATE) AS week_start, {SUMS}, count(*) AS games,
concat(CAST(sum({SEC}) // 60 AS VARCHAR), ':', lpad(CAST(sum({SEC}) % 60 AS VARCHAR), 2, '0')) AS toi, round(avg(faceoff_pct), 6) AS faceoff_pct, array_to_string(list_sort(list_distinct(list(opponent))), ', ') AS opponents,
min(struct_pack(d := game_date, g := gameid, t := team)).t AS team FROM player_game GROUP BY 1, 2""")
def _(t):
    return P.weekly_skater(t.player_game).withColumn("faceoff_pct", F.round("faceoff_pct", 6))


@query("weekly_goalie_d13", """SELECT player_id, CAST(date_trunc('week', game_date) AS DATE) AS week_start, count(*) AS games, CAST(sum(CAST(split_part(save_text, '/', 1) AS BIGINT)) AS BIGINT) AS saves, CAST(sum(CAST(split_part(save_text, '/', 2) AS BIGINT)) AS BIGINT) AS faced,
count(CASE WHEN decision = 'W' THEN 1 END) AS wins, count(CASE WHEN decision = 'L' THEN 1 END) AS losses, round(sum(CAST(split_part(save_text, '/', 1) AS DOUBLE)) / sum(CAST(split_part(save_text, '/', 2) AS BIGINT)), 3) AS save_pct, CAST(sum(goals_against) AS BIGINT) AS ga_week, round(CAST(sum(goals_against) AS DOUBLE) / count(*), 2) AS gaa,
array_to_string(list_sort(list_distinct(list(opponent))), ', ') AS opponents, min(struct_pack(d := game_date, g := gameid, t := team)).t AS team
FROM player_game WHERE position = 'G' GROUP BY 1, 2""")
def _(t):
    w = P.weekly_goalie(t.player_game.filter(col("position") == "G"))
    return w.select("player_id", "week_start", "games", "saves", "faced", "wins", "losses", "save_pct", "ga_week", "gaa", "opponents", "team")


@query("season_rollup_d14", """SELECT player_id, season, CAST(sum(games_played) AS BIGINT) AS games_played, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(points) AS BIGINT) AS points, round(avg(time_on_ice), 6) AS mean_toi,
max(struct_pack(g := games_played, t := team)).t AS team FROM player_season GROUP BY player_id, season""")
def _(t):
    return P.season_rollup(t.player_season).select("player_id", "season", "games_played", "goals", "points", *r6("mean_toi"), "team")


MEANS = ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in P.SKATER_SUMS)


@query("summary_with_mode_d15", f"""WITH c AS (SELECT player_id, CAST(year(game_date) AS INT) AS season, name, count(*) AS n FROM player_game GROUP BY 1, 2, 3),
m AS (SELECT player_id, season, min(struct_pack(n := -n, o := name)).o AS name FROM c GROUP BY 1, 2),
g AS (SELECT player_id, CAST(year(game_date) AS INT) AS season, count(*) AS games, {SUMS}, {MEANS}, CAST(sum({SEC}) AS BIGINT) AS toi_seconds,
 CAST((2 * sum(CAST(round(faceoff_pct * 100) AS BIGINT)) * 10000 + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000 AS faceoff_pct, max(struct_pack(d := game_date, g := gameid, t := team)).t AS team FROM player_game GROUP BY 1, 2)
SELECT g.*, m.name FROM g JOIN m USING (player_id, season)""")
def _(t):
    s = P.summary_with_mode(t.player_game).withColumn("faceoff_pct", F.round("faceoff_pct", 6).cast("double"))
    return s.withColumns({f"mean_{m}": F.round(f"mean_{m}", 6) for m in P.SKATER_SUMS})


@query("within_team_d16", " UNION ALL ".join(f"""SELECT season, team, '{m}' AS measure, CAST(sum({m}) AS DOUBLE) AS total, round(stddev_samp({m}), 6) AS std, round(avg({m}), 6) AS mean, CAST(min({m}) AS DOUBLE) AS low,
round(quantile_cont({m}, 0.95), 6) AS p95, round(quantile_cont({m}, 0.4), 6) AS p40 FROM player_season GROUP BY season, team""" for m in ("goals", "assists", "shots", "plus_minus")))
def _(t):
    return P.within_team(t.player_season, ["goals", "assists", "shots", "plus_minus"]).select("season", "team", "measure", "total", *r6("std", "mean"), "low", *r6("p95", "p40"))


@query("median_minutes_d17", f"""SELECT player_id, CAST(year(game_date) AS INT) AS season, team, count(*) AS games, CAST(sum(goals) AS BIGINT) AS goals, round(median({SEC} / 60.0), 6) AS median_minutes FROM player_game GROUP BY 1, 2, 3""")
def _(t):
    return P.median_minutes(t.player_game).select("player_id", "season", "team", "games", "goals", *r6("median_minutes"))


@query("origin_table_d18", "SELECT team, count(DISTINCT player_id) AS players FROM player_season GROUP BY team ORDER BY players DESC, team LIMIT 8")
def _(t):
    return P.origin_table(t.player_season, "team")


@query("career_means_d19", """SELECT player_id, max(struct_pack(s := season, p := position)).p AS position, CAST(sum(games_played) AS BIGINT) AS games, round(avg(points), 6) AS mean_points, count(*) AS seasons
FROM player_season GROUP BY player_id ORDER BY avg(points) DESC, player_id LIMIT 20""")
def _(t):
    return P.career_means(t.player_season).withColumn("mean_points", F.round("mean_points", 6))


@query("split_at_p95_k18", """WITH c AS (SELECT season, team, quantile_cont(plus_minus, 0.95) AS p FROM player_season GROUP BY season, team)
SELECT player_id, s.season, s.team, plus_minus, 'high' AS side FROM player_season s JOIN c ON c.season = s.season AND c.team = s.team WHERE plus_minus >= p
UNION ALL SELECT player_id, s.season, s.team, plus_minus, 'low' FROM player_season s JOIN c ON c.season = s.season AND c.team = s.team WHERE plus_minus <= p""")
def _(t):
    return P.split_at_p95(t.player_season, "plus_minus").select("player_id", "season", "team", "plus_minus", "side")


@query("position_spread_k19", "SELECT season, team, position, round(stddev_samp(goals), 6) AS std FROM player_season GROUP BY season, team, position")
def _(t):
    return P.position_spread(t.player_season, "goals").withColumn("std", F.round("std", 6))


@query("goalies_by_gaa_k21", """WITH g AS (SELECT player_id, season, CAST(sum(games_played) AS BIGINT) AS games, sum(goals_against) AS ga FROM player_season WHERE position = 'G' GROUP BY 1, 2)
SELECT player_id, season, games, round(CAST(ga AS DOUBLE) / games, 6) AS gaa, CAST(row_number() OVER (PARTITION BY season ORDER BY CAST(ga AS DOUBLE) / games, player_id) AS INT) AS rank FROM g WHERE games >= 10""")
def _(t):
    return P.goalies_by_gaa(t.player_season).select("player_id", "season", "games", *r6("gaa"), "rank")


@query("running_points_e28", """SELECT player_id, week_start, CAST(sum(p) OVER (PARTITION BY player_id ORDER BY week_start) AS BIGINT) AS points_so_far FROM (SELECT player_id, CAST(date_trunc('week', game_date) AS DATE) AS week_start, sum(goals + assists) AS p FROM player_game GROUP BY 1, 2)""")
def _(t):
    from icestats.plans.slicing import running_total
    w = P.weekly_skater(t.player_game).select("player_id", "week_start", (col("goals") + col("assists")).alias("p"))
    out = running_total(w, ["player_id"], ["week_start"], {"points_so_far": "p"}, slice_by=F.year("week_start"))
    return out.select("player_id", "week_start", col("points_so_far").cast("bigint").alias("points_so_far"))


# -- draft -----------------------------------------------------------------
ATTR = """ca AS (SELECT c.*, d.draft_year, d.overall_pick, d.first_name, d.last_name, d.position, c.season - d.draft_year AS ysd0, CAST(dense_rank() OVER (PARTITION BY c.id ORDER BY c.season) AS INT) AS league_year
FROM career c JOIN draft d ON d.id = c.id WHERE league = 'NHL' AND game_type = 2), aa AS (SELECT * FROM ca WHERE ysd0 >= 0)"""


def attrs(t):
    return D.career_attributes(t.career, t.draft)


# one player per name and draft year, so that a draft row meets the seasons of one player
NAMED = """nm AS (SELECT first_name, last_name, draft_year, min(id) AS id FROM draft GROUP BY 1, 2, 3),
pt AS (SELECT nm.*, season, league, points FROM career c JOIN nm ON nm.id = c.id)"""
NAME_KEYS = ("first_name", "last_name", "draft_year")


def named_points(t):
    return t.career.select("id", "season", "league", "points").join(D.map_of_names(t.draft), "id").select(*NAME_KEYS, "id", "season", "league", "points")


@query("draft_points_k6", f"WITH {NAMED} SELECT d.id, pt.id AS id_stats, pt.season AS season_stats, pt.points AS points_stats FROM draft d JOIN pt USING (first_name, last_name, draft_year)")
def _(t):
    return D.draft_with_points(t.draft, named_points(t), keys=NAME_KEYS).select("id", "id_stats", "season_stats", "points_stats")


@query("career_attributes_k7", f"""WITH {ATTR} SELECT id, season, CAST(ysd0 AS INT) AS years_since_draft, league_year, CASE WHEN ysd0 <= 3 THEN '0-3' WHEN ysd0 <= 6 THEN '4-6' WHEN ysd0 <= 9 THEN '7-9' ELSE '10+' END AS since_bucket,
CASE WHEN overall_pick <= 5 THEN '1-5' WHEN overall_pick <= 10 THEN '6-10' ELSE '11+' END AS pick_bucket, round(CAST(points AS DOUBLE) / games_played, 6) AS points_per_game FROM aa""")
def _(t):
    return attrs(t).select("id", "season", "years_since_draft", "league_year", "since_bucket", "pick_bucket", *r6("points_per_game"))


@query("dense_season_rank_e18", "SELECT id, season, CAST(dense_rank() OVER (PARTITION BY id ORDER BY season) AS INT) AS nth FROM career")
def _(t):
    return R.dense_rank_of(t.career, ["id"], "season", "nth").select("id", "season", "nth")


EXC = ATTR + """, ct AS (SELECT league_year, quantile_cont(points, 0.95) AS cut FROM aa GROUP BY league_year), ex AS (SELECT aa.* FROM aa JOIN ct ON ct.league_year = aa.league_year WHERE points > cut)"""


@query("exceptional_seasons_e27", f"WITH {EXC} SELECT id, season, league_year, points, first_name, last_name FROM ex")
def _(t):
    return D.exceptional_seasons(attrs(t)).select("id", "season", "league_year", "points", "first_name", "last_name")


@query("repeatedly_exceptional_k8", f"WITH {EXC} SELECT id, first_name, last_name, overall_pick, count(*) AS seasons FROM ex GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def _(t):
    return D.repeatedly_exceptional(D.exceptional_seasons(attrs(t)))


@query("career_progression_k9", f"""WITH {ATTR}, b AS (SELECT *, CASE WHEN overall_pick <= 5 THEN '1-5' WHEN overall_pick <= 10 THEN '6-10' ELSE '11+' END AS pick_bucket FROM aa),
q AS (SELECT league_year, pick_bucket, avg(points) AS mean, count(*) AS n, quantile_cont(points, 0.025) AS l, median(points) AS m, quantile_cont(points, 0.975) AS h FROM b GROUP BY 1, 2)
SELECT league_year, pick_bucket, round(mean, 6) AS mean, n, round(CASE WHEN n >= 2 THEN greatest(0, m - l) ELSE 0 END, 6) AS below, round(CASE WHEN n >= 2 THEN greatest(0, h - m) ELSE 0 END, 6) AS above FROM q""")
def _(t):
    return D.progression(attrs(t), ["league_year", "pick_bucket"]).select("league_year", "pick_bucket", *r6("mean"), "n", *r6("below", "above"))


@query("position_mix_k10", "SELECT CASE position WHEN 'C/LW' THEN 'F (multiple)' ELSE position END AS label, count(*) AS n FROM draft GROUP BY 1")
def _(t):
    return D.position_mix(t.draft)


@query("early_outliers_k11", f"WITH {ATTR} SELECT id, season, points FROM aa WHERE id IN (SELECT id FROM aa WHERE (league_year = 1 AND points > 20) OR (league_year = 2 AND points > 25))")
def _(t):
    return D.early_outliers(attrs(t), 20, 25).select("id", "season", "points")


COH = """co AS (SELECT * FROM draft WHERE draft_round IN (1, 2, 3) AND position IN ('C', 'C/LW', 'LW', 'RW', 'D') AND draft_year BETWEEN 1992 AND 1997),
cg AS (SELECT c.id, c.season, d.draft_year, sum(games_played) AS games, c.season - d.draft_year AS ysd FROM career c JOIN co d ON d.id = c.id WHERE league = 'NHL' GROUP BY 1, 2, 3)"""


def coh(t):
    c = D.cohort(t.draft, rounds=[1, 2, 3], years=(1992, 1997))
    return c, D.cohort_games(c, t.career)


@query("cohort_k12", f"WITH {COH} SELECT id, draft_year, position FROM co")
def _(t):
    return coh(t)[0].select("id", "draft_year", "position")


@query("survival_d27", f"""WITH {COH} SELECT CAST(y AS INT) AS ysd, (SELECT count(*) FROM co) AS drafted, count(DISTINCT id) AS active, round(count(DISTINCT id) * 100.0 / (SELECT count(*) FROM co), 6) AS percent
FROM range(0, 11) r(y) LEFT JOIN cg ON cg.ysd = y AND games >= 40 GROUP BY y""")
def _(t):
    return D.survival(*coh(t)).select("ysd", "drafted", "active", *r6("percent"))


@query("survival_by_class_k13", f"""WITH {COH}, dr AS (SELECT draft_year, count(*) AS drafted FROM co GROUP BY 1) SELECT dr.draft_year, CAST(y AS INT) AS ysd, drafted, count(DISTINCT id) AS active, round(count(DISTINCT id) * 100.0 / drafted, 6) AS percent
FROM dr CROSS JOIN range(0, 11) r(y) LEFT JOIN cg ON cg.ysd = y AND games >= 40 AND cg.draft_year = dr.draft_year GROUP BY dr.draft_year, y, drafted""")
def _(t):
    return D.survival(*coh(t), keys=["draft_year"]).select("draft_year", "ysd", "drafted", "active", *r6("percent"))


@query("first_active_d28", f"""WITH {COH}, f AS (SELECT id, min(ysd) AS f FROM cg WHERE games >= 40 AND ysd BETWEEN 0 AND 10 GROUP BY id)
SELECT CAST(y AS INT) AS ysd, (SELECT count(*) FROM co) AS drafted, count(f) AS reached, round(count(f) * 100.0 / (SELECT count(*) FROM co), 6) AS percent FROM range(0, 11) r(y) LEFT JOIN f ON f.f <= y GROUP BY y""")
def _(t):
    return D.first_active(*coh(t)).select("ysd", "drafted", "reached", *r6("percent"))


@query("career_distribution_d29", f"""WITH {COH}, g AS (SELECT co.id, coalesce(sum(games_played), 0) AS g FROM co LEFT JOIN career c ON c.id = co.id AND league = 'NHL' GROUP BY co.id),
b AS (SELECT CASE WHEN g <= 0 THEN '0' WHEN g <= 99 THEN '1-99' WHEN g <= 399 THEN '100-399' WHEN g <= 799 THEN '400-799' ELSE '800+' END AS b FROM g)
SELECT l AS games_group, count(b) AS players, round(count(b) * 100.0 / (SELECT count(*) FROM b), 6) AS percent FROM (VALUES ('0'), ('1-99'), ('100-399'), ('400-799'), ('800+')) v(l) LEFT JOIN b ON b = l GROUP BY l""")
def _(t):
    return D.career_distribution(coh(t)[0], t.career).select("games_group", "players", *r6("percent"))


@query("career_distribution_k14", """WITH g AS (SELECT d.id, coalesce(sum(games_played), 0) AS g FROM draft d LEFT JOIN career c ON c.id = d.id AND league = 'NHL' WHERE draft_year = 1995 GROUP BY d.id)
SELECT l AS games_group, count(CASE WHEN g BETWEEN a AND b THEN 1 END) AS players FROM g, (VALUES ('0', -1, 0), ('1-99', 1, 99), ('100-399', 100, 399), ('400-799', 400, 799), ('800+', 800, 1000000000)) v(l, a, b) GROUP BY l""")
def _(t):
    return D.career_distribution(t.draft.filter(col("draft_year") == 1995), t.career).select("games_group", "players")


@query("id_map_c20", "SELECT first_name, last_name, draft_year, min(id) AS id FROM draft GROUP BY 1, 2, 3")
def _(t):
    return D.map_of_names(t.draft)


@query("career_with_player_c19", "SELECT c.id, c.season, d.first_name, d.last_name FROM career c LEFT JOIN draft d ON d.id = c.id")
def _(t):
    return t.career.join(t.draft.select("id", "first_name", "last_name").distinct(), "id", "left").select("id", "season", "first_name", "last_name")


TOP = """tp AS (SELECT player_id, season, points, CAST(row_number() OVER (PARTITION BY season ORDER BY points DESC, player_id) AS INT) AS rank FROM (SELECT player_id, season, CAST(sum(points) AS BIGINT) AS points FROM player_season GROUP BY 1, 2))"""


def tops(t, k, best=True):
    return D.top_per_season(P.season_rollup(t.player_season).select("player_id", "season", "points"), k, "points", best=best)


@query("top_scorers_k20", f"WITH {TOP} SELECT * FROM tp WHERE rank <= 10")
def _(t):
    return tops(t, 10)


@query("bottom_per_season_f3", """SELECT player_id, season, points, CAST(row_number() OVER (PARTITION BY season ORDER BY points, player_id) AS INT) AS rank FROM (SELECT player_id, season, CAST(sum(points) AS BIGINT) AS points FROM player_season GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY season ORDER BY points, player_id) <= 5""")
def _(t):
    return tops(t, 5, best=False)


@query("first_rank_e19", f"WITH {TOP} SELECT player_id, season, rank FROM tp")
def _(t):
    from icestats.plans.slicing import ranked
    s = P.season_rollup(t.player_season).select("player_id", "season", "points")
    return ranked(s, ["season"], "points", "player_id", "rank").select("player_id", "season", "rank")


@query("one_season_tops_f7", f"WITH {TOP} SELECT player_id FROM tp WHERE rank <= 10 GROUP BY player_id HAVING count(DISTINCT season) = 1")
def _(t):
    return D.one_season_wonders(tops(t, 10))


@query("tenure_counts_k16", "SELECT c.season - d.draft_year AS tenure, d.draft_round, count(DISTINCT c.id) AS players FROM career c JOIN draft d ON d.id = c.id GROUP BY 1, 2")
def _(t):
    return t.career.join(t.draft, "id").groupBy((col("season") - col("draft_year")).alias("tenure"), "draft_round").agg(F.count_distinct("id").alias("players"))


# -- linkage ---------------------------------------------------------------
ODD = "CASE WHEN p_partkey % 4 = 1 THEN concat(p_type, ' ', replace(p_name, 'e', 'a')) WHEN p_partkey % 4 = 3 THEN concat(p_name, ' ', p_type, 's') ELSE concat(p_name, ' ', p_type) END"
NAMES = f"""nm AS (SELECT p_partkey, p_brand, array_to_string(list_sort(string_split(lower({ODD}), ' ')), ' ') AS name FROM part),
pairs AS (SELECT a.p_brand, a.p_partkey AS left_id, b.p_partkey AS right_id, CAST(round((greatest(length(a.name), length(b.name)) - levenshtein(a.name, b.name)) * 100.0 / greatest(length(a.name), length(b.name))) AS INT) AS score
FROM nm a JOIN nm b ON a.p_brand = b.p_brand WHERE a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0)"""


def people(t):
    k = col("p_partkey") % 4
    name = F.when(k == 1, F.concat_ws(" ", "p_type", F.replace(col("p_name"), F.lit("e"), F.lit("a")))).when(k == 3, F.concat(col("p_name"), F.lit(" "), col("p_type"), F.lit("s"))).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    p = t.part.select("p_partkey", "p_brand", name.alias("name"))
    return (p.filter(col("p_partkey") % 2 == 1).withColumnRenamed("p_partkey", "left_id"), p.filter(col("p_partkey") % 2 == 0).withColumnRenamed("p_partkey", "right_id"))


def people_links(t, method="edit"):
    l, r = people(t)
    return L.fuzzy_links(l, r, ["p_brand"], left_id="left_id", right_id="right_id", name="name", method=method)


# rows of one name count once: pairs of names with the rows that bear them
CLASSES = f"""nm AS (SELECT p_partkey, p_brand, array_to_string(list_sort(string_split(lower({ODD}), ' ')), ' ') AS name FROM part),
cl AS (SELECT p_brand, name, p_partkey % 2 AS side, min(p_partkey) AS rep, count(*) AS n FROM nm GROUP BY ALL),
ed AS (SELECT * FROM (SELECT a.p_brand, a.name AS name_l, a.rep AS left_rep, b.rep AS right_rep, a.n AS n_left, b.n AS n_right,
 CAST(round((greatest(length(a.name), length(b.name)) - levenshtein(a.name, b.name)) * 100.0 / greatest(length(a.name), length(b.name))) AS INT) AS score
 FROM cl a JOIN cl b ON a.p_brand = b.p_brand AND a.side = 1 AND b.side = 0) WHERE score > 78)"""


@query("fuzzy_links_c16", f"WITH {NAMES} SELECT p_brand, left_id, right_id, score FROM pairs WHERE score > 78")
def _(t):
    return L.pairs(people_links(t))


@query("fuzzy_class_links_c16", f"WITH {CLASSES} SELECT p_brand, left_rep, right_rep, n_left, n_right, score FROM ed")
def _(t):
    return L.class_links(people_links(t))


@query("fuzzy_members_c16", f"""WITH {CLASSES}, li AS (SELECT p_brand, name_l, CAST(sum(n_right) AS BIGINT) AS n_links FROM ed GROUP BY ALL)
SELECT nm.p_brand, p_partkey AS left_id, rep AS left_rep, coalesce(n_links, 0) AS n_links FROM nm JOIN cl ON cl.p_brand = nm.p_brand AND cl.name = nm.name AND side = 1
LEFT JOIN li ON li.p_brand = nm.p_brand AND li.name_l = nm.name WHERE p_partkey % 2 = 1""")
def _(t):
    return L.members(people_links(t))


@query("fuzzy_links_indel_p1")
def _(t):
    return L.class_links(people_links(t, "indel"))


@query("best_links_c17", f"WITH {NAMES} SELECT left_id, right_id, score FROM pairs WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1")
def _(t):
    return L.best_links(people_links(t)).select("left_id", "right_id", "score")


@query("exact_links_c15", "SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND b.p_partkey % 2 = 0 WHERE a.p_partkey % 2 = 1")
def _(t):
    l = t.part.filter(col("p_partkey") % 2 == 1).select(col("p_partkey").alias("left_id"), "p_brand", "p_name")
    r = t.part.filter(col("p_partkey") % 2 == 0).select(col("p_partkey").alias("right_id"), "p_brand", "p_name")
    return L.exact_links(l, r, ["p_brand", "p_name"]).select("left_id", "right_id")


@query("link_people_k15", f"""WITH {NAMES}, raw AS (SELECT p_partkey, p_brand, {ODD} AS nm0 FROM part), ex AS (SELECT a.p_brand, a.p_partkey AS left_id, b.p_partkey AS right_id FROM raw a JOIN raw b ON a.p_brand = b.p_brand AND a.nm0 = b.nm0 WHERE a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0)
SELECT p_brand, left_id, right_id, 100 AS score, 'exact' AS phase FROM ex UNION ALL SELECT p_brand, left_id, right_id, score, 'fuzzy' FROM pairs WHERE score > 78 AND left_id NOT IN (SELECT left_id FROM ex)""")
def _(t):
    l, r = people(t)
    return L.linked_people(l, r, ["p_brand"], left_id="left_id", right_id="right_id", name="name")


@query("link_people_best_k15", f"""WITH {NAMES}, raw AS (SELECT p_partkey, p_brand, {ODD} AS nm0 FROM part),
ex AS (SELECT a.p_brand, a.p_partkey AS left_id, min(b.p_partkey) AS right_id, count(*) AS n_partners FROM raw a JOIN raw b ON a.p_brand = b.p_brand AND a.nm0 = b.nm0 WHERE a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0 GROUP BY ALL),
fz AS (SELECT p_brand, left_id, right_id, score FROM pairs WHERE score > 78 AND left_id NOT IN (SELECT left_id FROM ex) QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1)
SELECT p_brand, left_id, right_id, 100 AS score, n_partners, 'exact' AS phase FROM ex
UNION ALL SELECT fz.p_brand, left_id, right_id, score, count(*), 'fuzzy' FROM fz JOIN nm r ON r.p_partkey = right_id JOIN nm o ON o.p_brand = r.p_brand AND o.name = r.name AND o.p_partkey % 2 = 0 GROUP BY ALL""")
def _(t):
    l, r = people(t)
    return L.link_people(l, r, ["p_brand"], left_id="left_id", right_id="right_id", name="name")


# -- travel ----------------------------------------------------------------
DIST = """di AS (SELECT home, away, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS hv
FROM (SELECT DISTINCT home, away FROM games) g JOIN arena a ON a.team = g.home JOIN arena b ON b.team = g.away)"""


@query("distance_table_b29", f"WITH {DIST} SELECT home, away, round(hv, 3) AS haversine, round(hv / 800000, 6) AS hours FROM di")
def _(t):
    return V.distance_table(t.games, t.arena).select("home", "away", F.round("haversine", 3).alias("haversine"), *r6("hours"))


@query("ellipsoidal_distance_b30")
def _(t):
    return V.distance_table(t.games, t.arena).select("home", "away", F.round("ellipsoidal", 3).alias("ellipsoidal"))


@query("team_pairs_c13", "SELECT DISTINCT home, away FROM games")
def _(t):
    return V.distance_table(t.games, t.arena).select("home", "away")


@query("games_with_distance_c12", f"WITH {DIST} SELECT gameid, round(hv, 3) AS haversine FROM games g LEFT JOIN di ON di.home = g.home AND di.away = g.away")
def _(t):
    return V.with_distance(t.games, V.distance_table(t.games, t.arena)).select("gameid", F.round("haversine", 3).alias("haversine"))


@query("mean_distance_d24", f"WITH {DIST} SELECT home, round(avg(hv), 3) AS mean_distance FROM di GROUP BY home")
def _(t):
    return V.mean_distance(V.distance_table(t.games, t.arena)).select("home", F.round("mean_distance", 3).alias("mean_distance"))


TRIP = DIST + """, b AS (SELECT bx.*, CASE WHEN side = 'away' THEN hv ELSE 0 END AS d FROM box bx JOIN games g ON g.gameid = bx.gameid LEFT JOIN di ON di.home = g.home AND di.away = g.away),
i AS (SELECT *, sum(CASE WHEN side = 'home' THEN 1 ELSE 0 END) OVER (PARTITION BY season, team ORDER BY game_date, gameid) AS isl FROM b),
tr AS (SELECT gameid, team, season, win, sum(CASE WHEN side = 'away' THEN 1 ELSE 0 END) OVER w AS trip_game, sum(d) OVER w AS trip_distance FROM i WINDOW w AS (PARTITION BY season, team, isl ORDER BY game_date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def trips(t):
    h, a = col("home_goals"), col("away_goals")
    side = lambda name, win: F.struct(F.lit(name).alias("side"), col(name).alias("team"), win.cast("bigint").alias("win"))
    rows = V.flown(t.games, t.arena).select("gameid", "season", "game_date", "distance", F.inline(F.array(side("home", h >= a), side("away", a > h))))
    return V.road_trips(rows, slice_by=F.month("game_date"))


@query("road_trips_e26", f"WITH {TRIP} SELECT gameid, team, CAST(trip_game AS BIGINT) AS trip_game, round(trip_distance, 2) AS trip_distance FROM tr")
def _(t):
    return trips(t).select("gameid", "team", "trip_game", F.round("trip_distance", 2).alias("trip_distance"))


@query("win_rate_by_trip_d23", f"WITH {TRIP} SELECT CAST(trip_game AS BIGINT) AS trip_game, round(avg(win), 6) AS win_rate, count(*) AS games FROM tr GROUP BY trip_game")
def _(t):
    return V.win_rate(trips(t), ["trip_game"], "win").select("trip_game", *r6("win_rate"), "games")


@query("equal_count_buckets_e25", """WITH e AS (SELECT quantile_cont(home_shots + home_blocked, [0.25, 0.5, 0.75]) AS q FROM games) SELECT gameid, CAST(len(list_filter(q, lambda v: v < home_shots + home_blocked)) AS INT) AS bucket FROM games, e""")
def _(t):
    g = t.games.select("gameid", (col("home_shots") + col("home_blocked")).alias("v"))
    return V.equal_count_bucket(g, "v", 4, "bucket").select("gameid", "bucket")


@query("nearest_date_c25", "SELECT game_date FROM (SELECT DISTINCT game_date FROM games WHERE month(game_date) <> 6) ORDER BY abs(game_date - DATE '1997-06-16'), game_date DESC LIMIT 1")
def _(t):
    return V.nearest_date(t.games.filter(F.month("game_date") != 6), "game_date", "1997-06-16")


@query("trusted_places_a19", "SELECT doc_id, lang, source, n_chars FROM documents QUALIFY n_chars = max(n_chars) OVER (PARTITION BY lang, source)")
def _(t):
    d = t.documents.withColumn("k", F.concat_ws("|", "lang", "source"))
    return V.trusted_places(d, "k", "n_chars").select("doc_id", "lang", "source", "n_chars")


# -- playoffs --------------------------------------------------------------
SER = PAIRED + """, se AS (SELECT *, concat(least(team, opponent), '-', greatest(team, opponent)) AS series FROM paired)"""


def series(t):
    return Y.with_series(T.to_team_rows(t.games))


@query("series_games_e20", f"WITH {SER} SELECT gameid, team, series, CAST(row_number() OVER (PARTITION BY season, series, team ORDER BY game_date, gameid) AS INT) AS series_game, count(*) OVER (PARTITION BY season, series) / 2.0::DOUBLE AS series_length FROM se")
def _(t):
    return Y.series_games(series(t), F.month("game_date")).select("gameid", "team", "series", "series_game", "series_length")


@query("rounds_reached_e21", f"WITH {SER} SELECT season, team, count(DISTINCT series) AS rounds FROM se GROUP BY season, team")
def _(t):
    return Y.rounds_reached(series(t))


@query("series_lengths_d21", f"WITH {SER} SELECT season, games, count(*) AS series FROM (SELECT season, series, CAST(count(*) // 2 AS INT) AS games FROM se GROUP BY season, series) GROUP BY season, games")
def _(t):
    return Y.series_lengths(series(t))


@query("champion_d22", "SELECT season, arg_max(team, game_date * 1) AS champion FROM (SELECT season, team, epoch(game_date) * 100000000 + gameid AS game_date FROM box WHERE win = 1) GROUP BY season")
def _(t):
    return Y.champion(t.box)


@query("in_playoffs_c21", "SELECT season, team, gameid FROM box b WHERE EXISTS (SELECT 1 FROM box p WHERE p.season = b.season AND p.team = b.team AND p.game_end = 'SO' AND p.win = 1 AND p.goals = 5)")
def _(t):
    p = t.box.filter((col("game_end") == "SO") & (col("win") == 1) & (col("goals") == 5))
    return Y.in_playoffs(t.box, p).select("season", "team", "gameid")


@query("parity_d20", "WITH " + RUN + """, pa AS (SELECT season, 'wp' AS measure, max(wp) - min(wp) AS spread, stddev_samp(wp) AS std FROM tot GROUP BY season UNION ALL SELECT season, 'corsi_lvl', CAST(max(corsi_lvl) - min(corsi_lvl) AS DOUBLE), stddev_samp(corsi_lvl) FROM tot GROUP BY season)
SELECT p.season, p.measure, round(p.spread, 6) AS spread, round(p.std, 6) AS std, round(p.spread / b.spread, 6) AS spread_index, round(p.std / b.std, 6) AS std_index FROM pa p JOIN pa b ON b.measure = p.measure AND b.season = 1996""")
def _(t):
    m = T.season_totals(T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), F.month("game_date")))
    return Y.parity(m, ["wp", "corsi_lvl"], 1996).select("season", "measure", *r6("spread", "std", "spread_index", "std_index"))


@query("champion_flag_c23", "WITH " + RUN + PLACES + " SELECT season, team, coalesce(place, 0) = 1 AS champion, place IS NOT NULL AS in_playoffs FROM tot LEFT JOIN ch USING (season, team)")
def _(t):
    m = T.season_totals(T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), F.month("game_date")))
    return T.champion_label(m, t.playoff_rows).select("season", "team", (col("label") == "champion").alias("champion"), (col("label") != "missed").alias("in_playoffs"))


# -- small relational operators ---------------------------------------------
@query("mixed_order_f1", "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS n FROM orders")
def _(t):
    from icestats.plans.slicing import global_index
    o = t.orders.withColumn("_p", F.expr("-int(substring(o_orderpriority, 1, 1))"))
    out = global_index(o, "_p", ["o_totalprice", "o_orderkey"], "n", F.floor(col("o_totalprice") / 1000))
    return out.select("o_orderkey", "o_orderpriority", "o_totalprice", (col("n") + 1).cast("bigint").alias("n"))


@query("global_top_f2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return R.top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey")


@query("row_of_maximum_f6", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1")
def _(t):
    return R.row_of_maximum(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey")


@query("lag_features_e6", "SELECT gameid, team, lag(goals, 1) OVER w AS goals_lag1, lag(goals, 2) OVER w AS goals_lag2, lag(shots, 2) OVER w AS shots_lag2 FROM box WINDOW w AS (PARTITION BY season, team ORDER BY game_date, gameid)")
def _(t):
    return R.lag_features(t.box, T.TEAM_KEYS, T.TEAM_ORDER, ["goals", "shots"], 2, F.month("game_date")).select("gameid", "team", "goals_lag1", "goals_lag2", "shots_lag2")


@query("min_max_e22", "SELECT c_custkey, c_nationkey, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def _(t):
    lim = t.customer.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return t.customer.join(lim, "c_nationkey").select("c_custkey", "c_nationkey", F.round(F.try_divide(col("c_acctbal") - col("lo"), col("hi") - col("lo")), 6).alias("scaled"))


@query("quantile_flag_e24", "SELECT gameid, side, shots > (SELECT quantile_cont(shots, 0.75) FROM box) AS high FROM box")
def _(t):
    q = exact_quantiles(t.box, [], "shots", {"q": 0.75}).scalar()
    return t.box.select("gameid", "side", (col("shots") > q).alias("high"))


@query("values_of_columns_g4", "SELECT home AS team FROM games UNION SELECT away FROM games")
def _(t):
    return R.values_of(t.games, ["home", "away"], "team")


@query("shared_opponents_g2", "SELECT team FROM (SELECT away AS team FROM games WHERE home = 'T01' INTERSECT SELECT away FROM games WHERE home = 'T02')")
def _(t):
    opp = lambda h: t.games.filter(col("home") == h).select(col("away").alias("team"))
    return R.shared(opp("T01"), opp("T02"))


@query("unlabelled_ids_g3", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return R.not_in(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("distinct_rows_d31", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("first_per_key_a15", "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey) = 1")
def _(t):
    li = t.lineitem.filter(col("l_linestatus") == "F").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    return R.first_per_key(li, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_shipdate")


@query("widened_report_a23", """SELECT b.team, b.season, b.g, s.sh, w.wn FROM (SELECT team, season, CAST(sum(goals) AS BIGINT) AS g FROM box GROUP BY 1, 2) b
LEFT JOIN (SELECT team, season, CAST(sum(shots) AS BIGINT) AS sh FROM box WHERE season > 1996 GROUP BY 1, 2) s ON s.team = b.team AND s.season = b.season
LEFT JOIN (SELECT team, season, CAST(sum(win) AS BIGINT) AS wn FROM box GROUP BY 1, 2) w ON w.team = b.team AND w.season = b.season""")
def _(t):
    g = lambda d, m, n: d.groupBy("team", "season").agg(F.sum(m).alias(n))
    return R.widen(g(t.box, "goals", "g"), [g(t.box.filter(col("season") > 1996), "shots", "sh"), g(t.box, "win", "wn")], ["team", "season"])


@query("mean_by_game_number_d26", """WITH n AS (SELECT season, win, row_number() OVER (PARTITION BY season, team ORDER BY game_date, gameid) AS no FROM box), s AS (SELECT season, no, avg(win) AS a FROM n GROUP BY season, no)
SELECT no, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.9), 6) AS p90 FROM s GROUP BY no""")
def _(t):
    m = T.running_metrics(T.to_team_rows(t.games), F.month("game_date")).groupBy("season", col("rgame").alias("no")).agg(F.avg("win").alias("a"))
    return m.groupBy("no").agg(F.round(F.avg("a"), 6).alias("mean")).join(exact_quantiles(m, ["no"], "a", {"p90": 0.9}), "no").select("no", "mean", *r6("p90"))


@query("team_joined_twice_c9", "WITH " + RUN + " SELECT p.gameid, p.team, round(a.wp, 6) AS wp_own, round(b.wp, 6) AS wp_opp FROM paired p JOIN tot a ON a.season = p.season AND a.team = p.team JOIN tot b ON b.season = p.season AND b.team = p.opponent")
def _(t):
    p = T.to_team_rows(t.games)
    m = T.season_totals(T.running_metrics(T.shot_levels(p), F.month("game_date"))).select("season", "team", "wp")
    j = p.join(m.withColumnRenamed("wp", "wp_own"), ["season", "team"]).join(m.select("season", col("team").alias("opponent"), col("wp").alias("wp_opp")), ["season", "opponent"])
    return j.select("gameid", "team", *r6("wp_own", "wp_opp"))


@query("travel_hours_b31", f"WITH {DIST} SELECT home, away, round(hv / 1000 / 800, 6) AS hours FROM di")
def _(t):
    return V.distance_table(t.games, t.arena).select("home", "away", *r6("hours"))


@query("name_join_c18", f"WITH {NAMED} SELECT d.id, league AS league_stats, CAST(sum(pt.points) AS BIGINT) AS points_stats FROM draft d JOIN pt USING (first_name, last_name, draft_year) GROUP BY d.id, league")
def _(t):
    per = named_points(t).groupBy(*NAME_KEYS, "league").agg(F.sum("points").alias("points"))
    return D.draft_with_points(t.draft, per, keys=NAME_KEYS).select("id", "league_stats", "points_stats")


@query("union_of_sides_g1", "SELECT gameid, home AS team FROM games UNION ALL SELECT gameid, away FROM games")
def _(t):
    side = lambda c: t.games.select("gameid", col(c).alias("team"))
    return side("home").unionByName(side("away"))
