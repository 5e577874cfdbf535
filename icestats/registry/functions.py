"""Queries of the scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from icestats.functions import clock as K
from icestats.functions import geo as G
from icestats.functions import names as N
from icestats.functions import odds as O
from icestats.functions import scalars as S
from icestats.registry.base import query

col = F.col


def r(c, n=6):
    return F.round(c, n)


@query("clock_texts_b1", """SELECT player_id, gameid, game_date, toi,
 CAST(split_part(toi, ':', 1) AS BIGINT) * 60 + CAST(split_part(toi, ':', 2) AS BIGINT) AS secs,
 1200 + CAST(split_part(toi, ':', 1) AS BIGINT) * 60 + CAST(split_part(toi, ':', 2) AS BIGINT) AS elapsed,
 round(20 + CAST(split_part(toi, ':', 1) AS DOUBLE) + CAST(split_part(toi, ':', 2) AS DOUBLE) / 60, 6) AS minutes
FROM player_game""")
def _(t):
    return t.player_game.select(
        "player_id", "gameid", "game_date", "toi", K.clock_seconds(col("toi")).alias("secs"),
        K.elapsed_seconds(F.lit(2), col("toi")).alias("elapsed"), r(K.elapsed_minutes(F.lit(2), col("toi"))).alias("minutes"))


@query("clock_minutes_b3", "SELECT player_id, gameid, round(avg(CAST(split_part(toi, ':', 1) AS DOUBLE) + CAST(split_part(toi, ':', 2) AS DOUBLE) / 60), 6) AS m FROM player_game GROUP BY player_id, gameid")
def _(t):
    return t.player_game.groupBy("player_id", "gameid").agg(r(F.avg(K.clock_minutes(col("toi")))).alias("m"))


@query("seconds_text_b4", "SELECT player_id, season, team, concat(CAST(time_on_ice // 60 AS VARCHAR), ':', lpad(CAST(time_on_ice % 60 AS VARCHAR), 2, '0')) AS txt FROM player_season")
def _(t):
    return t.player_season.select("player_id", "season", "team", K.seconds_text(col("time_on_ice")).alias("txt"))


@query("season_labels_b5", """SELECT DISTINCT season, concat(CAST(season AS VARCHAR), '-', lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')) AS label,
 concat(CAST(season AS VARCHAR), '-', CAST(season + 1 AS VARCHAR)) AS long_label FROM games""")
def _(t):
    return t.games.select("season").distinct().select(
        "season", K.season_label(col("season")).alias("label"),
        K.season_key_label(col("season") * 10000 + col("season") + 1).alias("long_label"))


@query("season_of_date_b6", """SELECT gameid, CAST(CASE WHEN month(game_date) >= 10 THEN year(game_date) ELSE year(game_date) - 1 END AS INT) AS season_oct,
 CAST(CASE WHEN month(game_date) * 100 + day(game_date) >= 1015 THEN year(game_date) ELSE year(game_date) - 1 END AS INT) AS season_oct15,
 CAST(CASE WHEN month(game_date) >= 8 THEN year(game_date) ELSE year(game_date) - 1 END AS INT) AS season_aug FROM games""")
def _(t):
    d = col("game_date")
    return t.games.select("gameid", K.season_of(d).alias("season_oct"), K.season_of(d, 10, 15).alias("season_oct15"), K.season_of(d, 8).alias("season_aug"))


@query("game_id_digits_b7", """SELECT gid, CAST(substr(CAST(gid AS VARCHAR), 1, 4) AS INT) AS season, CAST(substr(CAST(gid AS VARCHAR), 5, 2) AS INT) AS game_type
FROM (SELECT CAST(season AS BIGINT) * 1000000 + (2 + gameid % 2) * 10000 + gameid % 10000 AS gid FROM games)""")
def _(t):
    g = t.games.select((col("season").cast("bigint") * 1000000 + (2 + col("gameid") % 2) * 10000 + col("gameid") % 10000).alias("gid"))
    return g.select("gid", K.game_id_season(col("gid")).alias("season"), K.game_id_type(col("gid")).alias("game_type"))


@query("mmdd_dates_b8", """SELECT gameid, mmdd, CAST(try_strptime(concat(CAST(CASE WHEN length(CAST(mmdd AS VARCHAR)) = 3 THEN season + 1 ELSE season END AS VARCHAR), lpad(CAST(mmdd AS VARCHAR), 4, '0')), '%Y%m%d') AS DATE) AS d
FROM (SELECT gameid, season, CASE WHEN gameid % 50 = 0 THEN 1399 ELSE month(game_date) * 100 + day(game_date) END AS mmdd FROM games)""")
def _(t):
    g = t.games.select("gameid", "season", F.when(col("gameid") % 50 == 0, 1399).otherwise(F.month("game_date") * 100 + F.dayofmonth("game_date")).cast("bigint").alias("mmdd"))
    return g.select("gameid", "mmdd", K.mmdd_date(col("mmdd"), col("season")).alias("d"))


@query("coercing_cast_b9", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS BIGINT), 0) AS v FROM events""")
def _(t):
    x = F.when(col("event_id") % 3 == 0, col("event_type")).otherwise(col("user_id").cast("string"))
    return t.events.select("event_id", S.number_or(x, default=0).alias("v"))


@query("winner_and_key_b10", """SELECT gameid, CASE WHEN home_goals > away_goals THEN home ELSE away END AS winner,
 concat(away, '_', home, '_', CAST(game_date AS VARCHAR)) AS game_key, md5(concat(away, '_', home, '_', CAST(gameid AS VARCHAR))) AS key FROM games""")
def _(t):
    return t.games.select(
        "gameid", S.winner(col("home"), col("away"), col("home_goals"), col("away_goals")).alias("winner"),
        S.game_key(col("away"), col("home"), col("game_date")).alias("game_key"),
        S.hashed_key(col("away"), col("home"), col("gameid")).alias("key"))


@query("name_search_b12", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def _(t):
    return t.part.filter(N.name_contains(col("p_name"), "RiNG")).select("p_partkey", "p_name")


@query("accents_b13", "SELECT doc_id, md5(strip_accents(lower(text))) AS plain, lower(text) <> strip_accents(lower(text)) AS accented FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", F.md5(N.strip_accents(col("text"))).alias("plain"), (F.lower("text") != N.strip_accents(col("text"))).alias("accented"))


@query("display_names_b14", """SELECT p_partkey, coalesce(nullif(trim(es), ''), nullif(trim(de), ''), nullif(trim(fr), ''), nullif(trim(p_name), '')) AS any_name,
 coalesce(nullif(trim(fr), ''), nullif(trim(p_name), ''), nullif(trim(es), ''), nullif(trim(de), '')) AS fr_name
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN ' ' END AS es, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS de,
 CASE WHEN p_partkey % 7 = 0 THEN concat(p_type, ' fr') ELSE '' END AS fr FROM part)""")
def _(t):
    p = t.part.withColumns({
        "es": F.when(col("p_partkey") % 3 == 0, col("p_brand")).when(col("p_partkey") % 3 == 1, " "),
        "de": F.when(col("p_partkey") % 5 == 0, col("p_type")),
        "fr": F.when(col("p_partkey") % 7 == 0, F.concat("p_type", F.lit(" fr"))).otherwise("")})
    loc = {k: col(k) for k in ("es", "de", "fr")}
    return p.select("p_partkey", N.display_name(col("p_name"), loc).alias("any_name"), N.display_name(col("p_name"), loc, "FR").alias("fr_name"))


@query("canonical_names_b15", """WITH bx AS (SELECT p_partkey % 200 AS id, arg_max(replace(p_name, 'e', 'é'), p_partkey) AS ref FROM part GROUP BY 1)
SELECT p.p_partkey, CASE WHEN p.p_partkey % 200 = 7 THEN 'fixed' WHEN strip_accents(lower(ref)) = strip_accents(lower(p_name)) THEN ref ELSE p_name END AS name
FROM part p LEFT JOIN bx b ON b.id = p.p_partkey % 200""")
def _(t):
    rows = t.part.select("p_partkey", (col("p_partkey") % 200).alias("id"), col("p_name").alias("name"))
    ref = t.part.select((col("p_partkey") % 200).alias("id"), F.replace(col("p_name"), F.lit("e"), F.lit("é")).alias("ref_name"), col("p_partkey").alias("priority"))
    return N.repair_names(rows, ref, key="id", name="name", overrides={7: "fixed"}).select("p_partkey", "name")


@query("saves_text_b16", """SELECT player_id, gameid, game_date, CAST(split_part(save_text, '/', 1) AS BIGINT) AS saves, CAST(split_part(save_text, '/', 2) AS BIGINT) AS faced,
 round(CAST(split_part(save_text, '/', 1) AS DOUBLE) / CAST(split_part(save_text, '/', 2) AS DOUBLE), 6) AS pct FROM player_game""")
def _(t):
    s, f = S.split_saves(col("save_text"))
    return t.player_game.select("player_id", "gameid", "game_date", s.alias("saves"), f.alias("faced"), r(S.ratio(s, f)).alias("pct"))


@query("safe_ratio_b17", """SELECT gameid, round(CASE WHEN away_goals <> 0 THEN CAST(home_goals AS DOUBLE) / away_goals END, 6) AS gap,
 round(CASE WHEN away_goals <> 0 THEN CAST(home_goals AS DOUBLE) / away_goals ELSE 0.5 END, 6) AS filled FROM games""")
def _(t):
    a, b = col("home_goals"), col("away_goals")
    return t.games.select("gameid", r(S.ratio(a, b)).alias("gap"), r(S.ratio(a, b, 0.5)).alias("filled"))


@query("american_odds_b19", """SELECT gameid, updated, round(CASE WHEN home_line > 0 THEN home_line / 100.0 + 1 ELSE 100.0 / -home_line + 1 END, 6) AS dec,
 round(CASE WHEN home_line > 0 THEN 100.0 / (home_line + 100) ELSE -home_line / (100.0 - home_line) END, 6) AS prob FROM odds""")
def _(t):
    return t.odds.select("gameid", "updated", r(O.american_to_decimal(col("home_line"))).alias("dec"), r(O.american_to_probability(col("home_line"))).alias("prob"))


@query("odds_formats_b21", """WITH d AS (SELECT gameid, updated, home_line, CAST(CASE WHEN home_line > 0 THEN home_line ELSE round(1000000.0 / -home_line) / 100 END AS DOUBLE) AS pct FROM odds),
e AS (SELECT *, CAST(round(CASE WHEN home_line > 0 THEN home_line / 100.0 ELSE 100.0 / -home_line END * 10000) AS BIGINT) AS n FROM d)
SELECT gameid, updated, CAST(home_line AS DOUBLE) AS back, concat(CAST(n // gcd(n, 10000) AS VARCHAR), '/', CAST(10000 // gcd(n, 10000) AS VARCHAR)) AS frac,
 round(CAST(n AS DOUBLE) / 10000 + 1, 6) AS again FROM e""")
def _(t):
    d = O.american_to_decimal(col("home_line"))
    o = t.odds.withColumn("_d", d).withColumn("frac", O.decimal_to_fractional(col("_d")))
    return o.select("gameid", "updated", O.decimal_to_american(col("_d")).alias("back"), "frac", r(O.to_decimal(col("frac"), "fractional")).alias("again"))


@query("odds_display_b22", """SELECT gameid, updated, concat(CASE WHEN v > 0 THEN '+' ELSE '-' END, CASE WHEN abs(v) >= 1000 THEN concat(printf('%.1f', abs(v) / 1000.0), 'k') ELSE CAST(abs(v) AS VARCHAR) END) AS txt
FROM (SELECT gameid, updated, home_line * 8 AS v FROM odds)""")
def _(t):
    return t.odds.select("gameid", "updated", O.odds_display(col("home_line") * 8).alias("txt"))


@query("line_spread_b23", """SELECT gameid, updated, CASE WHEN home_line < 0 AND away_line < 0 THEN home_line - away_line WHEN home_line < 0 THEN home_line - away_line + 200 WHEN home_line > 0 THEN home_line - away_line - 200 ELSE 0 END AS spread,
 CASE WHEN home_line < 0 THEN home_line + 100 WHEN home_line > 0 THEN home_line - 100 ELSE 0 END AS alone FROM odds""")
def _(t):
    return t.odds.select("gameid", "updated", O.line_spread(col("home_line"), col("away_line")).alias("spread"), O.own_spread(col("home_line")).alias("alone"))


@query("fixed_buckets_b24", """SELECT id, overall_pick, CASE WHEN overall_pick <= 5 THEN 'top 5' WHEN overall_pick <= 10 THEN '6-10' ELSE 'later' END AS pick_group,
 CASE WHEN overall_pick > -1 AND overall_pick <= 0 THEN '0' WHEN overall_pick <= 99 THEN '1-99' WHEN overall_pick <= 399 THEN '100-399' WHEN overall_pick <= 799 THEN '400-799' END AS games_group FROM draft""")
def _(t):
    p = col("overall_pick")
    return t.draft.select("id", "overall_pick", S.at_most(p, [(5, "top 5"), (10, "6-10")], "later").alias("pick_group"),
                          S.bucket(p, [-1, 0, 99, 399, 799, 9999], ["0", "1-99", "100-399", "400-799", "800+"]).alias("games_group"))


@query("clip_and_focal_b25", """SELECT gameid, greatest(-2, least(2, home_goals - away_goals)) AS state, CASE WHEN home = 'T03' THEN home_goals - away_goals ELSE away_goals - home_goals END AS focal FROM games""")
def _(t):
    d = col("home_goals") - col("away_goals")
    return t.games.select("gameid", S.clip(d, -2, 2).alias("state"), S.focal_value(d, col("home"), F.lit("T03")).alias("focal"))


@query("recode_b26", """SELECT event_id, CASE event_type WHEN 'click' THEN 'Shot' WHEN 'view' THEN 'Possession' WHEN 'error' THEN 'Stop' ELSE event_type END AS grp FROM events""")
def _(t):
    return S.recode(t.events, "event_type", {"click": "Shot", "view": "Possession", "error": "Stop"}, "grp").select("event_id", "grp")


@query("geojson_point_b28", "SELECT team, lon, lat FROM arena")
def _(t):
    lon, lat = G.point_lon_lat(col("geometry"))
    return t.arena.select("team", lon.alias("lon"), lat.alias("lat"))


@query("strength_filter_b32", """SELECT event_id, CAST(substr(code, 2, 1) AS INT) AS away_skaters, CAST(substr(code, 3, 1) AS INT) AS home_skaters FROM
(SELECT event_id, period, CASE k % 3 WHEN 0 THEN '1551' WHEN 1 THEN '1451' ELSE '1541' END AS code FROM plays) WHERE code = '1551' AND period <= 3""")
def _(t):
    p = t.plays.withColumn("situation_code", F.when(col("k") % 3 == 0, "1551").when(col("k") % 3 == 1, "1451").otherwise("1541"))
    d = S.strength_digits(col("situation_code"))
    return S.even_strength(p).select("event_id", d["away_skaters"].alias("away_skaters"), d["home_skaters"].alias("home_skaters"))


@query("hashed_key_b34", "SELECT doc_id, md5(concat(lang, '_', source, '_', CAST(doc_id AS VARCHAR))) AS key, md5(text) AS text_key FROM documents")
def _(t):
    return t.documents.select("doc_id", S.hashed_key(col("lang"), col("source"), col("doc_id")).alias("key"), F.md5("text").alias("text_key"))


@query("clock_continuous_b2", """SELECT player_id, gameid, game_date, round((l - 1) * 20 + CAST(split_part(toi, ':', 1) AS DOUBLE) + CAST(split_part(toi, ':', 2) AS DOUBLE) / 60, 6) AS m
FROM (SELECT *, 1 + gameid % 3 AS l FROM player_game)""")
def _(t):
    p = t.player_game.withColumn("period", 1 + col("gameid") % 3)
    return p.select("player_id", "gameid", "game_date", r(K.elapsed_minutes(col("period"), col("toi"))).alias("m"))


@query("game_keys_b11", "SELECT gameid, concat(away, '_', home, '_', CAST(game_date AS VARCHAR)) AS game_key FROM games")
def _(t):
    return t.games.select("gameid", S.game_key(col("away"), col("home"), col("game_date")).alias("game_key"))


@query("ratio_with_fallback_b18", "SELECT season, team, round(CASE WHEN sum(goals) FILTER (WHERE side = 'away') = 0 THEN 0.5 ELSE CAST(sum(goals) FILTER (WHERE side = 'home') AS DOUBLE) / CAST(sum(goals) FILTER (WHERE side = 'away') AS DOUBLE) END, 6) AS ratio FROM box GROUP BY season, team")
def _(t):
    g = t.box.groupBy("season", "team").agg(*[F.sum(F.when(col("side") == s, col("goals"))).alias(s) for s in ("home", "away")])
    return g.select("season", "team", r(S.ratio(col("home"), col("away"), 0.5)).alias("ratio"))


@query("american_probability_b20", "SELECT gameid, partner, updated, round(CASE WHEN away_line > 0 THEN 100.0 / (away_line + 100) ELSE -away_line / (100.0 - away_line) END, 6) AS p FROM odds")
def _(t):
    return t.odds.select("gameid", "partner", "updated", r(O.american_to_probability(col("away_line"))).alias("p"))


@query("focal_alignment_b33", "SELECT gameid, CASE WHEN home = 'T07' THEN home_shots - away_shots ELSE away_shots - home_shots END AS delta FROM games WHERE home = 'T07' OR away = 'T07'")
def _(t):
    g = t.games.filter((col("home") == "T07") | (col("away") == "T07"))
    return g.select("gameid", S.focal_value(col("home_shots") - col("away_shots"), col("home"), F.lit("T07")).alias("delta"))
