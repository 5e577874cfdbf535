"""Hockey-shaped views over the given tables, in SQL both engines accept.

Every derived score is integer arithmetic on keys and sums, so both sides agree.
`<name>` marks an input. The few functions that differ are written as macros.
"""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_MACROS = {
    # macro: (Spark text, DuckDB text)
    r"EPOCH\((\w+)\)": (r"(CAST(datediff(CAST(\1 AS DATE), DATE'1970-01-01') AS BIGINT) * 86400 + hour(\1) * 3600 + minute(\1) * 60 + second(\1))", r"CAST(floor(epoch(\1)) AS BIGINT)"),
    r"JSON_K\((\w+)\)": (
        r"CAST(get_json_object(\1, '$.k') AS BIGINT)",
        r"CAST(json_extract_string(\1, '$.k') AS BIGINT)",
    ),
}


def spark_text(text: str) -> str:
    for pat, (spark, _) in _MACROS.items():
        text = re.sub(pat, spark, text)
    return text


def duck_text(text: str) -> str:
    for pat, (_, duck) in _MACROS.items():
        text = re.sub(pat, duck, text)
    return text


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "order_lines": (
        ("lineitem",),
        """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines, min(l_suppkey) AS first_supp,
       CAST(sum(l_quantity) AS BIGINT) AS qty,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_ret
FROM <lineitem> GROUP BY l_orderkey""",
    ),
    "games": (
        ("orders", "customer", "supplier", "order_lines"),
        """SELECT o.o_orderkey AS gameid, CAST(year(o.o_orderdate) AS INT) AS season,
       CAST(o.o_orderdate AS DATE) AS game_date, o.o_orderdate AS start_time,
       concat('T', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS home,
       concat('T', lpad(CAST(s.s_nationkey AS STRING), 2, '0')) AS away,
       (o.o_orderkey * 7 + l.n_lines) % 6 AS home_goals,
       (o.o_orderkey * 11 + o.o_custkey) % 6 AS away_goals,
       20 + l.qty % 20 AS home_shots, 20 + (l.qty * 3 + o.o_orderkey) % 20 AS away_shots,
       (o.o_orderkey + l.qty) % 15 AS home_blocked, (o.o_orderkey * 3 + l.n_lines) % 15 AS away_blocked,
       (o.o_orderkey * 5 + l.n_ret) % 12 AS home_missed, (o.o_orderkey * 13 + l.n_ret) % 12 AS away_missed,
       CASE o.o_orderkey % 10 WHEN 0 THEN 'SO' WHEN 1 THEN 'OT' ELSE 'REG' END AS game_end
FROM <orders> o JOIN <customer> c ON o.o_custkey = c.c_custkey
JOIN <order_lines> l ON l.l_orderkey = o.o_orderkey
JOIN <supplier> s ON s.s_suppkey = l.first_supp
WHERE c.c_nationkey <> s.s_nationkey""",
    ),
    "box": (
        ("games",),
        """SELECT gameid, season, game_date, home AS team, 'home' AS side, home_goals AS goals,
       home_shots AS shots, home_blocked AS blocked, home_missed AS missed,
       CAST(CASE WHEN home_goals >= away_goals THEN 1 ELSE 0 END AS BIGINT) AS win, game_end
FROM <games>
UNION ALL
SELECT gameid, season, game_date, away AS team, 'away' AS side, away_goals AS goals,
       away_shots AS shots, away_blocked AS blocked, away_missed AS missed,
       CAST(CASE WHEN away_goals > home_goals THEN 1 ELSE 0 END AS BIGINT) AS win, game_end
FROM <games>""",
    ),
    "playoff_rows": (
        ("box",),
        """SELECT * FROM <box> WHERE gameid % 23 = 0 AND team < 'T14'""",
    ),
    "plays": (
        ("events",),
        """SELECT user_id AS gameid, event_id, ts, CAST(weekofyear(ts) AS BIGINT) AS period,
       EPOCH(ts) - 1704067200 AS elapsed, JSON_K(props) AS k,
       CASE WHEN event_type = 'signup' THEN 'faceoff' WHEN event_type = 'error' THEN 'penalty'
            WHEN event_type = 'click' AND JSON_K(props) % 4 = 0 THEN 'blocked-shot'
            WHEN event_type = 'click' AND JSON_K(props) % 4 = 1 THEN 'missed-shot'
            WHEN event_type = 'click' THEN 'shot-on-goal'
            WHEN event_type = 'view' AND JSON_K(props) % 3 = 0 THEN 'takeaway'
            WHEN event_type = 'view' AND JSON_K(props) % 3 = 1 THEN 'giveaway'
            WHEN event_type = 'view' THEN 'hit' ELSE 'goal' END AS type,
       CASE WHEN JSON_K(props) % 17 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'HOM' ELSE 'AWY' END AS owner,
       CASE JSON_K(props) % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'N' ELSE 'D' END AS zone,
       CASE WHEN event_type = 'click' THEN event_id % 20 END AS shooter_id,
       CASE WHEN event_type = 'click' AND JSON_K(props) % 4 = 0 THEN (event_id * 7 + 3) % 20 END AS blocker_id,
       CASE WHEN event_type = 'error' THEN event_id % 20 END AS committed_id,
       CASE WHEN event_type = 'error' THEN (event_id * 3 + 1) % 20 END AS drawn_id,
       CASE WHEN event_type = 'error' THEN 600 + 20 * JSON_K(props) END AS duration
FROM <events>""",
    ),
    "roster": (
        ("plays",),
        """SELECT DISTINCT gameid, player_id, CASE WHEN player_id % 3 = 0 THEN 'HOM' ELSE 'AWY' END AS team
FROM (SELECT gameid, shooter_id AS player_id FROM <plays>
      UNION ALL SELECT gameid, blocker_id FROM <plays>
      UNION ALL SELECT gameid, committed_id FROM <plays>
      UNION ALL SELECT gameid, drawn_id FROM <plays>) r
WHERE player_id IS NOT NULL AND player_id <> 19""",
    ),
    "odds": (
        ("games",),
        """SELECT gameid, season, home, away, 'MONEY_LINE_2_WAY' AS description, 'P1' AS partner, start_time,
       start_time - INTERVAL '3' HOUR AS updated,
       CASE WHEN gameid % 2 = 0 THEN -110 - (gameid * 13) % 150 ELSE 100 + (gameid * 13) % 150 END AS home_line,
       CASE WHEN gameid % 2 = 0 THEN 100 + (gameid * 13) % 150 ELSE -110 - (gameid * 13) % 150 END AS away_line
FROM <games>
UNION ALL
SELECT gameid, season, home, away, 'MONEY_LINE_2_WAY', 'P1', start_time, start_time - INTERVAL '1' HOUR,
       CASE WHEN gameid % 3 = 0 THEN -120 - (gameid * 7) % 130 ELSE 105 + (gameid * 7) % 130 END,
       CASE WHEN gameid % 3 = 0 THEN 105 + (gameid * 7) % 130 ELSE -120 - (gameid * 7) % 130 END
FROM <games>
UNION ALL
SELECT gameid, season, home, away, CASE WHEN gameid % 5 = 0 THEN 'MONEY_LINE_3_WAY' ELSE 'MONEY_LINE_2_WAY' END,
       'P2', start_time, start_time + INTERVAL '1' HOUR, 100 + gameid % 90, -140 + gameid % 30
FROM <games>""",
    ),
    "forecasts": (
        ("games",),
        """SELECT gameid, season, game_date, home, away, 1 + gameid % 82 AS n_g_home,
       CAST(CASE WHEN home_goals >= away_goals THEN 1 ELSE 0 END AS BIGINT) AS y,
       CAST(100 + (gameid * 37 + home_goals * 91) % 800 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p_market,
       CAST(100 + (gameid * 53 + away_goals * 17) % 800 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p_elo,
       CAST(100 + (gameid * 71 + home_shots) % 800 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p_process
FROM <games>""",
    ),
    "player_game": (
        ("lineitem", "supplier"),
        """SELECT l_suppkey AS player_id, l_orderkey AS gameid, CAST(l_shipdate AS DATE) AS game_date,
       CASE WHEN l_suppkey % 7 = 0 THEN 'G' WHEN l_suppkey % 3 = 0 THEN 'D' WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'L' END AS position,
       concat('T', lpad(CAST((s_nationkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 25 AS STRING), 2, '0')) AS team,
       concat('T', lpad(CAST(l_partkey % 25 AS STRING), 2, '0')) AS opponent,
       CAST(max(l_linenumber) % 4 AS BIGINT) AS goals, CAST(count(*) AS BIGINT) AS assists,
       CAST(sum(l_quantity) AS BIGINT) % 7 AS shots, CAST(sum(l_quantity) AS BIGINT) % 30 AS shots_against,
       CAST(max(l_linenumber) % 4 + count(*) AS BIGINT) AS points, CAST(sum(l_quantity) AS BIGINT) % 5 - 2 AS plus_minus,
       2 * (CAST(sum(l_quantity) AS BIGINT) % 3) AS pim, CAST(sum(l_quantity) AS BIGINT) % 6 AS hits,
       CAST(sum(l_quantity) AS BIGINT) % 2 AS power_play_goals, CAST(sum(l_quantity) AS BIGINT) % 4 AS blocked_shots,
       20 + CAST(sum(l_quantity) AS BIGINT) % 9 AS shifts, l_partkey % 4 AS giveaways, l_orderkey % 4 AS takeaways,
       (CAST(sum(l_quantity) AS BIGINT) + l_partkey) % 6 AS goals_against,
       concat('Player ', CAST(l_suppkey AS STRING), CASE WHEN l_partkey % 5 = 0 THEN ' Jr' ELSE '' END) AS name,
       concat(lpad(CAST(CAST(sum(l_quantity) AS BIGINT) % 60 AS STRING), 2, '0'), ':',
              lpad(CAST(l_partkey % 60 AS STRING), 2, '0')) AS toi,
       concat(CAST(CAST(sum(l_quantity) AS BIGINT) % 25 AS STRING), '/', CAST(CAST(sum(l_quantity) AS BIGINT) % 25 + 3 AS STRING)) AS save_text,
       CASE WHEN l_orderkey % 3 = 0 THEN 'W' WHEN l_orderkey % 3 = 1 THEN 'L' END AS decision,
       CAST(l_partkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS faceoff_pct
FROM <lineitem> JOIN <supplier> ON l_suppkey = s_suppkey
GROUP BY l_suppkey, l_orderkey, l_shipdate, l_linenumber, l_partkey, s_nationkey""",
    ),
    "player_season": (
        ("lineitem", "supplier"),
        """SELECT l_suppkey AS player_id, CAST(year(l_shipdate) AS INT) AS season,
       concat('T', lpad(CAST((s_nationkey + l_linenumber % 2) % 25 AS STRING), 2, '0')) AS team,
       CASE WHEN l_suppkey % 7 = 0 THEN 'G' WHEN l_suppkey % 3 = 0 THEN 'D' WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'L' END AS position,
       CAST(count(*) AS BIGINT) AS games_played, CAST(sum(l_partkey % 3) AS BIGINT) AS goals,
       CAST(sum(l_partkey % 5) AS BIGINT) AS assists, CAST(sum(l_partkey % 3 + l_partkey % 5) AS BIGINT) AS points,
       CAST(sum(l_partkey % 7) - sum(l_orderkey % 7) AS BIGINT) AS plus_minus, CAST(sum(l_quantity) AS BIGINT) AS shots,
       CAST(sum(l_orderkey % 1200) AS BIGINT) AS time_on_ice, CAST(sum(l_orderkey % 30) AS BIGINT) AS saves,
       CAST(sum(l_orderkey % 4) AS BIGINT) AS goals_against, CAST(sum(l_orderkey % 2) AS BIGINT) AS wins,
       CAST(sum(CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS shutouts
FROM <lineitem> JOIN <supplier> ON l_suppkey = s_suppkey
GROUP BY l_suppkey, year(l_shipdate), l_linenumber % 2, s_nationkey""",
    ),
    "career": (
        ("lineitem",),
        """SELECT l_partkey AS id, CAST(year(l_shipdate) AS INT) AS season,
       CASE WHEN l_partkey % 5 = 0 THEN 'AHL' ELSE 'NHL' END AS league,
       CAST(2 + min(l_linenumber) % 2 AS INT) AS game_type, CAST(sum(l_quantity) AS BIGINT) AS games_played,
       CAST(sum(l_linenumber) AS BIGINT) AS goals, CAST(count(*) AS BIGINT) AS assists,
       CAST(sum(l_linenumber) + count(*) AS BIGINT) AS points
FROM <lineitem> GROUP BY l_partkey, year(l_shipdate)""",
    ),
    "draft": (
        ("part",),
        """SELECT p_partkey AS id, CAST(1992 + p_size % 8 AS INT) AS draft_year, 1 + p_partkey % 7 AS draft_round,
       1 + (p_partkey * 31) % 217 AS overall_pick, p_brand AS team, split_part(p_name, ' ', 1) AS first_name,
       split_part(p_name, ' ', 2) AS last_name,
       CASE p_partkey % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'LW' WHEN 2 THEN 'RW' WHEN 3 THEN 'D' WHEN 4 THEN 'G' ELSE 'C/LW' END AS position
FROM <part>""",
    ),
    "arena": (
        ("nation",),
        """SELECT concat('T', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS team,
       CAST(-120 + (n_nationkey * 37) % 50 AS DOUBLE) AS lon, CAST(25 + (n_nationkey * 13) % 30 AS DOUBLE) AS lat,
       concat('{"type":"Point","coordinates":[', CAST(-120 + (n_nationkey * 37) % 50 AS STRING), ',',
              CAST(25 + (n_nationkey * 13) % 30 AS STRING), ']}') AS geometry
FROM <nation>""",
    ),
}
