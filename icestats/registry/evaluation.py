"""Queries of forecast evaluation and statistics."""

from pyspark.sql import functions as F

from icestats.operators import evaluation as E
from icestats.operators import playoffs as Y
from icestats.operators import stats as S
from icestats.operators import teams as T
from icestats.registry.base import query
from icestats.registry.teams import RUN, STREAK, r6

col = F.col
MODELS = ["p_market", "p_elo", "p_process"]


def inverse(source: str, out: str, name: str, n: int) -> str:
    """CTEs that turn the columns name_i_j of `source` into those of the inverse matrix, row by row (Gauss-Jordan)."""
    steps, at = [], source
    for k in range(n):
        m = lambda i, j: f"{name}_{i}_{j}"
        new = [
            f"1 / {m(k, k)} AS {m(i, j)}" if i == j == k else f"{m(k, j)} / {m(k, k)} AS {m(i, j)}" if i == k
            else f"-{m(i, k)} / {m(k, k)} AS {m(i, j)}" if j == k else f"{m(i, j)} - {m(i, k)} * {m(k, j)} / {m(k, k)} AS {m(i, j)}"
            for i in range(n) for j in range(n)
        ]
        to = out if k == n - 1 else f"{out}_{k}"
        steps.append(f"{to} AS (SELECT * REPLACE ({', '.join(new)}) FROM {at})")
        at = to
    return ",\n".join(steps)


def _sum(terms):
    return " + ".join(terms)


# two-sided normal tail by its series; beyond 9 it is 0 to all digits shown
NORMAL_P = "CASE WHEN abs({z}) >= 9 THEN 0 WHEN {z} = 0 THEN 1 ELSE 1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(abs({z})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))) END"


def robust_sql(table: str, y: str, xs: list[str]) -> str:
    """CTE `hc` (b_i, v_i_j, n, r2): least squares with HC1 covariance, from sums and a Gauss-Jordan inverse."""
    n, x = len(xs) + 1, ["1.0::DOUBLE", *[f"{c}::DOUBLE" for c in xs]]
    pairs = [(i, j) for i in range(n) for j in range(n)]
    return f"""ro AS (SELECT {', '.join(f'{v} AS x_{i}' for i, v in enumerate(x))}, {y}::DOUBLE AS y FROM {table}),
mo AS (SELECT {', '.join(f'sum(x_{i} * x_{j}) AS w_{i}_{j}' for i, j in pairs)}, {', '.join(f'sum(x_{i} * y) AS q_{i}' for i in range(n))}, sum(y * y) AS yy, sum(y) AS sy, count(*) AS n FROM ro WHERE {' AND '.join(f'x_{i} IS NOT NULL' for i in range(n))} AND y IS NOT NULL),
{inverse('mo', 'iv', 'w', n)},
be AS (SELECT *, {', '.join(_sum(f'w_{i}_{j} * q_{j}' for j in range(n)) + f' AS b_{i}' for i in range(n))} FROM iv),
me AS (SELECT {', '.join(f'sum(pow(y - ({_sum(f"b_{k} * x_{k}" for k in range(n))}), 2) * x_{i} * x_{j}) AS e_{i}_{j}' for i, j in pairs)} FROM ro, be WHERE {' AND '.join(f'x_{i} IS NOT NULL' for i in range(n))} AND y IS NOT NULL),
hc AS (SELECT be.*, {', '.join('(' + _sum(f'w_{i}_{k} * e_{k}_{l} * w_{l}_{j}' for k in range(n) for l in range(n)) + f') * n / (n - {n}) AS v_{i}_{j}' for i, j in pairs)},
 1 - (yy - ({_sum(f'b_{i} * q_{i}' for i in range(n))})) / (yy - sy * sy / n) AS r2 FROM be, me)"""


def robust_terms(xs: list[str], more: str = "") -> str:
    """One row per coefficient of `hc`."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS term, round(b_{i}, 6) AS coef, round(sqrt(v_{i}_{i}), 6) AS se, round({NORMAL_P.format(z=f'(b_{i} / sqrt(v_{i}_{i}))')}, 6) AS p, n, round(r2, 6) AS r2{more} FROM hc"
        for i, name in enumerate(["const", *xs])
    )


PAIRS = [("p_market", "p_process"), ("p_market", "p_elo"), ("p_elo", "p_process")]


@query("scoring_table_j13", " UNION ALL ".join(f"""SELECT season, '{m}' AS model, round(avg(pow(y - {m}, 2)), 6) AS brier,
round(avg(-(y * ln({m}) + (1 - y) * ln(1 - {m}))), 6) AS log_loss FROM forecasts GROUP BY season""" for m in MODELS))
def _(t):
    return E.scoring_table(t.forecasts, "y", MODELS, ["season"]).select("season", "model", *r6("brier", "log_loss"))


WALD = "((b_0 * b_0 * v_1_1 - 2 * b_0 * (b_1 - 1) * v_0_1 + (b_1 - 1) * (b_1 - 1) * v_0_0) / (v_0_0 * v_1_1 - v_0_1 * v_1_0))"


@query("mincer_zarnowitz_j14", f"WITH {robust_sql('forecasts', 'y', ['p_market'])} {robust_terms(['p_market'], f', round({WALD}, 4) AS wald, round(exp(-{WALD} / 2), 6) AS wald_p')}")
def _(t):
    m = E.mincer_zarnowitz(t.forecasts, "y", "p_market")
    return m.select("term", *r6("coef", "se", "p"), "n", *r6("r2"), F.round("wald", 4).alias("wald"), *r6("wald_p"))


# two-step GMM with the instruments 1, p, p squared and two more
Z5 = ["1.0::DOUBLE", "p_market", "p_market * p_market", "p_elo", "n_g_home::DOUBLE"]
I5, P5 = range(5), [(i, j) for i in range(5) for j in range(5)]


def gmm_step(source: str, name: str, weight: str) -> str:
    """CTE `name`: a, b and the covariance c_i_j of the moments in `source` under the weights weight_i_j."""
    xwx = lambda i, j: _sum(f"z_{k}_{i} * {weight}_{k}_{l} * z_{l}_{j}" for k, l in P5)
    xwy = lambda i: _sum(f"z_{k}_{i} * {weight}_{k}_{l} * q_{l}" for k, l in P5)
    return f"""{name}_s AS (SELECT *, {xwx(0, 0)} AS s00, {xwx(0, 1)} AS s01, {xwx(1, 1)} AS s11, {xwy(0)} AS t0, {xwy(1)} AS t1 FROM {source}),
{name} AS (SELECT *, (s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01) AS a, (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS b, s00 / (s00 * s11 - s01 * s01) AS c11 FROM {name}_s)"""


@query("gmm_efficiency_j15", f"""WITH ro AS (SELECT {', '.join(f'{z} AS i_{k}' for k, z in enumerate(Z5))}, y::DOUBLE AS y FROM forecasts),
mo AS (SELECT {', '.join(f'sum(i_{i} * i_{j}) AS z_{i}_{j}, sum(i_{i} * i_{j}) AS w_{i}_{j}' for i, j in P5)}, {', '.join(f'sum(i_{i} * y) AS q_{i}' for i in I5)}, count(*) AS n FROM ro),
{inverse('mo', 'iv', 'w', 5)}, {gmm_step('iv', 'g1', 'w')},
me AS (SELECT {', '.join(f'sum(pow(y - a - b * i_1, 2) * i_{i} * i_{j}) AS u_{i}_{j}' for i, j in P5)} FROM ro, g1),
mu AS (SELECT mo.*, me.* FROM mo, me), {inverse('mu', 'iu', 'u', 5)}, {gmm_step('iu', 'g2', 'u')},
gj AS (SELECT *, {_sum(f'(q_{i} - a * z_{i}_0 - b * z_{i}_1) * u_{i}_{j} * (q_{j} - a * z_{j}_0 - b * z_{j}_1)' for i, j in P5)} AS j FROM g2)
SELECT round(a, 5) AS alpha, round(b, 5) AS beta, round(sqrt(c11), 6) AS beta_se, round(j, 3) AS j, round({NORMAL_P.format(z='sqrt(j)')} + sqrt(2 * j / pi()) * exp(-j / 2), 6) AS j_p, 3 AS df, n FROM gj""")
def _(t):
    g = E.gmm_efficiency(t.forecasts, "y", "p_market", ["p_elo", "n_g_home"])
    return g.select(F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"), *r6("beta_se"), F.round("j", 3).alias("j"), *r6("j_p"), "df", "n")


# the t tail from the normal one, to the first order in 1 / n
@query("diebold_mariano_j16", "WITH dm AS (" + " UNION ALL ".join(f"""SELECT '{a}' AS model_a, '{b}' AS model_b, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) AS n
FROM (SELECT pow(y - {a}, 2) - pow(y - {b}, 2) AS d FROM forecasts)""" for a, b in PAIRS) + f""") SELECT model_a, model_b, round(m, 6) AS mean_diff, round(t, 6) AS t, n,
round({NORMAL_P.format(z='t')} + exp(-t * t / 2) / sqrt(2 * pi()) * (pow(abs(t), 3) + abs(t)) / (2 * (n - 1)), 4) AS p FROM dm""")
def _(t):
    return E.diebold_mariano(t.forecasts, "y", PAIRS).select("model_a", "model_b", *r6("mean_diff", "t"), "n", F.round("p", 4).alias("p"))


@query("forecast_encompassing_j17", f"WITH {robust_sql('forecasts', 'y', MODELS)} {robust_terms(MODELS)}")
def _(t):
    return E.forecast_encompassing(t.forecasts, "y", MODELS).select("term", *r6("coef", "se", "p"), "n", *r6("r2"))


@query("rolling_gmm_j18")
def _(t):
    g = E.rolling_gmm(t.forecasts, "y", "p_market", ["p_elo", "n_g_home"], date="game_date", order=["gameid"], fine=F.floor(col("gameid") / 100_000))
    return g.select("i", "last_date", *r6("alpha", "beta", "beta_se"))


@query("efficiency_score_j19")
def _(t):
    g = E.rolling_gmm(t.forecasts, "y", "p_market", ["p_elo", "n_g_home"], date="game_date", order=["gameid"], fine=F.floor(col("gameid") / 100_000))
    return g.select("i", F.round(E.efficiency_score(col("alpha"), col("beta")), 6).alias("score"))


@query("calibration_curve_j20", """WITH e AS (SELECT quantile_cont(p_market, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM forecasts),
b AS (SELECT y, p_market, CAST(len(list_filter(q, lambda v: v < p_market)) AS INT) AS bin FROM forecasts, e)
SELECT bin, round(avg(p_market), 6) AS mean_forecast, round(avg(y), 6) AS share, count(*) AS n FROM b GROUP BY bin""")
def _(t):
    return E.calibration_curve(t.forecasts, "y", "p_market").select("bin", *r6("mean_forecast", "share"), "n")


@query("range_histogram_j21", """SELECT CASE WHEN p_elo > 0 AND p_elo <= 0.25 THEN '(0, 0.25]' WHEN p_elo <= 0.5 THEN '(0.25, 0.5]' WHEN p_elo <= 0.75 THEN '(0.5, 0.75]' ELSE '(0.75, 1]' END AS range, count(*) AS n FROM forecasts GROUP BY 1""")
def _(t):
    return E.range_histogram(t.forecasts, "p_elo", [0, 0.25, 0.5, 0.75, 1])


@query("rolling_scores_j28", " UNION ALL ".join(f"""SELECT season, '{m}' AS model, game_no, round(sum(s) OVER w / sum(n) OVER w, 6) AS brier FROM
(SELECT season, n_g_home AS game_no, sum(pow(y - {m}, 2)) AS s, count(*) AS n FROM forecasts GROUP BY season, n_g_home)
WINDOW w AS (PARTITION BY season ORDER BY game_no RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)""" for m in MODELS))
def _(t):
    return E.rolling_scores(t.forecasts, "y", MODELS, keys=["season"], game_no="n_g_home").select("season", "model", "game_no", *r6("brier"))


@query("segment_calibration_j29", """WITH s AS (SELECT *, CASE WHEN n_g_home <= 25 THEN 'early' WHEN n_g_home <= 55 THEN 'middle' ELSE 'late' END AS segment FROM forecasts),
e AS (SELECT segment, quantile_cont(p_elo, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM s GROUP BY segment),
b AS (SELECT s.segment, y, p_elo, CAST(len(list_filter(q, lambda v: v < p_elo)) AS INT) AS bin FROM s JOIN e ON e.segment = s.segment)
SELECT segment, bin, round(avg(p_elo), 6) AS mean_forecast, round(avg(y), 6) AS share, count(*) AS n FROM b GROUP BY segment, bin""")
def _(t):
    return E.segment_calibration(t.forecasts, "y", "p_elo", "n_g_home").select("segment", "bin", *r6("mean_forecast", "share"), "n")


@query("frontier_j30", "WITH " + RUN + """, mk AS (SELECT season, team, avg(p) AS mm FROM (SELECT season, home AS team, p_market AS p FROM forecasts UNION ALL SELECT season, away, 1 - p_market FROM forecasts) GROUP BY season, team)
SELECT t.season, t.team, round(t.rpe, 6) AS rpe, round(mm, 6) AS mean_market FROM tot t JOIN mk ON mk.season = t.season AND mk.team = t.team""")
def _(t):
    m = T.season_totals(T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), F.month("game_date")))
    return E.frontier(m, t.forecasts, "rpe", "p_market").select("season", "team", *r6("rpe", "mean_market"))


# a season's measures against its results, by game number in the series of two teams
MEASURES = {"corsi": "corsi_lvl", "expectation": "rpe", "rpi": "rpi", "win_rate": "wp"}
SERIES = STREAK + """, po AS (SELECT season, gameid, team, opponent, win, row_number() OVER (PARTITION BY season, least(team, opponent), greatest(team, opponent) ORDER BY game_date, gameid) AS game
 FROM paired WHERE side = 'home'),
ms AS (SELECT t.season, t.team, corsi_lvl, rpe, rpi, t.wp FROM tot t JOIN rpi r ON r.season = t.season AND r.team = t.team)"""


@query("better_measure_won_j26", f"WITH {SERIES}, ck AS (" + " UNION ALL ".join(
    f"SELECT CAST(game AS INT) AS series_game, '{m}' AS measure, CAST((h.{c} >= a.{c}) = (win = 1) AS INT) AS hit FROM po JOIN ms h ON h.season = po.season AND h.team = po.team JOIN ms a ON a.season = po.season AND a.team = po.opponent"
    for m, c in MEASURES.items()) + """) SELECT series_game, measure, count(*) AS n, round(avg(hit) * 100, 6) AS ratio, round(sqrt(avg(hit) * (1 - avg(hit)) / count(*)) * 100, 6) AS se FROM ck GROUP BY series_game, measure""")
def _(t):
    metrics = T.game_metrics(t.games, "month(game_date)")
    table = T.team_season(t.games, metrics=metrics).select("season", "team", *MEASURES.values())
    side = lambda key, end: table.select("season", F.col("team").alias(key), *[F.col(c).alias(f"{c}{end}") for c in MEASURES.values()])
    rows = Y.series_games(Y.with_series(metrics), "month(game_date)").filter(col("side") == "home")
    rows = rows.join(side("team", "_home"), ["season", "team"]).join(side("opponent", "_away"), ["season", "opponent"])
    b = E.better_measure_won(rows, {m: (col(f"{c}_home"), col(f"{c}_away")) for m, c in MEASURES.items()}, col("win") == 1, ["series_game"])
    return b.select("series_game", "measure", "n", *r6("ratio", "se"))


@query("classification_report_l7", """WITH c AS (SELECT season, sum(CAST(y = 1 AND p_elo >= 0.5 AS INT)) AS tp, sum(CAST(y = 0 AND p_elo >= 0.5 AS INT)) AS fp, sum(CAST(y = 1 AND p_elo < 0.5 AS INT)) AS fn, sum(CAST(y = 0 AND p_elo < 0.5 AS INT)) AS tn FROM forecasts GROUP BY season)
SELECT season, 'win' AS class, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall, round(2 * tp / (2 * tp + fp + fn), 3) AS f1, CAST(tp + fn AS BIGINT) AS support FROM c
UNION ALL SELECT season, 'loss', round(tn / (tn + fn), 3), round(tn / (tn + fp), 3), round(2 * tn / (2 * tn + fp + fn), 3), CAST(tn + fp AS BIGINT) FROM c""")
def _(t):
    return E.classification_report(t.forecasts.withColumn("pred", (col("p_elo") >= 0.5).cast("int")), "y", "pred", ["season"])


@query("win_predictors_j25")
def _(t):
    metrics = T.game_metrics(t.games, "month(game_date)")
    return E.win_predictors(T.game_indicators(metrics, T.team_season(t.games, metrics=metrics)), "win")


KS = """vc AS (SELECT event_type AS g, value AS v, count(*) AS c FROM events GROUP BY 1, 2),
pr AS (SELECT x.g AS a, y.g AS b FROM (SELECT DISTINCT g FROM vc) x JOIN (SELECT DISTINCT g FROM vc) y ON x.g < y.g),
mg AS (SELECT a, b, v, sum(CASE WHEN g = a THEN c ELSE 0 END) AS ca, sum(CASE WHEN g = b THEN c ELSE 0 END) AS cb FROM pr JOIN vc ON g = a OR g = b GROUP BY a, b, v),
rn AS (SELECT *, sum(ca) OVER w / sum(ca) OVER (PARTITION BY a, b) AS fa, sum(cb) OVER w / sum(cb) OVER (PARTITION BY a, b) AS fb, sum(ca) OVER (PARTITION BY a, b) AS na FROM mg WINDOW w AS (PARTITION BY a, b ORDER BY v))"""


@query("ks_pairs_l1", f"WITH {KS} SELECT a, b, round(max(abs(fa - fb)), 6) AS ks, CAST(max(na) AS BIGINT) AS na FROM rn GROUP BY a, b")
def _(t):
    return S.ks_pairs(t.events, "event_type", "value", F.floor(col("v") / 2)).select("a", "b", *r6("ks"), "na")


@query("ecdf_l2", "SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS share FROM events")
def _(t):
    return S.ecdf(t.events, "event_type", "value", F.floor(col("v") / 2)).withColumn("share", F.round("share", 6))


@query("mann_whitney_l3", """WITH r AS (SELECT event_id % 2 = 0 AS f, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM events)
SELECT round(sum(CASE WHEN f THEN rk ELSE 0 END) - sum(CAST(f AS INT)) * (sum(CAST(f AS INT)) + 1) / 2, 6) AS u, CAST(sum(CAST(f AS INT)) AS BIGINT) AS n1, CAST(sum(CAST(NOT f AS INT)) AS BIGINT) AS n2 FROM r""")
def _(t):
    return S.mann_whitney(t.events.withColumn("f", col("event_id") % 2 == 0), "f", "value", F.floor(col("v") / 2)).select(*r6("u"), "n1", "n2")


@query("average_rank_e17", "WITH " + RUN + " SELECT season, team, rank() OVER (PARTITION BY season ORDER BY rwin DESC) + (count(*) OVER (PARTITION BY season, rwin) - 1) / 2 AS rank FROM tot")
def _(t):
    m = T.season_totals(T.running_metrics(T.shot_levels(T.to_team_rows(t.games)), F.month("game_date")))
    return S.average_rank(m, ["season"], "rwin").select("season", "team", "rank")


@query("maxwell_fit_l5", """WITH s AS (SELECT event_type, count(*) AS n, sum(value * value) AS s2, sum(ln(value)) AS sl, sqrt(sum(value * value) / count(*) / 3) AS sc FROM events WHERE value > 0 GROUP BY event_type)
SELECT event_type, n, round(sc, 6) AS scale, round(n * (ln(sqrt(2 / pi())) - 3 * ln(sc)) + 2 * sl - s2 / (2 * sc * sc), 4) AS log_likelihood FROM s""")
def _(t):
    return S.maxwell_fit(t.events, ["event_type"], "value").select("event_type", "n", *r6("scale"), F.round("log_likelihood", 4).alias("log_likelihood"))


@query("proportion_error_l6", "SELECT season, round(avg(y), 6) AS p, round(sqrt(avg(y) * (1 - avg(y)) / count(*)), 6) AS se FROM forecasts GROUP BY season")
def _(t):
    p, se = S.proportion_error(F.sum("y"), F.count(F.lit(1)))
    return t.forecasts.groupBy("season").agg(F.round(p, 6).alias("p"), F.round(se, 6).alias("se"))


@query("bootstrap_shares_l4")
def _(t):
    return S.bootstrap_shares(t.plays, ["zone"], "type")


TENURE = """tn AS (SELECT games_played, season - draft_year AS tenure, draft_round FROM career JOIN draft ON draft.id = career.id)"""


@query("tenure_regression_k17", f"WITH {TENURE}, {robust_sql('tn', 'games_played', ['tenure', 'draft_round'])} {robust_terms(['tenure', 'draft_round'])}")
def _(t):
    d = t.career.join(t.draft, "id").withColumn("tenure", (col("season") - col("draft_year")).cast("double"))
    return E.robust_ols(d, "games_played", ["tenure", "draft_round"])[0].select("term", *r6("coef", "se", "p"), "n", *r6("r2"))
