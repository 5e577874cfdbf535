"""Ratings, evaluation and momentum against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from icestats.functions import tails
from icestats.operators import evaluation as E
from icestats.operators import momentum as Z
from icestats.operators import ratings as R


@pytest.fixture(scope="module")
def league(spark):
    rng = np.random.default_rng(1)
    teams, rows = list("ABCDEF"), []
    for g in range(300):
        h, a = rng.choice(teams, 2, replace=False)
        rows.append(("L", g, 2000 + g // 150, f"2000-01-{1 + (g % 150) // 6:02d}" if g < 150 else f"2001-01-{1 + (g % 150) // 6:02d}", h, a, float(rng.integers(0, 2)), float(rng.uniform(0.2, 0.8)), float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "league string, gameid long, season int, d string, home string, away string, outcome double, p_market double, f1 double, f2 double").withColumn("game_date", F.to_date("d")).cache()


def loop(pdf, k, hfa, carry=1.0, market=False):
    r, out, season = {}, {}, None
    for x in pdf.sort_values(["game_date", "gameid"]).itertuples():
        if season is not None and x.season != season:
            r = {t: 1500 + carry * (v - 1500) for t, v in r.items()}
        season = x.season
        h, a = r.get(x.home, 1500.0), r.get(x.away, 1500.0)
        p = 1 / (1 + 10 ** (-(h - a + hfa) / 400))
        out[x.gameid] = p
        e = x.p_market if market else p
        r[x.home], r[x.away] = h + k * (x.outcome - e), a - k * (x.outcome - e)
    return out, r


@pytest.mark.parametrize("carry", [1.0, 0.5, 0.0])
def test_elo_equals_loop(league, carry):
    got = {r["gameid"]: r["p_elo"] for r in R.elo(league, league=["league"], k=16, hfa=30, carry=carry).collect()}
    want, ratings = loop(league.toPandas(), 16, 30, carry)
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
    assert sum(ratings.values()) == pytest.approx(1500 * len(ratings))


@pytest.mark.parametrize("carry", [1.0, 0.5, 0.0])
def test_elo_over_many_pieces_equals_loop(league, carry, monkeypatch):
    monkeypatch.setattr(R, "PIECE_GAMES", 20)
    got = {r["gameid"]: r["p_elo"] for r in R.elo(league, league=["league"], k=16, hfa=30, carry=carry).collect()}
    want, _ = loop(league.toPandas(), 16, 30, carry)
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_one_task_of_a_league_reads_packed_games(league, monkeypatch):
    """F15 F16 F20: the task that steps through a league sorted every game as a row of its own."""
    monkeypatch.setattr(R, "PIECE_GAMES", 60)
    cut, pieces = R._pieces(league, "game_date")
    packed = R._packed(cut, ["league"], ("game_date", "gameid"), "home", "away", "outcome", "season", pieces).collect()
    assert pieces == 5 and len(packed) < 300 / 10
    assert sum(len(r["outcomes"]) for r in packed) == 300 and sum(len(r["sides"]) for r in packed) == 600
    plan = R.elo(league, league=["league"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [league" in plan and "_piece" in plan and "_chunk" in plan


def test_market_elo_equals_loop(league):
    got = {r["gameid"]: r["p_bors"] for r in R.market_elo(league, k=8, hfa=20, slice_by=F.month("game_date") + F.year("game_date") * 12).collect()}
    want, _ = loop(league.toPandas(), 8, 20, market=True)
    assert all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_grid_equals_single_runs(league):
    grid = {(r["k"], r["hfa"]): r["brier"] for r in R.elo_grid(league, league=["league"]).collect()}
    assert len(grid) == 72
    pdf = league.toPandas().sort_values(["game_date", "gameid"])
    p, _ = loop(pdf, 12, 25)
    tail = pdf.iloc[75:]
    assert grid[(12, 25)] == pytest.approx(np.mean([(x.outcome - p[x.gameid]) ** 2 for x in tail.itertuples()]))


def refit(past, row):
    x = past[["f1", "f2"]].to_numpy()
    mu, sd = x.mean(0), x.std(0)
    x1 = np.column_stack([np.ones(len(x)), (x - mu) / sd])
    th = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ th))
        pen = np.diag([0, 1e-5, 1e-5])
        th -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + pen, x1.T @ (p - past.outcome) + pen @ th)
    return 1 / (1 + math.exp(-(th[0] + (row[["f1", "f2"]].to_numpy(float) - mu) / sd @ th[1:])))


def test_expanding_logit_equals_refit(league):
    found = R.expanding_logit(league, ["f1", "f2"], "outcome", block="game_date", steps=25).toPandas().set_index("gameid")
    pdf = league.toPandas()
    assert found["converged"].all()
    for g in range(0, 300, 3):  # every date
        row = pdf[pdf.gameid == g].iloc[0]
        past = pdf[pdf.game_date < row.game_date]
        if len(past) < 50:
            assert math.isnan(found["p_process"][g]) or found["p_process"][g] is None
        else:
            assert found["p_process"][g] == pytest.approx(refit(past, row), abs=1e-6)


def test_expanding_logit_shares_points_among_dates(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 30_000
    x = rng.normal(size=(n, 2))
    pdf = pd.DataFrame({"gameid": np.arange(n), "day": np.arange(n) // 25, "f1": x[:, 0], "f2": x[:, 1], "outcome": (rng.random(n) < 1 / (1 + np.exp(-x @ [0.8, -0.5]))).astype(float)})
    solved = []
    plain = R._newton
    monkeypatch.setattr(R, "_newton", lambda work, features, scale, cuts, *rest: (solved.append(np.asarray(cuts)), plain(work, features, scale, cuts, *rest))[1])
    got = R.expanding_logit(spark.createDataFrame(pdf), ["f1", "f2"], "outcome", block="day").toPandas().set_index("gameid")
    assert got["converged"].all()
    own = np.concatenate(solved)
    assert len(own) < 700 < 1198  # cutoffs with a fit of their own, of all
    assert len(own[own >= 600]) < 100  # few once the history is long
    for day in [*range(3, 40, 3), *range(40, 1200, 97), 1199]:
        row = pdf[pdf.day == day].iloc[0]
        assert got["p_process"][row.gameid] == pytest.approx(refit(pdf[pdf.day < day], row), abs=1e-6)


def test_ols_and_gmm(league):
    pdf = league.toPandas()
    x = np.column_stack([np.ones(300), pdf.p_market, pdf.f1])
    b = np.linalg.lstsq(x, pdf.outcome, rcond=None)[0]
    e = pdf.outcome.to_numpy() - x @ b
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ ((x * (e**2)[:, None]).T @ x) @ inv * 300 / 297
    got = E.robust_ols(league, "outcome", ["p_market", "f1"])[0].toPandas()
    assert np.allclose(got["coef"], b) and np.allclose(got["se"], np.sqrt(np.diag(cov)))

    def gmm(d):
        z = np.column_stack([np.ones(len(d)), d.p_market, d.p_market**2, d.f1, d.f2])
        xx, y = z[:, :2], d.outcome.to_numpy()
        def step(w):
            c = np.linalg.inv((z.T @ xx).T @ w @ (z.T @ xx))
            return c @ ((z.T @ xx).T @ w @ (z.T @ y)), c
        t, _ = step(np.linalg.inv(z.T @ z))
        w2 = np.linalg.inv((z * ((y - xx @ t) ** 2)[:, None]).T @ z)
        t, c = step(w2)
        g = z.T @ (y - xx @ t)
        return t, c, g @ w2 @ g

    t, c, j = gmm(pdf)
    r = E.gmm_efficiency(league, "outcome", "p_market", ["f1", "f2"]).first()
    assert np.allclose([r["alpha"], r["beta"], r["j"]], [t[0], t[1], j]) and r["df"] == 3
    roll = E.rolling_gmm(league, "outcome", "p_market", ["f1", "f2"], date="game_date", order=["gameid"], chunk=70).toPandas().sort_values("i")
    assert list(roll["i"]) == list(range(50, 300))
    s = pdf.sort_values(["game_date", "gameid"])
    for i in (50, 69, 70, 139, 140, 299):
        t, c, _ = gmm(s.iloc[i - 50 : i])
        row = roll[roll.i == i].iloc[0]
        assert np.allclose([row.alpha, row.beta, row.beta_se], [t[0], t[1], math.sqrt(c[1, 1])])
        assert row.last_date == s.iloc[i - 1].game_date


def test_tails():
    assert tails.chi2_tail(7.814727903, 3) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_tail(11.07049769, 5) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_tail(1.959963985) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    for t in (0.3, 1.96, 6.0):  # closed forms of one, two and three degrees
        assert tails.t_tail(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-12)
        assert tails.t_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-12)
        x = t / math.sqrt(3)
        assert tails.t_tail(t, 3) == pytest.approx(1 - 2 / math.pi * (math.atan(x) + x / (1 + x * x)), rel=1e-12)
        for df in (1e8, 1e10, 1e12):
            assert tails.t_tail(t, df) == pytest.approx(tails.normal_tail(t), rel=1e-5)
        assert tails.t_tail(t, 0.999999e6) == pytest.approx(tails.t_tail(t, 1.000001e6), rel=1e-8)
    assert tails.t_tail(0.0, 7) == 1.0 and tails.t_tail(40.0, 1e6) < 1e-200


def test_sweep_shares_sum_to_one(spark):
    from icestats.operators.market import threshold_sweep
    d = spark.createDataFrame([(-300, -50, 1.0), (-20, -10, 0.0), (250, 40, 0.0), (90, 10, 0.5), (0, 0, 1.0)], "spread int, alone int, win double")
    rows = threshold_sweep(d).collect()
    assert len(rows) == 120
    for r in rows:
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == pytest.approx(1.0)
        cut = lambda s: float(s < -r["threshold"]) if r["side"] == "win" else float(s < r["threshold"])
        sub = [(-300, 1.0), (-20, 0.0)] if r["side"] == "win" else [(250, 0.0), (90, 0.5)]
        tgt = 1.0 if r["side"] == "win" else 0.0
        assert r["tp"] == pytest.approx(np.mean([w == cut(s) and w == tgt for s, w in sub]))
        assert r["fp"] == pytest.approx(np.mean([w != cut(s) and w != tgt for s, w in sub]))


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, n in ((1, 300), (2, 5), (3, 90), (4, 1)):  # one game holds most rows and spans several batches
        t = 0
        for i in range(n):
            t += int(rng.integers(0, 30))
            rows.append((g, t, i, float(rng.normal()), float(rng.integers(0, 30)), *[float(x) for x in rng.integers(0, 2, 13)], *[float(x) for x in rng.normal(size=4)]))
    cols = ["gameid", "elapsed", "event_id", "y", "dt", *Z.INPUTS, *Z.COVARIATES]
    return spark.createDataFrame(pd.DataFrame(rows, columns=cols)).cache()


def params():
    rng = np.random.default_rng(4)
    return Z.MomentumParams(a0=2.0, b=list(rng.normal(scale=0.1, size=13)), c=-0.2, d=list(rng.normal(scale=0.1, size=4)), alpha=0.3, beta=-0.2)


def scalar_filter(pdf, p):
    a, c, q, r, p0 = p.decay, math.exp(p.c), math.exp(p.q), math.exp(p.r), math.exp(p.p0)
    nll, out = 0.0, {}
    for g, d in pdf.sort_values(["gameid", "elapsed", "event_id"]).groupby("gameid"):
        u, z, y, dt = d[list(Z.INPUTS)].to_numpy(), d[list(Z.COVARIATES)].to_numpy(), d.y.to_numpy(), d.dt.to_numpy()
        x, v, f = p.alpha * z[0, 0] + p.beta * z[0, 1], p0, []
        for t in range(len(y)):
            at = a ** dt[t]
            xp, vp = at * x + u[t] @ p.b, at * at * v + q
            e, s = y[t] - c * xp - z[t] @ p.d, c * c * vp + r
            k = vp * c / s
            x, v = xp + k * e, (1 - k * c) * vp
            nll += 0.5 * (math.log(s) + e * e / s)
            f.append((xp, vp, x, v))
        sm = [None] * len(y)
        sm[-1] = (f[-1][2], f[-1][3])
        for t in range(len(y) - 2, -1, -1):
            j = f[t][3] * a ** dt[t + 1] / f[t + 1][1]
            sm[t] = (f[t][2] + j * (sm[t + 1][0] - f[t + 1][0]), f[t][3] + j * j * (sm[t + 1][1] - f[t + 1][1]))
        for i, ev in enumerate(d.event_id):
            out[(g, ev)] = (*f[i], *sm[i])
    return nll, out


@pytest.mark.parametrize("slice_by", [None, "0", "floor(elapsed / 70)", "elapsed"])
def test_filter_and_smoother(events, slice_by):
    p = params()
    total, want = scalar_filter(events.toPandas(), p)
    filt = Z.kalman_filter(events, p, slice_by=slice_by)
    rows = filt.collect()
    got = {(r["gameid"], r["event_id"]): (r["x_pred"], r["p_pred"], r["x_filt"], r["p_filt"]) for r in rows}
    assert sum(r["nll"] for r in rows) == pytest.approx(total)
    sm = {(r["gameid"], r["event_id"]): (r["x_smooth"], r["p_smooth"]) for r in Z.rts_smoother(filt, p, slice_by=slice_by).collect()}
    assert got.keys() == want.keys() == sm.keys() and len(rows) == len(got)
    assert all(np.allclose(got[k] + sm[k], want[k]) for k in want)


def test_pieces_of_a_game_run_apart(events):
    filt = Z.kalman_filter(events, params(), slice_by="floor(elapsed / 70)")
    plan = filt._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [gameid" in plan and "_slice" in plan
    sizes = [r["count"] for r in events.selectExpr("gameid", "floor(elapsed / 70) AS piece").groupBy("gameid", "piece").count().collect()]
    assert max(sizes) < 40 < 300


def test_likelihood_and_gradient(events):
    p = params()
    ready = Z.prepare(events)
    want, _ = scalar_filter(events.toPandas(), p)
    theta = p.vector()
    nll, g = Z.likelihood(ready, theta[None, :])
    assert nll[0] == pytest.approx(want)
    h = 1e-5
    bump = np.array([theta + s * h * np.eye(len(theta))[i] for i in range(len(theta)) for s in (1, -1)])
    v, _ = Z.likelihood(ready, bump)
    assert np.allclose(g[0], (v[0::2] - v[1::2]) / (2 * h), rtol=1e-4, atol=1e-4)
    ready.unpersist()


def test_games_are_packed_whole_and_by_every_core(spark, events):
    """one task used to evaluate a small table, and games ran over the borders of its batches."""
    ready = Z.prepare(events)
    got = ready.selectExpr("spark_partition_id() AS part", "first", "last").collect()
    ready.unpersist()
    assert {(r["first"], r["last"]) for r in got} == {(-1, -1)}
    assert len({r["part"] for r in got}) > 1


def test_gradient_of_games_over_several_batches(spark, events):
    thetas = params().vector() + 0.1 * np.random.default_rng(2).normal(size=(3, len(params().vector())))
    whole = Z.prepare(events)
    want = Z.likelihood(whole, thetas)
    whole.unpersist()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "30")
    try:
        parts = Z.prepare(events, pack_rows=10)
        assert parts.filter("first >= 0").count() > 0
        got = Z.likelihood(parts, thetas)
        parts.unpersist()
    finally:
        spark.conf.set(name, before)
    assert np.allclose(got[0], want[0], rtol=1e-10) and np.allclose(got[1], want[1], rtol=1e-9, atol=1e-9)


def season(n_games, seed):
    """Games drawn from the model itself."""
    rng, p, rows = np.random.default_rng(seed), params(), []
    for g in range(n_games):
        n = int(rng.integers(20, 60))
        u, z, dt = rng.integers(0, 2, (n, 13)).astype(float), rng.normal(size=(n, 4)), rng.integers(1, 9, n).astype(float)
        x = p.alpha * z[0, 0] + p.beta * z[0, 1] + rng.normal() * math.exp(p.p0 / 2)
        for i in range(n):
            x = p.decay ** dt[i] * x + u[i] @ p.b + rng.normal() * math.exp(p.q / 2)
            rows.append((g, i, i, math.exp(p.c) * x + z[i] @ p.d + rng.normal() * math.exp(p.r / 2), dt[i], *u[i], *z[i]))
    return pd.DataFrame(rows, columns=["gameid", "elapsed", "event_id", "y", "dt", *Z.INPUTS, *Z.COVARIATES])


def test_fit_ends_where_the_gradient_is_zero(spark):
    pdf = season(60, 3)
    ready = Z.prepare(spark.createDataFrame(pdf))
    f = Z.fit(ready, Z.MomentumParams().vector())
    ready.unpersist()
    assert f.converged[0] and f.slope[0] <= 1e-5

    def nll(theta):
        return scalar_filter(pdf, Z.MomentumParams.of(theta))[0] / len(pdf)

    assert nll(f.theta[0]) < nll(params().vector())  # below the model that made the data
    for i in (0, 1, 7, 14, 16, 19, 22):
        step = 1e-4 * np.eye(len(f.theta[0]))[i]
        assert abs(nll(f.theta[0] + step) - nll(f.theta[0] - step)) / 2e-4 < 1e-4


def test_fit_reports_what_has_not_converged(spark):
    ready = Z.prepare(spark.createDataFrame(season(10, 4)))
    f = Z.fit(ready, Z.MomentumParams().vector(), steps=2)
    ready.unpersist()
    assert not f.converged[0] and f.steps[0] <= 2


def test_bootstrap_equals_a_fit_of_the_drawn_games(spark):
    pdf = season(40, 5)
    df = spark.createDataFrame(pdf)
    start = Z.MomentumParams().vector()
    f = Z.bootstrap_effects(df, start, replicates=6, batch=4)
    assert f.converged.all() and len(f.theta) == 6
    weights = Z.bootstrap_weights(df, 6).toPandas().set_index("gameid")["weights"]
    drawn = [pdf[pdf.gameid == g].assign(gameid=g * 100 + k) for g, w in weights.items() for k in range(w[5])]
    ready = Z.prepare(spark.createDataFrame(pd.concat(drawn)))
    assert Z.likelihood(ready, f.theta[5:])[0][0] == pytest.approx(f.nll[5])
    assert Z.fit(ready, start).nll[0] == pytest.approx(f.nll[5], rel=1e-5)
    ready.unpersist()


def test_bootstrap_packs_once_and_filters_the_common_start_once(spark, events, monkeypatch):
    """games were sorted and packed twice, and the common start of all replicates was filtered once for each."""
    packed, prepare = [], Z.prepare

    def count(df, **kw):
        packed.append(kw)
        return prepare(df, **kw)

    monkeypatch.setattr(Z, "prepare", count)
    Z.bootstrap_effects(events, params().vector(), replicates=3, steps=1)
    assert len(packed) == 1
    # for one vector and no weights: each game's own values, also where a game runs over several batches
    rng, theta = np.random.default_rng(8), params().vector()[None]
    n, lens = 40, np.array([25, 10, 5])
    u, y, z, dt = rng.integers(0, 2, (n, 13)).astype(float), rng.normal(size=n), rng.normal(size=(n, 4)), rng.integers(1, 9, n).astype(float)
    for w in np.eye(3):
        nll, g, _ = Z._sums(theta, u, y, z, dt, lens, w[:, None], -1, -1, None, Z._Room())
        each, g_each, _ = Z._sums(theta, u, y, z, dt, lens, None, -1, -1, None, Z._Room())
        assert nll[0] == pytest.approx(w @ each) and np.allclose(g[0], w @ g_each)


@pytest.mark.parametrize("pack_rows", [10, 20_000])
def test_equal_vectors_under_weights(spark, events, pack_rows):
    theta = params().vector()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "30" if pack_rows == 10 else before)
    try:
        ready = Z.prepare(events, weights=Z.bootstrap_weights(events, 4), pack_rows=pack_rows)
        same = Z.likelihood(ready, np.repeat(theta[None], 4, axis=0), np.arange(4))
        apart = Z.likelihood(ready, np.stack([theta] * 4 + [theta + 0.1]), np.array([0, 1, 2, 3, 0]))
        plain = Z.likelihood(ready, theta[None])
        ready.unpersist()
    finally:
        spark.conf.set(name, before)
    want, _ = scalar_filter(events.toPandas(), params())
    assert plain[0][0] == pytest.approx(want)
    assert np.allclose(same[0], apart[0][:4], rtol=1e-10) and np.allclose(same[1], apart[1][:4], rtol=1e-9, atol=1e-9)


def test_bootstrap_weights_count_the_draws(spark, events):
    """The weights are the counts of the draws, which follow from (replicate, number) alone."""
    from pyspark.sql import functions as F
    n = events.select("gameid").distinct().count()
    draws = spark.range(n * 7).select((F.col("id") % 7).alias("r"), F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(n)).alias("i")).toPandas()
    want = sorted(tuple(int(((draws.i == i) & (draws.r == r)).sum()) for r in range(7)) for i in range(n))
    got = Z.bootstrap_weights(events, 7)
    assert sorted(tuple(w) for w in got.toPandas()["weights"]) == want
    # the draws are shuffled once
    assert "map_from_entries" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_priors_turn_with_the_focal_side(spark):
    from icestats.operators import sequence as Q
    plays = spark.createDataFrame(
        [(1, 1, 1, 0, "faceoff", "HOM", "N"), (1, 2, 1, 5, "hit", "AWY", "O"), (2, 3, 1, 9, "goal", "HOM", "O")],
        "gameid long, event_id long, period int, elapsed long, type string, owner string, zone string",
    )
    prior = spark.createDataFrame([(1, "X", 0.25, -0.5)], "gameid long, home string, delta_pythagorean double, delta_shot_share double")
    for focal, s in (("HOM", 1), ("AWY", -1)):
        rows = {r["event_id"]: r for r in Q.master_table(plays, prior, focal, home="HOM").collect()}
        assert [rows[k]["delta_pythagorean"] for k in (1, 2, 3)] == [s * 0.25, s * 0.25, 0.0]
        assert rows[2]["delta_shot_share"] == s * -0.5 and rows[1]["is_home"] == float(s > 0)
        assert rows[2]["zone_entry"] == float(focal == "AWY")


def test_bootstrap_weights_draw_every_time(events):
    w = Z.bootstrap_weights(events.select("gameid").distinct(), 5).toPandas()
    assert np.allclose(np.stack(w["weights"].to_numpy()).sum(axis=0), len(w))


def test_logits_of_many_sets_end_at_a_zero_gradient(spark):
    rng = np.random.default_rng(11)
    n = 3000
    x = rng.normal(size=(n, 4)) * [1, 100, 0.01, 1]
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["win"] = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.5, 0.01, 30, 0])))).astype(int)
    pdf["apart"] = np.where(pdf.win == 1, 1.0, -1.0) * rng.uniform(1, 2, n)
    pdf.loc[::50, "d"] = np.nan
    sets = {"one": ("a",), "scales": ("a", "b", "c"), "gaps": ("d", "a"), "apart": ("apart",)}
    fits = E.fit_logits(spark.createDataFrame(pdf).repartition(3), "win", sets)
    assert [f.converged for f in fits.values()] == [True, True, True, False]
    for name in ("one", "scales", "gaps"):
        own = pdf[list(sets[name])].fillna(0).to_numpy()
        p = 1 / (1 + np.exp(-own @ fits[name].theta))
        scale = np.abs(own).max(axis=0)
        assert np.abs(own.T @ (p - pdf.win) / n / scale).max() < 1e-6
        assert fits[name].loss == pytest.approx(-np.mean(np.where(pdf.win == 1, np.log(p), np.log(1 - p))), abs=1e-8)
    report = E.win_predictors(spark.createDataFrame(pdf), "win", {k: sets[k] for k in ("one", "scales")}).toPandas()
    p = pdf[list("abc")].to_numpy() @ fits["scales"].theta >= 0
    row = report[(report.features == "scales") & (report["class"] == "win")].iloc[0]
    assert row.precision == pytest.approx(round((p & (pdf.win == 1)).sum() / p.sum(), 3)) and row.support == pdf.win.sum() and row.converged
    assert len(E.KPI_SETS) >= 10


def test_rounds_of_expanding_logit_do_not_follow_the_points(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    n = 1500
    f1 = rnd.normal(size=n)
    pdf = pd.DataFrame({"day": np.arange(n) // 3, "f1": f1, "outcome": (rnd.random(n) < 1 / (1 + np.exp(-f1))).astype(int)})
    rounds, newton = [], R._newton
    monkeypatch.setattr(R, "_newton", lambda *a: rounds.append(len(a[3])) or newton(*a))
    monkeypatch.setattr(R, "SPAN_GROWTH", 2.0)
    monkeypatch.setattr(R, "SPAN_SQUARE", 1.0)
    got = R.expanding_logit(spark.createDataFrame(pdf), ["f1"], "outcome", block="day").toPandas()
    # one point a span and round before: as many rounds as the points of the longest span
    assert len(rounds) <= 9 < sum(rounds) and got[got["day"] > 20]["converged"].all()


def test_logit_steps_read_packed_rows(spark, monkeypatch):
    """F8: each Newton step converted every feature column again."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-x @ [1.0, -0.5]))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]}))
    read, plain = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: (read.append(self.columns), plain(self, *a, **k))[1])
    f = E.fit_logits(df, "y", {"both": ["a", "b"], "one": ["a"]})
    assert read[0] == ["label", "a", "b"] and len(read) > 2 and all(c == ["n", "data"] for c in read[1:])
    for k, cols in (("both", [0, 1]), ("one", [0])):
        p = 1 / (1 + np.exp(-x[:, cols] @ f[k].theta))
        assert f[k].converged and np.abs(x[:, cols].T @ (p - y)).max() / 500 < 1e-4


def test_logit_steps_read_small_batches_and_keep_no_rows_in_memory(spark, monkeypatch):
    """a task's packed rows went to Python up to 64 MB at once, and executors' memory held the rows twice."""
    names = [f"f{i}" for i in range(24)]
    df = spark.range(0, 50_000, 1, 1).select(
        (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("win"), *[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / 1000).alias(n) for n in names]
    )
    plain, kept = type(df).mapInPandas, []

    def watched(self, run, schema):
        if self.columns != ["n", "data"]:
            return plain(self, run, schema)
        kept.append(self.storageLevel.useMemory)

        def checked(batches):
            for pdf in batches:
                assert sum(map(len, pdf["data"])) < 8e6
                yield pdf

        return plain(self, lambda batches: run(checked(batches)), schema)

    monkeypatch.setattr(type(df), "mapInPandas", watched)
    size, most = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(size, None), spark.conf.get(most)
    spark.conf.set(most, "10000")
    try:
        report = E.win_predictors(df, "win", {"all": names, "one": names[:1]}, steps=2).toPandas()
    finally:
        spark.conf.set(most, rows)
    assert len(kept) == 3 and not any(kept) and spark.conf.get(size, None) == before
    wins = df.filter("win = 1").count()
    assert set(report[report["class"] == "win"]["support"]) == {wins} and set(report[report["class"] == "loss"]["support"]) == {50_000 - wins}


def test_reports_of_win_predictors_count_gaps_as_zero_and_leave_out_rows_without_result(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, -2.0, 3.0), (0, -1.0, 1.0), (0, None, -1.0), (None, 4.0, 4.0), (1, float("nan"), 2.0)], "win int, a double, b double")
    report = E.win_predictors(df, "win", {"a": ("a",), "b": ("b",)}, steps=0).toPandas()
    # without a step all coefficients are 0, so every row is called a win, also that of a value that isn't a number
    for r in report.itertuples():
        assert (r.support, r.precision, r.recall) == ((3, 0.6, 1.0) if getattr(r, "_2") == "win" else (2, 0.0, 0.0))
