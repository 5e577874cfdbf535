"""Team indicators from box scores.

A box row is (gameid, season, game_date, team, side, goals, shots, blocked,
missed, win, game_end); two rows per game. All windows run per team and season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from icestats.plans.lineage import materialise, small_stage
from icestats.plans.slicing import context, running_total

TEAM_KEYS = ("season", "team")
TEAM_ORDER = ("game_date", "gameid")
BOX_MEASURES = ("goals", "shots", "blocked", "missed", "win")

# Line fitted on the 2010-2020 seasons, games per season
FIT_SLOPE, FIT_INTERCEPT, SEASON_GAMES = 0.809623, 0.042901, 82
# Weights of own, opponents' and third record
RPI_WEIGHTS = (0.25, 0.5, 0.25)


def to_team_rows(games: DataFrame) -> DataFrame:
    """One game row → one row per side with the opponent's columns; no shuffle."""
    stats = ("goals", "shots", "blocked", "missed")

    def side(own: str, opp: str) -> Column:
        won = F.col(f"{own}_goals") > F.col(f"{opp}_goals")
        if own == "home":
            won = won | (F.col("home_goals") == F.col("away_goals"))
        return F.struct(
            F.col(own).alias("team"),
            F.lit(own).alias("side"),
            F.col(opp).alias("opponent"),
            *[F.col(f"{own}_{s}").alias(s) for s in stats],
            *[F.col(f"{opp}_{s}").alias(f"{s}_against") for s in stats],
            won.cast("bigint").alias("win"),
        )

    return games.select(
        "gameid", "season", "game_date", "game_end",
        F.inline(F.array(side("home", "away"), side("away", "home"))),
    )


def pair_opponent(box: DataFrame) -> DataFrame:
    """Give each box row the other row of its game (`*_against`), one shuffle, no join."""
    w = W.partitionBy("gameid").orderBy("side")
    row = F.struct(F.col("team").alias("t"), *[F.col(m).alias(m) for m in BOX_MEASURES])
    other = F.coalesce(F.lead(row).over(w), F.lag(row).over(w))
    out = box.withColumn("_o", other)
    return out.withColumns(
        {"opponent": F.col("_o.t"), **{f"{m}_against": F.col(f"_o.{m}") for m in BOX_MEASURES}}
    ).drop("_o")


def opponent_join(box: DataFrame) -> DataFrame:
    """Same pairing as an equi-join on the game with the self match dropped."""
    b = box.select(
        F.col("gameid").alias("_g"), F.col("team").alias("opponent"),
        *[F.col(m).alias(f"{m}_against") for m in BOX_MEASURES],
    )
    return box.join(b, (F.col("gameid") == F.col("_g")) & (F.col("team") != F.col("opponent")), "left").drop("_g")


def rest_days(paired: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Previous and next game of the team and the days between."""
    out = context(paired, TEAM_KEYS, TEAM_ORDER, previous={"prev_gameid": "gameid", "prev_date": "game_date"}, following={"next_gameid": "gameid"}, slice_by=slice_by)
    return out.withColumn("rest_days", F.date_diff("game_date", "prev_date")).drop("prev_date")


def shot_levels(paired: DataFrame, include_missed: bool = False) -> DataFrame:
    """Fenwick and Corsi: difference to the opponent and share of both."""
    def fenwick(sfx: str) -> Column:
        return F.col(f"shots{sfx}") + (F.col(f"missed{sfx}") if include_missed else F.lit(0))

    f_own, f_opp = fenwick(""), fenwick("_against")
    c_own, c_opp = f_own + F.col("blocked"), f_opp + F.col("blocked_against")
    return paired.withColumns(
        {
            "fenwick_lvl": f_own - f_opp, "fenwick_pct": F.try_divide(f_own, f_own + f_opp),
            "corsi_lvl": c_own - c_opp, "corsi_pct": F.try_divide(c_own, c_own + c_opp),
        }
    )


def pythagorean(gf: Column, ga: Column, gamma: float = 2.0) -> Column:
    """Expected win share from goals for and against; 0/0 gives null."""
    a, b = F.pow(gf.cast("double"), F.lit(gamma)), F.pow(ga.cast("double"), F.lit(gamma))
    return F.try_divide(a, a + b)


def running_metrics(paired: DataFrame, slice_by: Column | str | None = None, gamma: float = 2.0) -> DataFrame:
    """Running totals per team and season incl. the current game, with the expectation."""
    measures = {
        "rgame": F.lit(1), "rwin": "win", "rgf": "goals", "rga": "goals_against",
        "rsf": "shots", "rsa": "shots_against", "rbf": "blocked", "rba": "blocked_against",
    }
    out = running_total(paired, TEAM_KEYS, TEAM_ORDER, measures, slice_by=slice_by)
    return out.withColumns({c: F.col(c).cast("bigint") for c in measures}).withColumn(
        "rpe", pythagorean(F.col("rgf"), F.col("rga"), gamma)
    )


def trailing_expectation(metrics: DataFrame, games: int = 10) -> DataFrame:
    """Expectation over the last `games` games; null until that many are complete.

    The totals `games` earlier are found by game number, so the join spreads evenly.
    """
    past = metrics.select("season", "team", (F.col("rgame") + games).alias("rgame"), F.col("rgf").alias("_f"), F.col("rga").alias("_a"))
    out = metrics.join(past, ["season", "team", "rgame"], "left")
    return out.withColumn(f"rpe_{games}", pythagorean(F.col("rgf") - F.col("_f"), F.col("rga") - F.col("_a"))).drop("_f", "_a")


def attach_opponent_running(metrics: DataFrame) -> DataFrame:
    """Opponent's own running record of the same game (`*_oppo`), no join."""
    w = W.partitionBy("gameid").orderBy("side")
    row = F.struct("rgame", "rwin", "rpe")
    return metrics.withColumn("_o", F.coalesce(F.lead(row).over(w), F.lag(row).over(w))).withColumns(
        {"rgame_oppo": F.col("_o.rgame"), "rwin_oppo": F.col("_o.rwin"), "rpe_oppo": F.col("_o.rpe")}
    ).drop("_o")


def season_totals(metrics: DataFrame) -> DataFrame:
    """Team-season sums of levels and the last running values in date order."""
    last = F.max_by(F.struct("rpe", "rwin", "rgame"), F.struct(*TEAM_ORDER))
    return (
        metrics.groupBy(*TEAM_KEYS)
        .agg(F.sum("fenwick_lvl").alias("fenwick_lvl"), F.sum("corsi_lvl").alias("corsi_lvl"), last.alias("_l"))
        .select(*TEAM_KEYS, "fenwick_lvl", "corsi_lvl", "_l.*")
        .withColumn("wp", F.try_divide(F.col("rwin"), F.col("rgame")))
    )


def min_max(c: str, over: W, constant: float | None = None) -> Column:
    """Scale to [0, 1] within the window; a constant column gives `constant`."""
    lo, hi = F.min(c).over(over), F.max(c).over(over)
    return F.coalesce(F.try_divide(F.col(c).cast("double") - lo, (hi - lo).cast("double")), F.lit(constant).cast("double"))


def normalise(table: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ("season",)) -> DataFrame:
    """Add `{out: min-max of column}` within each season (one row per team)."""
    w = W.partitionBy(*keys)
    return table.withColumns({o: min_max(c, w) for o, c in columns.items()})


def fitted_wins(pe: Column) -> Column:
    return (pe * F.lit(FIT_SLOPE) + F.lit(FIT_INTERCEPT)) * F.lit(SEASON_GAMES)


def head_to_head(paired: DataFrame) -> DataFrame:
    """Edge list team → opponent with games, wins, goals and shots."""
    return paired.groupBy("season", "team", "opponent").agg(
        F.count("win").alias("games"), F.sum("win").alias("wins"), F.sum("goals").alias("goals"),
        F.sum("goals_against").alias("goals_against"), F.sum("shots").alias("shots"),
    )


def head_to_head_totals(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Edges with the season totals of both ends."""
    tot = metrics.groupBy("season", "team").agg(F.max("rgame").alias("n"), F.max("rwin").alias("w"))
    own = tot.select("season", "team", F.col("n").alias("team_games"), F.col("w").alias("team_wins"))
    opp = tot.select("season", F.col("team").alias("opponent"), F.col("n").alias("opponent_games"), F.col("w").alias("opponent_wins"))
    return edges.join(own, ["season", "team"]).join(opp, ["season", "opponent"])


def common_opponents(edges: DataFrame) -> DataFrame:
    """For every pair (team, rival) that met: both records against each opponent both met.

    Edges are already one row per pair of teams, so the join works on the league's
    team graph, not on games. A common opponent is never one of the two teams.
    """
    a = edges.select("season", "team", F.col("opponent").alias("rival"))
    b = edges.select("season", "team", F.col("opponent").alias("common"), F.col("games").alias("games_own"), F.col("wins").alias("wins_own"))
    c = edges.select(
        "season", F.col("team").alias("rival"), F.col("opponent").alias("common"),
        F.col("games").alias("games_rival"), F.col("wins").alias("wins_rival"),
    )
    return a.join(b, ["season", "team"]).join(c, ["season", "rival", "common"])


def pairwise_wins(common: DataFrame, edges: DataFrame) -> DataFrame:
    """Rivals against whom the team has the strictly better record with common opponents."""
    ratio = common.groupBy("season", "team", "rival").agg(
        F.try_divide(F.sum("wins_own"), F.sum("games_own")).alias("own"),
        F.try_divide(F.sum("wins_rival"), F.sum("games_rival")).alias("riv"),
    )
    won = ratio.groupBy("season", "team").agg(F.sum((F.col("own") > F.col("riv")).cast("bigint")).alias("pairwise_win"))
    teams = edges.select("season", "team").distinct()
    return teams.join(won, ["season", "team"], "left").fillna(0, ["pairwise_win"])


def opponent_record(with_oppo: DataFrame) -> DataFrame:
    """Opponents' record as of the last meeting, summed over opponents."""
    last = F.max_by(F.struct("rwin_oppo", "rgame_oppo"), F.struct(*TEAM_ORDER))
    per = with_oppo.groupBy("season", "team", "opponent").agg(last.alias("l"))
    return per.groupBy("season", "team").agg(
        F.try_divide(F.sum("l.rwin_oppo"), F.sum("l.rgame_oppo")).alias("wp_ow")
    )


def rating_percentage_index(totals: DataFrame, ow: DataFrame, common: DataFrame) -> DataFrame:
    """RPI whose third term is the own record over common opponents."""
    third = common.groupBy("season", "team").agg(
        F.try_divide(F.sum("wins_own"), F.sum("games_own")).alias("wp_oow")
    )
    a, b, c = RPI_WEIGHTS
    return (
        totals.select("season", "team", F.col("wp").alias("wp_own"))
        .join(ow, ["season", "team"], "left")
        .join(third, ["season", "team"], "left")
        .fillna(0.0, ["wp_ow", "wp_oow"])
        .withColumn("rpi", F.col("wp_own") * a + F.col("wp_ow") * b + F.col("wp_oow") * c)
    )


def rpi_schedule(edges: DataFrame) -> DataFrame:
    """RPI with the mean of opponents' and of opponents' opponents' win share.

    Each game counts once; the opponents' opponents leave the team itself out.
    With sums over edges, "without self" is the opponent's total minus one edge.
    """
    own = edges.groupBy("season", "team").agg((F.sum("wins") / F.sum("games")).alias("wp"))
    opp = own.select("season", F.col("team").alias("opponent"), F.col("wp").alias("wp_opp"))
    e = edges.join(opp, ["season", "opponent"])
    sums = e.groupBy("season", "team").agg(
        F.sum(F.col("games") * F.col("wp_opp")).alias("s"), F.sum("games").alias("n")
    )
    back = sums.select("season", F.col("team").alias("opponent"), F.col("s").alias("s_opp"), F.col("n").alias("n_opp"))
    own2 = own.select("season", "team", F.col("wp").alias("wp_own"))
    rows = e.join(back, ["season", "opponent"]).join(own2, ["season", "team"])
    oo = F.try_divide(F.col("s_opp") - F.col("games") * F.col("wp_own"), F.col("n_opp") - F.col("games"))
    a, b, c = RPI_WEIGHTS
    return (
        rows.withColumn("_oo", oo)
        .groupBy("season", "team")
        .agg(
            F.max("wp_own").alias("wp_own"),
            (F.sum(F.col("games") * F.col("wp_opp")) / F.sum("games")).alias("wp_ow"),
            F.try_divide(F.sum(F.col("games") * F.col("_oo")), F.sum(F.when(F.col("_oo").isNotNull(), F.col("games")))).alias("wp_oow"),
        )
        .withColumn("rpi", F.col("wp_own") * a + F.col("wp_ow") * b + F.coalesce(F.col("wp_oow"), F.lit(0.0)) * c)
    )


#: Game numbers of a team's season that meet in one group of rows.
STREAK_RUN = 1_000


def streak_flags(paired: DataFrame, table: DataFrame) -> DataFrame:
    """Three wins in a row; of these, expected (two or more against teams of lower RPI)
    and hot (one or more against the top quarter of opponents met).

    The quarter is taken over game rows, so each team's RPI weighs by its meetings; the
    weights are counted per opponent before the quantile. Rows carry the game number `rgame`.
    """
    rpi = table.select("season", "team", "rpi")
    run = lambda n: F.floor(F.coalesce(n, F.lit(0)) / F.lit(STREAK_RUN))
    against = rpi.select("season", F.col("team").alias("opponent"), F.col("rpi").alias("rpi_against"))
    met = paired.groupBy("season", "opponent").agg(F.count(F.lit(1)).alias("n")).join(against, ["season", "opponent"])
    # one row per team by now, so the built-in percentile with counts holds a league at most
    cut = met.groupBy("season").agg(F.percentile("rpi_against", 0.75, F.col("n")).alias("q75"))
    bars = small_stage(rpi.join(cut, "season"), "bars")
    rows = (
        paired.select("season", "team", "opponent", "game_date", "gameid", "rgame", "win")
        .join(bars, ["season", "team"]).join(against, ["season", "opponent"])
    )
    marks = rows.select(
        "season", "team", "gameid", "game_date", "rgame", "win",
        (F.col("win") * (F.col("rpi_against") > F.col("q75")).cast("bigint")).alias("hot"),
        (F.col("win") * (F.col("rpi_against") < F.col("rpi")).cast("bigint")).alias("expected"),
    )
    # each game counts for itself and the next two: one aggregation by game number, no window. A team's
    # season is dealt out in runs of game numbers; the last two games of a run go to the next one as well
    dealt = marks.withColumn("_run", F.explode(F.sequence(run(F.col("rgame")), run(F.col("rgame") + 2)))).repartition("season", "team", "_run")
    spread = dealt.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter(run(F.col("rgame") + F.col("_to")) == F.col("_run"))
    own = F.col("_to") == 0
    g = spread.groupBy("season", "team", "_run", (F.col("rgame") + F.col("_to")).alias("_g")).agg(
        F.max(F.when(own, F.col("gameid"))).alias("gameid"), F.max(F.when(own, F.col("game_date"))).alias("game_date"),
        *[F.sum(c).alias(c) for c in ("win", "hot", "expected")],
    )
    streak = F.col("win") == 3
    return g.filter(F.col("gameid").isNotNull()).select(
        "season", "team", "gameid", "game_date",
        streak.cast("bigint").alias("win_streak"),
        (streak & (F.col("expected") >= 2)).cast("bigint").alias("win_streak_expected"),
        (streak & (F.col("hot") >= 1)).cast("bigint").alias("hot_streak"),
    )


def streak_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("season", "team").agg(
        *[F.sum(c).alias(c) for c in ("win_streak", "win_streak_expected", "hot_streak")]
    ).withColumn("hot_share", F.try_divide(F.col("hot_streak"), F.col("win_streak"))).withColumn(
        "hot_label", F.concat(F.floor(F.col("hot_share") * 100).cast("string"), F.lit("%"))
    )


def game_metrics(games: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Levels and running records of both sides of every game, two rows per game, written once.

    The team rows are written too, as slicing reads them twice and they come from joins.
    """
    rows = materialise(shot_levels(to_team_rows(games)), "rows")
    return materialise(attach_opponent_running(running_metrics(rows, slice_by)), "metrics")


def season_edges(rows: DataFrame) -> DataFrame:
    """One row per season, team and opponent with all sums that season tables need; where `rows` carry
    the opponents' running record, also that of the last meeting."""
    sums = ("win", "goals", "goals_against", "shots", "fenwick_lvl", "corsi_lvl")
    met = [F.max_by(F.struct("rwin_oppo", "rgame_oppo"), F.struct(*TEAM_ORDER)).alias("met")] if "rwin_oppo" in rows.columns else []
    return rows.groupBy("season", "team", "opponent").agg(
        F.count("win").alias("games"), *[F.sum(c).alias("wins" if c == "win" else c) for c in sums], *met
    )


def totals_of(edges: DataFrame) -> DataFrame:
    """Team-season totals from `season_edges`: the last running values are the season's sums."""
    out = edges.groupBy("season", "team").agg(
        *[F.sum(c).alias(c) for c in ("fenwick_lvl", "corsi_lvl", "goals", "goals_against")], F.sum("wins").alias("rwin"), F.sum("games").alias("rgame")
    )
    out = out.withColumns({"rpe": pythagorean(F.col("goals"), F.col("goals_against")), "wp": F.try_divide(F.col("rwin"), F.col("rgame"))})
    return out.select("season", "team", "fenwick_lvl", "corsi_lvl", "rpe", "rwin", "rgame", "wp")


def rated(edges: DataFrame) -> DataFrame:
    """Totals, RPI and pairwise wins of every team from `season_edges` with records."""
    common = common_opponents(edges)
    totals = totals_of(edges)
    record = edges.groupBy("season", "team").agg(F.try_divide(F.sum("met.rwin_oppo"), F.sum("met.rgame_oppo")).alias("wp_ow"))
    rpi = rating_percentage_index(totals, record, common)
    return totals.join(rpi, ["season", "team"]).join(pairwise_wins(common, edges), ["season", "team"])


KPI = {"kpi_corsi": "corsi_lvl", "kpi_fenwick": "fenwick_lvl", "kpi_pe": "rpe", "kpi_pairwise": "pairwise_win", "kpi_rpi": "rpi", "kpi_wp": "wp"}


def with_indicators(table: DataFrame) -> DataFrame:
    """Fitted wins, final position and the normalised form of those indicators that `table` has."""
    w = W.partitionBy("season").orderBy("rwin", "fenwick_lvl", "corsi_lvl", "team")
    n = F.count(F.lit(1)).over(W.partitionBy("season"))
    out = table.withColumn("fitted_wins", fitted_wins(F.col("rpe"))).withColumn(
        "final_position", F.try_divide((F.row_number().over(w) - 1).cast("double"), (n - 1).cast("double"))
    )
    return normalise(out, {k: c for k, c in KPI.items() if c in table.columns})


def team_season(games: DataFrame, slice_by: Column | str | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """The whole team-season table: levels, expectation, RPI, pairwise, normalised, streaks.

    `metrics` (by default `game_metrics`) are read twice: for one small table of team pairs, from
    which everything but the streaks follows, and for the streaks. Whoever needs them as
    well passes them in. The small tables are written, as many branches read them.
    """
    metrics = game_metrics(games, slice_by) if metrics is None else metrics
    table = materialise(rated(materialise(season_edges(metrics), "edges")), "teams")
    streaks = streak_summary(streak_flags(metrics, table)).drop("hot_share", "hot_label")
    return with_indicators(table).join(streaks, ["season", "team"])


SEASON_INDICATORS = ("kpi_wp", "kpi_pe", "rpi", "pairwise_win")
RUNNING_INDICATORS = ("rpe", "rpe_10", "rwp", "rff_pct", "rcf_pct")


def game_indicators(metrics: DataFrame, table: DataFrame) -> DataFrame:
    """One row per game from the home side: its result, the season's indicators of both sides
    (`*_against` the visitor's), the game's attempts, and both sides' running indicators.
    """
    pct = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    table = small_stage(table.select("season", "team", *SEASON_INDICATORS), "season")
    rows = trailing_expectation(metrics).withColumns({
        "rwp": F.try_divide(F.col("rwin").cast("double"), F.col("rgame").cast("double")), "rff_pct": pct("rsf", "rsa"),
        "_cf": F.col("rsf") + F.col("rbf"), "_ca": F.col("rsa") + F.col("rba"),
        "corsi": F.col("shots") + F.col("blocked"), "corsi_against": F.col("shots_against") + F.col("blocked_against"),
    }).withColumn("rcf_pct", pct("_cf", "_ca"))
    w = W.partitionBy("gameid").orderBy("side")
    other = F.struct(*RUNNING_INDICATORS)
    rows = rows.withColumn("_o", F.coalesce(F.lead(other).over(w), F.lag(other).over(w))).filter(F.col("side") == "home")
    season = lambda team, end: table.select("season", F.col("team").alias(team), *[F.col(c).alias(f"{c}{end}") for c in SEASON_INDICATORS])
    out = rows.join(season("team", ""), ["season", "team"]).join(season("opponent", "_against"), ["season", "opponent"])
    cut = table.groupBy("season").agg(F.percentile("rpi", 0.75).alias("_q75"))
    return out.join(cut, "season").select(
        "gameid", "season", "game_date", "team", "opponent", "win", "rgame", F.col("shots").alias("fenwick"), F.col("shots_against").alias("fenwick_against"), "fenwick_lvl",
        "corsi", "corsi_against", "corsi_lvl", *SEASON_INDICATORS, *[f"{c}_against" for c in SEASON_INDICATORS], (F.col("kpi_wp") - F.col("kpi_wp_against")).alias("kpi_wp_diff"),
        (F.col("rpi_against") > F.col("_q75")).cast("int").alias("opponent_good"), (F.col("rpi_against") > F.col("rpi")).cast("int").alias("opponent_better"),
        *RUNNING_INDICATORS, *[F.col(f"_o.{c}").alias(f"{c}_against") for c in RUNNING_INDICATORS],
    )


def standings(games: DataFrame) -> DataFrame:
    """League standings: wins, regulation and overtime losses, points."""
    rows = to_team_rows(games)
    extra = F.col("game_end").isin("OT", "SO")
    lost = F.col("win") == 0
    return (
        rows.groupBy("season", "team")
        .agg(
            F.sum("win").alias("w"), F.sum((lost & ~extra).cast("bigint")).alias("l"),
            F.sum((lost & extra).cast("bigint")).alias("otl"),
        )
        .withColumn("pts", F.col("w") * 2 + F.col("otl"))
        .withColumn("gp", F.col("w") + F.col("l") + F.col("otl"))
    )


def prior_metrics(paired: DataFrame, slice_by: Column | str | None = None) -> DataFrame:
    """Share of goals, Corsi and Fenwick over earlier games only; 0.5 where nothing came before."""
    m = {
        "p_games": F.lit(1), "p_gf": "goals", "p_ga": "goals_against",
        "p_ff": "shots", "p_fa": "shots_against",
        "p_cf": F.col("shots") + F.col("blocked"), "p_ca": F.col("shots_against") + F.col("blocked_against"),
    }
    out = running_total(paired, TEAM_KEYS, TEAM_ORDER, m, include_current=False, slice_by=slice_by)
    half = F.lit(0.5)
    return out.withColumns({c: F.col(c).cast("bigint") for c in m}).withColumns(
        {
            "cf_pct": F.coalesce(F.try_divide(F.col("p_cf"), F.col("p_cf") + F.col("p_ca")), half),
            "ff_pct": F.coalesce(F.try_divide(F.col("p_ff"), F.col("p_ff") + F.col("p_fa")), half),
            "pythagorean": F.coalesce(pythagorean(F.col("p_gf"), F.col("p_ga")), half),
        }
    )


def local_priors(prior: DataFrame) -> DataFrame:
    """Home-side prior per game with `delta = v - (1 - v)`."""
    share = F.coalesce(F.try_divide(F.col("p_ff"), F.col("p_ff") + F.col("p_fa")), F.lit(0.5))
    return prior.filter(F.col("side") == "home").select(
        "gameid", F.col("team").alias("home"), "pythagorean", share.alias("shot_share"),
        (F.col("pythagorean") * 2 - 1).alias("delta_pythagorean"), (share * 2 - 1).alias("delta_shot_share"),
    )


def champion_label(totals: DataFrame, playoffs: DataFrame) -> DataFrame:
    """Label of a team's season from its playoff rows (season, team, win).

    The champion has most playoff wins (the first name at a tie), the others with a playoff
    row lost, a team without one missed the playoffs.
    """
    wins = playoffs.groupBy("season", "team").agg(F.sum("win").alias("_wins"))
    best = wins.groupBy("season").agg(F.min_by("team", F.struct(-F.col("_wins"), F.col("team"))).alias("_best"))
    label = F.when(F.col("_wins").isNull(), "missed").when(F.col("team") == F.col("_best"), "champion").otherwise("lost")
    return totals.join(wins, ["season", "team"], "left").join(best, "season", "left").withColumn("label", label).drop("_wins", "_best")


def measures_long(table: DataFrame, columns: list[str]) -> DataFrame:
    """Team × measure in long form."""
    return table.select("season", "team", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["season", "team"], columns, "measure", "value"
    )


def correlation_pairs(table: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Pearson correlation of every pair of measures as rows (one aggregation)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = table.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.unpivot(keys, [f"{a}|{b}" for a, b in pairs], "pair", "corr")
