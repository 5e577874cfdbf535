"""Sequential ratings and forecasts.

The plain Elo update depends on the two current ratings, so a league is read in
game order. Pieces of it are sorted side by side and packed to a few bytes a game, and one
task streams through these: the state is one number per team and parameter cell, never the
games. Leagues (and seasons, when ratings start anew each season) are separate and run in parallel. The variant whose
expected score comes from the market is a prefix sum and needs no sequence at all.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icestats.operators.momentum import _segments
from icestats.plans.lineage import materialise
from icestats.plans.slicing import _with_headers, global_index, running_total

START = 1500.0
# Grid of update factors and home advantages, share of games not scored
GRID_K = tuple(range(4, 34, 4))
GRID_HFA = tuple(range(10, 55, 5))
BURN_IN = 0.25


def win_chance(diff: Column) -> Column:
    return F.lit(1.0) / (1 + F.pow(F.lit(10.0), -diff / F.lit(400.0)))


def advantage_bump(hfa: Column) -> Column:
    """Home advantage in rating points as added win probability between equals."""
    return win_chance(hfa) - F.lit(0.5)


#: Games that a piece of a league is meant to hold, and the most pieces.
PIECE_GAMES, MOST_PIECES = 20_000, 200
#: Columns of packed games.
PACKED = ("teams", "sides", "scores", "outcomes", "seasons", "runs")


def _pieces(games: DataFrame, first: str) -> tuple[DataFrame, int]:
    """Add `_piece`: consecutive ranges of the order's first column of about equal size; and their number.

    The borders are collected, a number per piece, so that every pass cuts alike. Null comes first.
    """
    kind = games.schema[first].dataType
    at = F.unix_micros(F.col(first).cast("timestamp")) if isinstance(kind, (T.DateType, T.TimestampType)) else F.col(first)
    if not isinstance(kind, (T.DateType, T.TimestampType, T.NumericType)):
        return games.withColumn("_piece", F.lit(0)), 1
    shares = [i / MOST_PIECES for i in range(1, MOST_PIECES)]
    n, edges = games.agg(F.count(F.lit(1)), F.percentile_approx(at.cast("double"), shares, 100 * MOST_PIECES)).first()
    pieces = min(MOST_PIECES, -(-n // PIECE_GAMES))
    kept = sorted({edges[i * MOST_PIECES // pieces - 1] for i in range(1, pieces)}) if edges else []
    if not kept:
        return games.withColumn("_piece", F.lit(0)), 1

    def place(low: int, high: int) -> Column:
        """The number of borders that are not above the value, which is `low` to `high`."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at.cast("double") >= kept[middle], place(middle + 1, high)).otherwise(place(low, middle))

    return games.withColumn("_piece", place(0, len(kept))), pieces


def _coded(values: np.ndarray) -> tuple[list, np.ndarray]:
    """Distinct values (missing ones as None) and the place of each value among them, in as few bytes as do."""
    places, distinct = pd.factorize(values, use_na_sentinel=False)
    return [None if pd.isna(v) else v for v in distinct], places.astype(np.min_scalar_type(max(len(distinct) - 1, 0)))


def _packed(games: DataFrame, keys: Sequence[str], order: Sequence[str], home: str, away: str, outcome: str, season: str | None, pieces: int) -> DataFrame:
    """Games in order as rows of packed numbers, a few bytes a game; pieces are sorted side by side.

    (keys, _piece, _chunk, teams, sides, scores, outcomes, seasons, runs): `sides` holds the places of
    the home and away teams, `outcomes` those of the scores, `runs` the games of each season in a row.
    """
    years = [season] if season else []
    rows = games.select(*keys, "_piece", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(home).alias("_home"), F.col(away).alias("_away"), F.col(outcome).cast("double").alias("_y"), *[F.col(c).alias("_s") for c in years])
    by = [*keys, "_piece"]
    rows = rows.repartition(pieces, *by).sortWithinPartitions(*by, *[f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])
    number = bool(season) and isinstance(games.schema[season].dataType, T.NumericType)
    schema = T.StructType([rows.schema[k] for k in by] + [T.StructField(n, t) for n, t in (
        ("_chunk", T.LongType()), ("teams", T.ArrayType(games.schema[home].dataType)), ("sides", T.BinaryType()), ("scores", T.ArrayType(T.DoubleType())),
        ("outcomes", T.BinaryType()), ("seasons", T.ArrayType(T.DoubleType() if number or not season else games.schema[season].dataType)), ("runs", T.BinaryType()))])
    coded, segments = _coded, _segments

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = 0
        for pdf in batches:
            made = []
            for i, m in zip(*segments(pdf, by)):
                one = pdf.iloc[i : i + m]
                teams, sides = coded(np.concatenate([one["_home"].to_numpy(object), one["_away"].to_numpy(object)]))
                scores, outcomes = coded(one["_y"].to_numpy(float))
                at, runs = segments(one, ["_s"]) if season else (np.zeros(1, int), np.array([m]))
                seasons = [None if pd.isna(v) else v for v in one["_s"].to_numpy()[at]] if season else [0.0]
                made.append((*(one[k].iloc[0] for k in by), chunk, teams, sides.tobytes(), scores, outcomes.tobytes(), [float(v) if number and v is not None else v for v in seasons], runs.astype("i4").tobytes()))
                chunk += 1
            if made:
                yield pd.DataFrame(made, columns=schema.names)

    return rows.mapInPandas(run, schema)


def _unpacked(row, number: bool = True):
    """Teams, places of home and away, outcomes and (season, games) runs of a packed row."""
    sides = np.frombuffer(row.sides, np.min_scalar_type(max(len(row.teams) - 1, 0))).reshape(2, -1).tolist()
    y = np.array([np.nan if v is None else v for v in row.scores], float)[np.frombuffer(row.outcomes, np.min_scalar_type(max(len(row.scores) - 1, 0)))].tolist()
    seasons = [math.nan if v is None and number else v for v in row.seasons]
    return list(row.teams), *sides, y, list(zip(seasons, np.frombuffer(row.runs, "i4").tolist()))


def _in_order(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return packed.repartition(*keys).sortWithinPartitions(*keys, "_piece", "_chunk")


def elo(
    games: DataFrame,
    *,
    league: Sequence[str],
    order: Sequence[str] = ("game_date", "gameid"),
    home: str = "home",
    away: str = "away",
    outcome: str = "outcome",
    season: str = "season",
    k: float = 10.0,
    hfa: float = 25.0,
    carry: float = 1.0,
) -> DataFrame:
    """Forecast `p_elo` and both ratings before each game.

    `carry` is the part of the distance to 1500 kept at a season change; 0 makes the
    seasons independent and lets them run in parallel. `outcome` may be 0.5.

    One task a league steps through packed games and leaves the ratings with which each piece
    starts; the pieces then run side by side. The games are written once as a stage.
    """
    keys = list(league) + ([season] if carry == 0 else [])
    schema = T.StructType(
        games.schema.fields + [T.StructField(n, T.DoubleType()) for n in ("r_home", "r_away", "p_elo")]
    )
    rows, pieces = _pieces(materialise(games, "elo"), order[0])
    number = isinstance(games.schema[season].dataType, T.NumericType)
    unpacked = _unpacked
    packed = _in_order(_packed(rows, keys, order, home, away, outcome, season, pieces), keys)
    start_schema = T.StructType([packed.schema[c] for c in (*keys, "_piece")] + [T.StructField("_state", T.BinaryType())])

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, year, ratings, at = None, None, {}, None
        for pdf in batches:
            made = []
            for key, piece, row in zip(zip(*[pdf[c].tolist() for c in keys]), pdf["_piece"].tolist(), pdf[list(PACKED)].itertuples(index=False)):
                teams, hs, zs, ys, seasons = unpacked(row, number)
                if key != current:
                    current, year, ratings, at = key, seasons[0][0], {}, piece
                elif piece != at:
                    at = piece
                    made.append((*key, at, pickle.dumps((year, ratings))))
                i = 0
                for yr, m in seasons:
                    if yr != year:
                        year = yr
                        if carry != 1.0:
                            ratings = {t: START + carry * (v - START) for t, v in ratings.items()}
                    for h, a, y in zip(hs[i : i + m], zs[i : i + m], ys[i : i + m]):
                        h, a = teams[h], teams[a]
                        x, z = ratings.get(h, START), ratings.get(a, START)
                        p = 1.0 / (1.0 + 10.0 ** (-(x - z + hfa) / 400.0))
                        if y == y:
                            ratings[h], ratings[a] = x + k * (y - p), z - k * (y - p)
                    i += m
            if made:
                yield pd.DataFrame(made, columns=start_schema.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, year, ratings, brought = None, None, {}, None
        for pdf in batches:
            rh, ra, pr = [], [], []
            by = zip(*[pdf[c].tolist() for c in (*keys, "_piece")])
            for key, state, yr, h, a, y in zip(by, pdf["_state"].tolist(), pdf[season].tolist(), pdf[home].tolist(), pdf[away].tolist(), pdf[outcome].tolist()):
                if state is not None:
                    brought = key, pickle.loads(state)
                    continue
                if key != current:
                    current = key
                    year, ratings = brought[1] if brought and brought[0] == key else (yr, {})
                    brought = None
                if yr != year:
                    year = yr
                    if carry != 1.0:
                        ratings = {t: START + carry * (v - START) for t, v in ratings.items()}
                x, z = ratings.get(h, START), ratings.get(a, START)
                p = 1.0 / (1.0 + 10.0 ** (-(x - z + hfa) / 400.0))
                rh.append(x), ra.append(z), pr.append(p)
                if y is not None and y == y:
                    ratings[h], ratings[a] = x + k * (y - p), z - k * (y - p)
            if rh:
                yield pdf.loc[pdf["_h"] == 1, schema.names[:-3]].assign(r_home=rh, r_away=ra, p_elo=pr)

    if pieces > 1:
        whole = {f.name: F.lit(0).cast(f.dataType) for f in games.schema if isinstance(f.dataType, (T.IntegralType, T.BooleanType)) and f.name not in keys}
        rows = _with_headers(rows, packed.mapInPandas(starts, start_schema).withColumns(whole))
    else:
        rows = rows.withColumns({"_h": F.lit(1), "_state": F.lit(None).cast("binary")})
    by = [*keys, "_piece"]
    return rows.repartition(pieces, *by).sortWithinPartitions(*by, "_h", *order).mapInPandas(run, schema)


def market_elo_sums(
    games: DataFrame, *, outcome: str = "outcome", market: str = "p_market", slice_by: Column | str | None = None
) -> DataFrame:
    """Sums of earlier (outcome − market probability) of both teams of each game.

    The rating before a game is 1500 + K · sum, so one pass serves every K.
    """
    gap = F.col(outcome) - F.col(market)
    side = lambda t, v, sgn: F.struct(F.col(t).alias("team"), F.lit(v).alias("side"), (gap * sgn).alias("_d"))
    rows = games.select("*", F.inline(F.array(side("home", "home", 1), side("away", "away", -1))))
    run = running_total(rows, ["team"], ["game_date", "gameid"], {"_s": "_d"}, include_current=False, slice_by=slice_by)
    keep = [c for c in games.columns if c != "gameid"]
    pick = lambda v: F.max(F.when(F.col("side") == v, F.col("_s")))
    return run.groupBy("gameid").agg(
        *[F.any_value(c).alias(c) for c in keep], pick("home").alias("s_home"), pick("away").alias("s_away")
    )


def market_elo(games: DataFrame, *, k: float = 10.0, hfa: float = 25.0, slice_by: Column | str | None = None, **kw: str) -> DataFrame:
    """Ratings updated against the market probability, as prefix sums."""
    s = market_elo_sums(games, slice_by=slice_by, **kw)
    return s.withColumns({"r_home": START + F.col("s_home") * k, "r_away": START + F.col("s_away") * k}).withColumn(
        "p_bors", win_chance(F.col("r_home") - F.col("r_away") + hfa)
    )


def elo_grid(games: DataFrame, *, league: Sequence[str], order: Sequence[str] = ("game_date", "gameid"), burn_in: float = BURN_IN) -> DataFrame:
    """Brier score of every (K, home advantage) cell per league.

    All cells of a league are carried as one vector per team, so games are read once.
    """
    games = materialise(games.select(*league, *order, "home", "away", "outcome"), "elo-grid")
    sizes = games.groupBy(*league).agg(F.floor(F.count(F.lit(1)) * burn_in).alias("skip"))
    cut, pieces = _pieces(games, order[0])
    rows = _packed(cut, list(league), order, "home", "away", "outcome", None, pieces).join(sizes, list(league))
    unpacked = _unpacked
    fields = [f for f in games.schema.fields if f.name in league]
    schema = T.StructType(
        fields
        + [T.StructField(n, T.IntegerType()) for n in ("k", "hfa")]
        + [T.StructField("sq", T.DoubleType()), T.StructField("n", T.LongType())]
    )
    ks = np.array([k for k in GRID_K for _ in GRID_HFA], float)
    hs = np.array([h for _ in GRID_K for h in GRID_HFA], float)

    def done(key: tuple, sq: np.ndarray, n: int) -> pd.DataFrame:
        out = {c: [v] * len(ks) for c, v in zip(league, key)}
        return pd.DataFrame({**out, "k": ks.astype("int32"), "hfa": hs.astype("int32"), "sq": sq, "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ratings, sq, seen = None, {}, np.zeros(len(ks)), 0
        scored, base = 0, np.full(len(ks), START)
        for pdf in batches:
            for key, row in zip(zip(*[pdf[c].tolist() for c in league]), pdf[[*PACKED, "skip"]].itertuples(index=False)):
                if key != current:
                    if current is not None:
                        yield done(current, sq, scored)
                    current, ratings, sq, seen, scored = key, {}, np.zeros(len(ks)), 0, 0
                teams, hs_, as_, ys, _ = unpacked(row)
                for h, a, y in zip(hs_, as_, ys):
                    h, a = teams[h], teams[a]
                    x, z = ratings.get(h, base), ratings.get(a, base)
                    p = 1.0 / (1.0 + 10.0 ** (-(x - z + hs) / 400.0))
                    if seen >= row.skip:
                        sq = sq + (y - p) ** 2
                        scored += 1
                    seen += 1
                    step = ks * (y - p)
                    ratings[h], ratings[a] = x + step, z - step
        if current is not None:
            yield done(current, sq, scored)

    out = _in_order(rows, list(league)).mapInPandas(run, schema)
    return out.select(*league, "k", "hfa", (F.col("sq") / F.col("n")).alias("brier"))


def market_elo_grid(games: DataFrame, *, burn_in: float = BURN_IN, slice_by: Column | str | None = None, **kw: str) -> DataFrame:
    """Brier score of every cell for the market variant: 72 averages in one aggregation."""
    s = global_index(market_elo_sums(games, slice_by=slice_by, **kw), "game_date", ["gameid"], "_i", F.floor(F.col("gameid") / 100_000))
    skip = games.agg(F.floor(F.count(F.lit(1)) * burn_in)).scalar()
    diff = F.col("s_home") - F.col("s_away")
    cells = [(k, h) for k in GRID_K for h in GRID_HFA]
    wide = s.filter(F.col("_i") >= skip).agg(
        *[F.avg(F.pow(F.col("outcome") - win_chance(diff * float(k) + float(h)), F.lit(2.0))).alias(f"{k}_{h}") for k, h in cells]
    )
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("hfa"), F.col(f"{k}_{h}").alias("brier")) for k, h in cells])
    return wide.select(F.inline(items))


def best_cell(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cell of the lowest score; the first in grid order wins ties."""
    return grid.groupBy(*keys).agg(F.min_by(F.struct("k", "hfa", "brier"), F.struct("brier", "k", "hfa")).alias("b")).select(*keys, "b.*")


# Smallest training set, inverse penalty strength
MIN_HISTORY, PENALTY_C = 50, 1e5
#: Cutoffs share a point of expansion while their rows grow by at most this share of the
#: history, and by this much of its square: coefficients move with the root of the growth.
SPAN_GROWTH, SPAN_SQUARE = 0.05, 2.5e-6
#: Largest error of a standardised coefficient that an expansion may leave.
EXPANSION_ERROR = 1e-7
#: Error of an expansion up to which the next fit starts from it.
NEAR = 1e-2
#: Bound of the fifth derivative of the logistic loss, which an expansion leaves out.
FIFTH = 0.13


def expanding_logit(
    rows: DataFrame, features: Sequence[str], target: str, *, block: str, steps: int = 60, tolerance: float = 1e-8
) -> DataFrame:
    """Logistic forecast `p_process`, trained strictly on earlier blocks (dates).

    Consecutive cutoffs form spans, so that the history grows little within one. The first
    cutoff of each span is fitted by Newton steps, all spans in one job a step; a row meets
    the spans after it only, and as spans grow with the history, that is a bounded number on
    average. One more job sums the loss' first four derivatives at each span's point, over
    the history before the span and once per date within; the other cutoffs solve these
    expansions on the driver. Where the error bound exceeds EXPANSION_ERROR, the rest of the
    span goes on from points of its own, as many as the cutoffs that the last one settled
    call for, at most twice as many each round. The driver holds sums per span and date; a calendar bounds
    them. A cutoff that has not converged has `converged` false and no forecast.
    """
    data = rows.filter(F.expr(" AND ".join(f"{f} IS NOT NULL" for f in features)) & F.col(target).isNotNull())
    sums = data.groupBy(block).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.sum(F.col(f) * F.col(f)).alias(f"q{i}") for i, f in enumerate(features)], *[F.max(F.abs(f)).alias(f"m{i}") for i, f in enumerate(features)],
    ).orderBy(block).toPandas()
    scale = _Scales(sums, len(features))
    spark, nb = rows.sparkSession, len(sums)
    index = spark.createDataFrame(pd.DataFrame({block: sums[block], "_b": np.arange(nb)})) if nb else None
    theta, done = np.zeros((nb, scale.d)), scale.n < MIN_HISTORY
    if nb and not done.all():
        work = data.join(index.withColumn(block, F.col(block).cast(rows.schema[block].dataType)), block).select(
            "_b", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]
        ).persist()
        span = _spans(scale.n)
        rest, parts = np.flatnonzero(span >= 0), 1
        while len(rest):
            # the first open cutoff of each span, by which the span's other open ones are expanded
            starts = rest[np.unique(span[rest], return_index=True)[1]]
            seen = work.filter(F.col("_b") < int(rest.max()))
            fitted, ended = _newton(seen, features, scale, starts, theta[starts], steps, tolerance)
            own, good = _expanded(seen, features, scale, starts, rest, span, fitted, ended, tolerance)
            theta[rest], done[rest] = own, good
            open_spans = span[starts[ended]]  # a span whose first cutoff does not converge ends here
            covered = np.bincount(span[rest], good)
            rest = rest[~good & np.isin(span[rest], open_spans)]
            parts *= 2
            span = _split(span, rest, covered, parts)
        work.unpersist()
    v = scale.raw(theta, np.arange(nb))
    ready = done & (scale.n >= MIN_HISTORY)
    names = [f"_v{i}" for i in range(scale.d)]
    fields = [rows.schema[block], *[T.StructField(c, T.DoubleType()) for c in names], T.StructField("converged", T.BooleanType())]
    made = pd.DataFrame({block: sums[block], **{c: np.where(ready, v[:, i], np.nan) for i, c in enumerate(names)}, "converged": done})
    params = spark.createDataFrame(made, T.StructType(fields))
    logit = F.col("_v0")
    for i, f in enumerate(features):
        logit = logit + F.col(f"_v{i + 1}") * F.col(f)
    p = F.lit(1.0) / (1 + F.exp(-logit))
    return rows.join(params, block, "left").withColumn("p_process", F.when(~F.isnan(p), p)).drop(*names)


class _Scales:
    """Per cutoff: rows before it, and the matrix that standardises (1, x) by them."""

    def __init__(self, sums: pd.DataFrame, k: int):
        self.d, nb = k + 1, len(sums)
        before = lambda c: np.concatenate([[0.0], np.cumsum(sums[c].to_numpy(float))[:-1]]) if nb else np.zeros(0)
        self.n, self.own = before("n"), sums["n"].to_numpy(float)
        safe = np.maximum(self.n, 1.0)[:, None]
        mu = np.stack([before(f"s{i}") for i in range(k)], 1) / safe
        var = np.stack([before(f"q{i}") for i in range(k)], 1) / safe - mu**2
        sd = np.sqrt(np.where(var > 1e-15, var, 1.0))
        self.m = np.zeros((nb, self.d, self.d))
        self.m[:, 0, 0] = 1.0
        for i in range(k):
            self.m[:, i + 1, 0], self.m[:, i + 1, i + 1] = -mu[:, i] / sd[:, i], 1.0 / sd[:, i]
        # largest absolute values of (1, x) so far, and of the standardised row
        self.top = np.concatenate([np.ones((nb, 1)), np.maximum.accumulate(sums[[f"m{i}" for i in range(k)]].to_numpy(float), axis=0)], axis=1)
        self.reach = np.sqrt(1 + (((self.top[:, 1:] + np.abs(mu)) / sd) ** 2).sum(axis=1))
        self.penalty = np.diag([0.0] + [1.0 / PENALTY_C] * k)

    def raw(self, theta: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.einsum("bi,bij->bj", theta, self.m[at])

    def standard(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.m[at].transpose(0, 2, 1), raw[..., None])[..., 0] if len(at) else raw

    def step(self, theta: np.ndarray, at: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Newton step, Hessian) on the standardised scale from raw sums."""
        m = self.m[at]
        h = m @ hess @ m.transpose(0, 2, 1) + self.penalty + np.eye(self.d) * 1e-9
        g = np.einsum("bij,bj->bi", m, grad) + theta @ self.penalty
        return np.linalg.solve(h, g[..., None])[..., 0], h


def _spans(n: np.ndarray) -> np.ndarray:
    """Span of each cutoff by the rows before it; -1 where these are too few."""
    span, first, k = np.full(len(n), -1), np.inf, -1
    for t, before in enumerate(n):
        if before < MIN_HISTORY:
            continue
        if k < 0 or before > first + min(SPAN_GROWTH * first, SPAN_SQUARE * first**2):
            first, k = before, k + 1
        span[t] = k
    return span


def _split(span: np.ndarray, rest: np.ndarray, covered: np.ndarray, most: int) -> np.ndarray:
    """New spans: the open cutoffs `rest` of each span in consecutive groups of about the size that
    its point has `covered`, `most` at most; -1 elsewhere."""
    out, k = np.full(len(span), -1), 0
    for own in np.split(rest, np.flatnonzero(np.diff(span[rest])) + 1) if len(rest) else []:
        for group in np.array_split(own, min(most, int(np.ceil(len(own) / max(1, covered[span[own[0]]]))))):
            out[group], k = k, k + 1
    return out


def _terms(d: int, order: int) -> list[tuple[int, ...]]:
    return list(combinations_with_replacement(range(d), order))


def _later(pdf: pd.DataFrame, features: Sequence[str], cuts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (1, x), y and date by the first cutoff after them, in bounded pieces."""
    first = np.searchsorted(cuts, pdf["_b"].to_numpy(), side="right")
    order = np.argsort(first, kind="stable")
    pdf, first = pdf.iloc[order], first[order]
    x = np.column_stack([np.ones(len(pdf)), pdf[list(features)].to_numpy(float)])
    y, b = pdf["_y"].to_numpy(), pdf["_b"].to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]])) if len(pdf) else []
    for lo, hi in zip(edge[:-1], edge[1:]):
        for a in range(lo, hi, 2000):
            z = min(a + 2000, hi)
            yield int(first[lo]), x[a:z], y[a:z], b[a:z]


def _newton(work: DataFrame, features: Sequence[str], scale: _Scales, cuts: np.ndarray, theta: np.ndarray, steps: int, tolerance: float):
    """Fit the given cutoffs, each on all rows before it; one job per Newton step."""
    d, nc = scale.d, len(cuts)
    second = _terms(d, 2)
    left, right = (np.array(x) for x in zip(*second))
    names = [f"g{i}" for i in range(d + len(second))]
    later = _later

    def sums_of(v: np.ndarray, on: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((nc, len(names)))
            for pdf in batches:
                for k, x, y, _ in later(pdf, features, cuts):
                    use = on[on >= k]
                    if len(use):
                        p = 1.0 / (1.0 + np.exp(-np.clip(x @ v[use].T, -500, 500)))
                        total[use, :d] += (p - y[:, None]).T @ x
                        total[use, d:] += (p * (1 - p)).T @ (x[:, left] * x[:, right])
            yield pd.DataFrame(total, columns=names).assign(j=np.arange(nc, dtype="int32"))[["j", *names]]

        return run

    theta, done = theta.copy(), np.zeros(nc, bool)
    for _ in range(steps):
        on = np.flatnonzero(~done)
        got = work.mapInPandas(sums_of(scale.raw(theta, cuts), on), "j int, " + ", ".join(f"{c} double" for c in names))
        got = got.groupBy("j").agg(*[F.sum(c).alias(c) for c in names]).toPandas().set_index("j").reindex(range(nc), fill_value=0.0).to_numpy()[on]
        hess = np.zeros((len(on), d, d))
        hess[:, left, right] = hess[:, right, left] = got[:, d:]
        delta, _ = scale.step(theta[on], cuts[on], got[:, :d], hess)
        theta[on] -= np.clip(delta, -5, 5)
        done[on] = np.abs(delta).max(axis=1, initial=0.0) < tolerance
        if done.all():
            break
    return theta, done


def _expanded(work: DataFrame, features: Sequence[str], scale: _Scales, starts: np.ndarray, rest: np.ndarray, span: np.ndarray, fitted: np.ndarray, ended: np.ndarray, tolerance: float):
    """(theta, done) of the cutoffs `rest` from the expansion of the loss at each span's point."""
    d, ns, nb = scale.d, len(starts), len(span)
    terms = [_terms(d, k) for k in (1, 2, 3, 4)]
    names = [f"t{i}" for i in range(sum(map(len, terms)))]
    point = scale.raw(fitted, starts)
    later = _later

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        history, dates = np.zeros((ns, len(names))), np.zeros((nb, len(names)))
        for pdf in batches:
            for k, x, y, b in later(pdf, features, starts):
                first = max(k - 1, 0)  # the rows' own span, then those after it
                if k == 0 and first >= ns:
                    continue
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ point[first:].T, -500, 500)))
                s = p * (1 - p)
                at = 0
                for level, weight in zip(terms, (p - y[:, None], s, s * (1 - 2 * p), s * (1 - 6 * s))):
                    product = np.stack([np.prod(x[:, list(t)], axis=1) for t in level], axis=1)
                    history[k:, at : at + len(level)] += weight[:, k - first :].T @ product
                    if k:
                        np.add.at(dates[:, at : at + len(level)], b, weight[:, :1] * product)
                    at += len(level)
        for kind, table in (("history", history), ("date", dates)):
            some = np.flatnonzero(np.abs(table).sum(axis=1))
            yield pd.DataFrame(table[some], columns=names).assign(kind=kind, j=some.astype("int32"))[["kind", "j", *names]]

    got = work.mapInPandas(run, "kind string, j int, " + ", ".join(f"{c} double" for c in names)).groupBy("kind", "j").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    history, dates = (got[got["kind"] == kind].set_index("j")[names].reindex(range(size), fill_value=0.0).to_numpy() for kind, size in (("history", ns), ("date", nb)))
    theta, done = np.zeros((len(rest), d)), np.zeros(len(rest), bool)
    places = []
    for level in terms:
        full = np.zeros((d,) * len(level[0]), dtype=np.int64)
        for i, t in enumerate(level):
            for q in set(permutations(t)):
                full[q] = i
        places.append(full)
    for b in range(ns):
        here = np.flatnonzero(span[rest] == span[starts[b]])
        at = rest[here]
        within = np.concatenate([np.zeros((1, len(names))), np.cumsum(dates[at[0] : at[-1]], axis=0)])
        total = history[b] + within[at - at[0]]
        g, h, t3, t4 = (total[:, sum(map(len, terms[:k])) + places[k]] for k in range(4))
        own = scale.standard(np.repeat(point[b : b + 1], len(at), axis=0), at)
        size = np.full(len(at), np.inf)
        for _ in range(30):
            move = scale.raw(own, at) - point[b]
            first = np.einsum("tijkl,tj,tk,tl->ti", t4, move, move, move) / 6 + np.einsum("tijk,tj,tk->ti", t3, move, move) / 2 + np.einsum("tij,tj->ti", h, move) + g
            second = h + np.einsum("tijk,tk->tij", t3, move) + np.einsum("tijkl,tk,tl->tij", t4, move, move) / 2
            delta, curve = scale.step(own, at, first, second)
            own, size = own - np.clip(delta, -1, 1), np.abs(delta).max(axis=1)
            if (size < tolerance).all():
                break
        far = (np.abs(scale.raw(own, at) - point[b]) * scale.top[at]).sum(axis=1)
        left_out = FIFTH / 24 * far**4 * scale.n[at] * scale.reach[at] * np.linalg.norm(np.linalg.inv(curve), axis=(1, 2))
        # beyond the bound the expansion may lead anywhere: the next fit starts from the point
        near = (np.isfinite(own).all(axis=1) & (left_out <= NEAR))[:, None]
        theta[here] = np.where(near, own, scale.standard(np.repeat(point[b : b + 1], len(at), axis=0), at))
        done[here] = (size < tolerance) & (left_out <= EXPANSION_ERROR) & ended[b]
    return theta, done
