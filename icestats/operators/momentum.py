"""Latent momentum of a game: filter, smoother, likelihood, fit.

One scalar state per game: x' = a^dt · x + B·u, observed as y = C·x + D·z with noise.
A task reads sorted rows as Arrow batches, steps through all games of a batch at once, and
carries two numbers over to the next batch for a game that goes on. With `slice_by` a game
is cut into consecutive pieces that run in parallel: the events of a piece compose to one
element (five numbers for the filter, three for the smoother), one row per piece folds into
the state at its border, and a header row brings that state in. Memory does not depend on
the length of a game.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icestats.operators.evaluation import fit_logits
from icestats.plans.slicing import _with_headers, as_column, global_index, tasks_for

# The thirteen inputs and the four observation covariates, in model order
INPUTS = (
    "hit_for_O", "hit_for_D", "hit_for_N", "hit_against_O", "hit_against_D", "hit_against_N", "shot_for", "shot_against",
    "takeaway", "giveaway", "block_for", "block_against", "faceoff_win",
)
COVARIATES = ("is_home", "delta_pythagorean", "delta_shot_share", "score_state")


@dataclass
class MomentumParams:
    """Model parameters on the unconstrained scale."""

    a0: float = 3.0  # decay, through the logistic function
    b: Sequence[float] = field(default_factory=lambda: [0.0] * len(INPUTS))
    c: float = 0.0  # log of the loading
    d: Sequence[float] = field(default_factory=lambda: [0.0] * len(COVARIATES))
    q: float = -2.0  # log of the state noise
    r: float = -1.0  # log of the observation noise
    p0: float = 0.0  # log of the starting variance
    alpha: float = 0.0  # start from home ice
    beta: float = 0.0  # start from the prior strength

    def vector(self) -> np.ndarray:
        return np.array([self.a0, *self.b, self.c, *self.d, self.q, self.r, self.p0, self.alpha, self.beta], float)

    @classmethod
    def of(cls, v: Sequence[float]) -> "MomentumParams":
        v = [float(x) for x in v]
        nb, nd = len(INPUTS), len(COVARIATES)
        return cls(v[0], v[1 : 1 + nb], v[1 + nb], v[2 + nb : 2 + nb + nd], *v[2 + nb + nd :])

    @property
    def decay(self) -> float:
        return 1.0 / (1.0 + math.exp(-self.a0))


def _segments(pdf: pd.DataFrame, keys: Sequence[str]):
    """First row and length of each run of equal keys in a sorted batch."""
    if not len(pdf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    cut = np.flatnonzero(change)
    return cut, np.diff(np.append(cut, len(pdf)))


def _parts(theta: np.ndarray):
    """(a, b, c, d, q, r, p0, alpha, beta) on their natural scales."""
    nb, nd = len(INPUTS), len(COVARIATES)
    tail = theta[2 + nb + nd :]
    return 1.0 / (1.0 + np.exp(-theta[0])), theta[1 : 1 + nb], np.exp(theta[1 + nb]), theta[2 + nb : 2 + nb + nd], *np.exp(tail[:3]), *tail[3:]


def _steps(lens: np.ndarray):
    """(step, pieces that have it), pieces from the longest to the shortest."""
    order = np.argsort(-lens, kind="stable")
    top = lens[order]
    for t in range(int(lens.max(initial=0))):
        yield t, order[: np.searchsorted(-top, -t, side="left")]


def _forward(theta: np.ndarray, u: np.ndarray, y: np.ndarray, z: np.ndarray, dt: np.ndarray, starts: np.ndarray, lens: np.ndarray, x: np.ndarray, p: np.ndarray):
    """Filter all pieces of a batch together from their states (x, p), which are moved to their ends.

    Returns per row x_pred, p_pred, x_filt, p_filt and the negative log-likelihood.
    """
    a, b, c, d, q, r, *_ = _parts(theta)
    out = np.empty((5, len(y)))
    at, bu, rest = a**dt, u @ b, y - z @ d
    for t, act in _steps(lens):
        i = starts[act] + t
        xp, pp = at[i] * x[act] + bu[i], at[i] ** 2 * p[act] + q
        e, s = rest[i] - c * xp, c * c * pp + r
        k = pp * c / s
        x[act], p[act] = xp + k * e, (1 - k * c) * pp
        out[:, i] = xp, pp, x[act], p[act], 0.5 * (np.log(s) + e * e / s)
    return out


def _compose(theta: np.ndarray, u: np.ndarray, y: np.ndarray, z: np.ndarray, dt: np.ndarray, starts: np.ndarray, lens: np.ndarray, held: np.ndarray):
    """Compose each piece's events onto its element, a column (A, B, C, E, J) of `held`.

    A piece turns the state N(m, P) before it into mean A (m + P E) / (1 + P J) + B and
    variance A^2 P / (1 + P J) + C.
    """
    a, b, c, d, q, r, *_ = _parts(theta)
    s = c * c * q + r
    gain = q * c / s
    at, bu = a**dt, u @ b
    seen = y - z @ d - c * bu
    own = np.stack([(1 - gain * c) * at, bu + gain * seen, np.full(len(y), (1 - gain * c) * q), at * c * seen / s, (at * c) ** 2 / s])
    for t, act in _steps(lens):
        aj, bj, cj, ej, jj = own[:, starts[act] + t]
        ai, bi, ci, ei, ji = held[:, act]
        w = 1 / (1 + ci * jj)
        held[:, act] = aj * ai * w, aj * w * (bi + ci * ej) + bj, aj * aj * ci * w + cj, ai * w * (ej - jj * bi) + ei, ai * ai * jj * w + ji
    return held


IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0)


def _by_piece(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _columns(df: DataFrame, extra: Sequence[str]) -> DataFrame:
    num = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n)
    return df.select(*extra, num("y"), num("dt"), *[num(n) for n in INPUTS], *[num(n) for n in COVARIATES])


def _led(rows: DataFrame, headers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with a header row per piece; whole numbers stay whole in tasks, as headers have them too."""
    whole = {c: F.lit(0).cast(rows.schema[c].dataType) for c in order if isinstance(rows.schema[c].dataType, T.IntegralType)}
    return _with_headers(rows, headers.withColumns(whole))


def _arrays(pdf: pd.DataFrame):
    return pdf[list(INPUTS)].to_numpy(float), pdf["y"].to_numpy(float), pdf[list(COVARIATES)].to_numpy(float), pdf["dt"].to_numpy(float)


def _folded(summaries: DataFrame, keys: Sequence[str], game: str, step, names: Sequence[str], backward: bool = False) -> DataFrame:
    """Fold the pieces of each game, one row each, in order: `step(row, state)` gives
    (values of the piece, state for the next); the state is None at the first piece."""
    by = [F.col(k) if k == game or not backward else F.col(k).desc() for k in keys]
    src = summaries.repartition(game).sortWithinPartitions(*by)
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            made = []
            for row in pdf.itertuples(index=False):
                now = getattr(row, game)
                values, state = step(row, state if now == last else None)
                last = now
                made.append(values)
            if made:
                yield pdf[list(keys)].assign(**dict(zip(names, np.array(made, float).T)))

    return src.mapInPandas(run, schema)


def kalman_filter(df: DataFrame, params: MomentumParams, *, game: str = "gameid", order: Sequence[str] = ("elapsed", "event_id"), slice_by: Column | str | None = None) -> DataFrame:
    """Predicted and filtered state and negative log-likelihood of every event.

    `slice_by` cuts a game into consecutive pieces (a column increasing with the order).
    """
    theta, forward, segments, arrays = params.vector(), _forward, _segments, _arrays
    alpha, beta, p0 = params.alpha, params.beta, math.exp(params.p0)
    src = _columns(df if slice_by is None else df.withColumn("_slice", as_column(slice_by)), [game, *order] if slice_by is None else [game, "_slice", *order])
    keys = [game] if slice_by is None else [game, "_slice"]
    by = [F.col(c) for c in order]
    if slice_by is not None:
        src = _led(src, _entries(src, params, keys, game, by), order)
        by = [F.col("_h"), *by]
    names = ("x_pred", "p_pred", "x_filt", "p_filt", "nll")
    schema = T.StructType([src.schema[k] for k in [game, *order, "dt"]] + [T.StructField(n, T.DoubleType()) for n in names])
    src = _by_piece(src, keys, by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for pdf in batches:
            brought = {}
            if "_h" in pdf:
                head = pdf[pdf["_h"] == 0]
                brought = dict(zip(zip(*(head[k] for k in keys)), zip(head["x_in"], head["p_in"])))
                pdf = pdf[pdf["_h"] == 1]
            starts, lens = segments(pdf, keys)
            if not len(starts):
                last, held = next(reversed(brought.items()), (last, held))
                continue
            u, y, z, dt = arrays(pdf)
            own = list(zip(*(pdf[k].to_numpy()[starts] for k in keys)))
            states = [brought[k] if k in brought else held if k == last else (alpha * z[i, 0] + beta * z[i, 1], p0) for k, i in zip(own, starts)]
            x, p = (np.array(v, float) for v in zip(*states))
            out = forward(theta, u, y, z, dt, starts, lens, x, p)
            last, held = own[-1], (x[-1], p[-1])
            if brought and next(reversed(brought)) != last and next(reversed(brought)) not in own:
                last, held = next(reversed(brought.items()))  # its rows are in the next batch
            yield pdf[[game, *order, "dt"]].assign(**dict(zip(names, out)))

    return src.mapInPandas(run, schema)


def _entries(src: DataFrame, params: MomentumParams, keys: Sequence[str], game: str, by: Sequence[Column]) -> DataFrame:
    """(keys, x_in, p_in): the state with which each piece starts, one row per piece."""
    theta, segments, arrays, compose = params.vector(), _segments, _arrays, _compose
    alpha, beta, p0 = params.alpha, params.beta, math.exp(params.p0)
    names = ("e_a", "e_b", "e_c", "e_e", "e_j", "mu")
    rows = _by_piece(src, keys, by)
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, mu_held = None, None, 0.0
        for pdf in batches:
            starts, lens = segments(pdf, keys)
            if not len(starts):
                continue
            u, y, z, dt = arrays(pdf)
            own = list(zip(*(pdf[k].to_numpy()[starts] for k in keys)))
            elements = np.tile(np.array(IDENTITY)[:, None], len(starts))
            mu = alpha * z[starts, 0] + beta * z[starts, 1]
            if last == own[0]:
                elements[:, 0], mu[0] = held, mu_held
            elif last is not None:
                yield pd.DataFrame([(*last, *held, mu_held)], columns=[*keys, *names])
            compose(theta, u, y, z, dt, starts, lens, elements)
            if len(own) > 1:
                yield pd.DataFrame(own[:-1], columns=list(keys)).assign(**dict(zip(names, [*elements[:, :-1], mu[:-1]])))
            last, held, mu_held = own[-1], elements[:, -1], mu[-1]
        if last is not None:
            yield pd.DataFrame([(*last, *held, mu_held)], columns=[*keys, *names])

    def step(row, state):
        m, v = state or (row.mu, p0)
        w = 1 / (1 + v * row.e_j)
        return (m, v), (row.e_a * w * (m + v * row.e_e) + row.e_b, row.e_a**2 * v * w + row.e_c)

    return _folded(rows.mapInPandas(run, schema), keys, game, step, ("x_in", "p_in"))


def _smooth(a: float, dt: np.ndarray, xp: np.ndarray, pp: np.ndarray, xf: np.ndarray, pf: np.ndarray, starts: np.ndarray, lens: np.ndarray, state: np.ndarray, have: np.ndarray):
    """Step all pieces of a batch (latest event first) from the following event's values.

    `state` holds smoothed mean and variance, prediction and gap of that event per piece.
    """
    xs, ps = np.empty(len(dt)), np.empty(len(dt))
    for t, act in _steps(lens):
        i = starts[act] + t
        sx, sp, npx, npp, ndt = state[:, act]
        j = np.where(have[act], pf[i] * a**ndt / np.where(have[act], npp, 1.0), 0.0)
        xs[i], ps[i] = xf[i] + j * (sx - npx), pf[i] + j * j * (sp - npp)
        state[:, act] = xs[i], ps[i], xp[i], pp[i], dt[i]
        have[act] = True
    return xs, ps


def rts_smoother(filtered: DataFrame, params: MomentumParams, *, game: str = "gameid", order: Sequence[str] = ("elapsed", "event_id"), slice_by: Column | str | None = None) -> DataFrame:
    """Smoothed state: the same streaming in reverse order, carrying the next event's values.

    With `slice_by` pieces run in parallel as in the filter: smoothing is affine in the
    smoothed state that follows, so a piece composes to three numbers.
    """
    a, segments, smooth = params.decay, _segments, _smooth
    src = filtered if slice_by is None else filtered.withColumn("_slice", as_column(slice_by))
    keys = [game] if slice_by is None else [game, "_slice"]
    by = [F.col(c).desc() for c in order]
    if slice_by is not None:
        src = _led(src, _exits(src, a, keys, game, by), order)
        by = [F.col("_h"), *by]
    schema = T.StructType([src.schema[k] for k in [game, *order]] + [T.StructField(n, T.DoubleType()) for n in ("x_filt", "x_smooth", "p_smooth")])
    src = _by_piece(src, keys, by)
    following = ("n_x", "n_p", "n_xp", "n_pp", "n_dt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for pdf in batches:
            brought = {}
            if "_h" in pdf:
                head = pdf[pdf["_h"] == 0]
                brought = dict(zip(zip(*(head[k] for k in keys)), head[list(following)].to_numpy(float)))
                pdf = pdf[pdf["_h"] == 1]
            starts, lens = segments(pdf, keys)
            if not len(starts):
                last, held = next(reversed(brought.items()), (last, held))
                continue
            own = list(zip(*(pdf[k].to_numpy()[starts] for k in keys)))
            none = np.full(5, np.nan)
            state = np.stack([brought[k] if k in brought else held if k == last else none for k in own], axis=1)
            have = ~np.isnan(state[0])
            xs, ps = smooth(a, *(pdf[c].to_numpy(float) for c in ("dt", "x_pred", "p_pred", "x_filt", "p_filt")), starts, lens, np.nan_to_num(state), have)
            dt, xp, pp = (pdf[c].to_numpy(float)[-1] for c in ("dt", "x_pred", "p_pred"))
            last, held = own[-1], np.array([xs[-1], ps[-1], xp, pp, dt])
            if brought and next(reversed(brought)) not in own:
                last, held = next(reversed(brought.items()))
            yield pdf[[game, *order, "x_filt"]].assign(x_smooth=xs, p_smooth=ps)

    return src.mapInPandas(run, schema)


def _exits(src: DataFrame, a: float, keys: Sequence[str], game: str, by: Sequence[Column]) -> DataFrame:
    """(keys, n_*): the values of the event that follows each piece (null for a game's last)."""
    segments, steps = _segments, _steps
    # x_first = e_e · x_last + e_g and p_first = e_e² · p_last + e_l, with the filtered values of the last event
    names = ("e_e", "e_g", "e_l", "last_x", "last_p", "first_xp", "first_pp", "first_dt")
    rows = _by_piece(src, keys, by)
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for pdf in batches:
            starts, lens = segments(pdf, keys)
            if not len(starts):
                continue
            own = list(zip(*(pdf[k].to_numpy()[starts] for k in keys)))
            dt, xp, pp, xf, pf = (pdf[c].to_numpy(float) for c in ("dt", "x_pred", "p_pred", "x_filt", "p_filt"))
            made = np.zeros((8, len(starts)))
            fresh = np.ones(len(starts), bool)
            if last == own[0]:
                made[:, 0], fresh[0] = held, False
            elif last is not None:
                yield pd.DataFrame([(*last, *held)], columns=[*keys, *names])
            for t, act in steps(lens):
                i = starts[act] + t
                e, g, v, lx, lp, nx, np_, nd = made[:, act]
                first = fresh[act]
                j = np.where(first, 1.0, pf[i] * a**nd / np.where(first, 1.0, np_))
                # the last event of the piece stands for itself
                e, g, v = np.where(first, 1.0, j * e), np.where(first, 0.0, xf[i] + j * (g - nx)), np.where(first, 0.0, pf[i] + j * j * (v - np_))
                made[:, act] = e, g, v, np.where(first, xf[i], lx), np.where(first, pf[i], lp), xp[i], pp[i], dt[i]
                fresh[act] = False
            if len(own) > 1:
                yield pd.DataFrame(own[:-1], columns=list(keys)).assign(**dict(zip(names, made[:, :-1])))
            last, held = own[-1], made[:, -1]
        if last is not None:
            yield pd.DataFrame([(*last, *held)], columns=[*keys, *names])

    def step(row, state):
        x, p = row.last_x, row.last_p
        if state is not None:
            sx, sp, npx, npp, ndt = state
            j = p * a**ndt / npp
            x, p = x + j * (sx - npx), p + j * j * (sp - npp)
        return state or (math.nan,) * 5, (row.e_e * x + row.e_g, row.e_e**2 * p + row.e_l, row.first_xp, row.first_pp, row.first_dt)

    return _folded(rows.mapInPandas(run, schema), keys, game, step, ("n_x", "n_p", "n_xp", "n_pp", "n_dt"), backward=True)


def _ends(lens: np.ndarray):
    """(first row, end, games) of each step of a packed batch, whose games run from the longest to the shortest."""
    first = 0
    for t in range(int(lens[0])):
        m = int(np.searchsorted(-lens, -t, side="left"))
        yield first, first + m, m
        first += m


class _Room:
    """Arrays by name that one batch leaves to the next, so large ones need not be found anew."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...]) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size)
        return self.held[name][:size].reshape(shape)


def _run_forward(thetas: np.ndarray, u: np.ndarray, y: np.ndarray, z: np.ndarray, dt: np.ndarray, steps: list, x: np.ndarray, p: np.ndarray, room: _Room) -> dict:
    """Filter a packed batch for several parameter vectors; per row and vector what the gradient needs.

    A step's rows lie together, and so do the numbers of the games that have it; constants are
    repeated for each game, so a step works on plain stretches of memory.
    """
    nb, nd = len(INPUTS), len(COVARIATES)
    c, q, r = (np.exp(thetas[:, i]) for i in (1 + nb, 2 + nb + nd, 3 + nb + nd))
    a = 1 / (1 + np.exp(-thetas[:, 0]))
    x0, p0, xp, left, e, at = (room(n, (len(y), len(thetas))) for n in ("x0", "p0", "xp", "left", "e", "at"))
    np.exp(np.outer(dt, np.log(a), out=at), out=at)
    np.matmul(u, thetas[:, 1 : 1 + nb].T, out=xp)  # what the inputs add, then the prediction
    np.matmul(z, -thetas[:, 2 + nb : 2 + nb + nd].T, out=e)  # the observation without covariates, then the gap
    e += y[:, None]
    x, p = x.copy(), p.copy()
    by_c, by_cc, by_q, by_r, gain = (np.repeat(v[None], len(x), axis=0) for v in (c, c * c, q, r, c / r))
    logs, squares = np.zeros(x.shape), np.zeros(x.shape)
    for i, j, m in steps:
        xm, pm, back, xpt, et, lt = x[:m], p[:m], at[i:j], xp[i:j], e[i:j], left[i:j]
        x0[i:j], p0[i:j] = xm, pm
        xm *= back
        xpt += xm
        pm *= back
        pm *= back
        pm += by_q[:m]
        et -= by_c[:m] * xpt
        np.multiply(by_cc[:m], pm, out=lt)
        lt += by_r[:m]
        np.divide(by_r[:m], lt, out=lt)  # 1 - k c
        pm *= lt
        np.multiply(pm, gain[:m], out=xm)
        xm *= et
        xm += xpt
        square = et * et
        square *= lt
        squares[:m] += square
        logs[:m] += np.log(lt, out=square)
    return {"a": a, "c": c, "q": q, "r": r, "at": at, "x0": x0, "p0": p0, "left": left, "e": e, "x": x, "p": p, "logs": logs, "squares": squares}


def _run_back(f: dict, u: np.ndarray, z: np.ndarray, dt: np.ndarray, steps: list, w: np.ndarray | None, lx: np.ndarray, lp: np.ndarray, room: _Room, apart: bool = False):
    """Step a filtered batch backwards: the derivatives of the weighted NLL plus lx · x + lp · p at the ends.

    The mean and variance at a step pass their derivatives to the step before; the sums over
    rows follow once all are known, so the cost hardly depends on the number of parameters.
    Returns the gradient and the derivatives at the games' starts; the entries of the start,
    the loading and the noise are zero (see `_completed`). `apart`: one vector, the gradient
    of each game.
    """
    nb, nd = len(INPUTS), len(COVARIATES)
    c, r, at, left, e, x0, p0 = (f[n] for n in ("c", "r", "at", "left", "e", "x0", "p0"))
    from_x, by_gap, by_decay = (room(n, at.shape) for n in ("from_x", "by_gap", "by_decay"))
    lx, lp = lx.copy(), lp.copy()
    spread, gain, by_cc = np.zeros(lx.shape), *(np.repeat(v[None], len(lx), axis=0) for v in (c / r, c * c / r))
    for i, j, m in reversed(steps):
        xm, pm, lt, back, dx = lx[:m], lp[:m], left[i:j], at[i:j], from_x[i:j]
        g = e[i:j] * lt
        g *= gain[:m]
        np.multiply(xm, lt, out=dx)
        pm *= lt
        pm += xm * g
        pm *= lt
        if w is not None:
            shed = lt * by_cc[:m]
            shed -= g * g
            shed *= w[:m]
            shed *= 0.5
            pm += shed
            g *= w[:m]
            dx -= g
        np.subtract(xm, dx, out=by_gap[i:j])  # of the gap, times the loading
        spread[:m] += pm
        np.multiply(dx, back, out=xm)
        pm *= back
        pm *= back
        both = by_decay[i:j]
        np.multiply(pm, p0[i:j], out=both)
        both *= 2.0
        both += xm * x0[i:j]
    inputs, covariates, noise = slice(1, 1 + nb), slice(2 + nb, 2 + nb + nd), 2 + nb + nd
    spread *= f["q"]
    if apart:
        grad = np.zeros((len(lx), 2 + nb + nd + 5))
        each = np.concatenate([by_decay * (dt[:, None] * (1 - f["a"])), from_x * u, by_gap * z / -c], axis=1)
        for i, j, m in steps:
            grad[:m, 0] += each[i:j, 0]
            grad[:m, inputs] += each[i:j, 1 : 1 + nb]
            grad[:m, covariates] += each[i:j, 1 + nb :]
        grad[:, noise] = spread[:, 0]
    else:
        grad = np.zeros((len(c), 2 + nb + nd + 5))
        grad[:, 0] = (dt @ by_decay) * (1 - f["a"])
        grad[:, inputs] = from_x.T @ u
        grad[:, covariates] = by_gap.T @ z / -c[:, None]
        grad[:, noise] = spread.sum(axis=0)
    return grad, lx, lp


def _completed(thetas: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Whole gradients (one row a vector) from those whose entry of the observation noise holds Σ w (1 - e² / s) / 2.

    All variances scaled together scale s alone, and the NLL stays when the state is measured
    in another unit; each gives one entry from the others.
    """
    nb, nd = len(INPUTS), len(COVARIATES)
    loading, state, noise, start = 1 + nb, 2 + nb + nd, 3 + nb + nd, 4 + nb + nd
    grad = grad.copy()
    grad[:, noise] -= grad[:, state] + grad[:, start]
    units = thetas.copy()
    units[:, [0, loading, noise]], units[:, 2 + nb : 2 + nb + nd], units[:, [state, start]] = 0.0, 0.0, 2.0
    grad[:, loading] = (units * grad).sum(axis=1)
    return grad


def _sums(thetas: np.ndarray, u: np.ndarray, y: np.ndarray, z: np.ndarray, dt: np.ndarray, lens: np.ndarray, w: np.ndarray | None, first: int, last: int, held, room: _Room):
    """Weighted sums of the NLL and its gradient (as `_completed` takes it) for several parameter vectors at once.

    Rows are packed step by step, games from the longest to the shortest; arrays run over
    (row, vector), weights `w` over (game, vector). `first` is the place of the game that goes
    on from the state `held`, `last` that of the game whose state the next batch goes on from
    (-1: none). Returns (nll, gradient, state of that game and its derivatives); without
    weights, for one vector, the NLL and the gradient of each game.
    """
    at_noise, at_p0, at_alpha = (thetas.shape[1] - k for k in (4, 3, 2))
    apart, steps = w is None, list(_ends(lens))
    z0, z1, p0 = z[: len(lens), :1], z[: len(lens), 1:2], np.exp(thetas[:, at_p0])
    x = thetas[:, at_alpha] * z0 + thetas[:, at_alpha + 1] * z1
    p = np.repeat(p0[None], len(lens), axis=0)
    if held is not None:
        x[first], p[first] = held[0], held[1]
    w = np.ones(x.shape) if apart else w

    def settle(grad: np.ndarray, lx: np.ndarray, lp: np.ndarray, games: np.ndarray, each: bool = False) -> np.ndarray:
        """Take the derivatives at the games' starts on to the parameters that these come from."""
        if held is not None and first in games:
            k = list(games).index(first)
            grad[k if each else slice(None)] += (lx[k][:, None] * held[2] + lp[k][:, None] * held[3])[0 if each else slice(None)]
            lx[k] = lp[k] = 0.0
        total = (lambda v: v[:, 0]) if each else (lambda v: v.sum(axis=0))
        grad[:, at_alpha] += total(lx * z0[games])
        grad[:, at_alpha + 1] += total(lx * z1[games])
        grad[:, at_p0] += total(lp * p0)
        return grad

    f = _run_forward(thetas, u, y, z, dt, steps, x, p, room)
    squares = f["squares"] / f["r"]
    nll, noise = (0.5 * w * v for v in (lens[:, None] * np.log(f["r"]) - f["logs"] + squares, lens[:, None] - squares))
    nll, noise = (v[:, 0] if apart else v.sum(axis=0) for v in (nll, noise))
    none = np.zeros(x.shape)
    grad = settle(*_run_back(f, u, z, dt, steps, w, none, none, room, apart), np.arange(len(lens)), apart)
    grad[:, at_noise] += noise
    if last < 0:
        return nll, grad, None
    rows = np.array([i + last for i, _, m in steps if last < m])
    one = {n: v[rows] if len(v) == len(y) and v.ndim == 2 else v for n, v in f.items()}
    single, on, off = [(t, t + 1, 1) for t in range(len(rows))], np.ones((1, len(thetas))), np.zeros((1, len(thetas)))
    dx, dp = (settle(*_run_back(one, u[rows], z[rows], dt[rows], single, None, *seed, room), np.array([last])) for seed in ((on, off), (off, on)))
    return nll, grad, (f["x"][last], f["p"][last], dx, dp)


#: Parameter vectors that a task steps through together.
VECTORS = 24


def likelihood(prepared: DataFrame, thetas: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Σ NLL and Σ gradient for several parameter vectors in one job.

    `prepared` comes from `prepare`; `which` names the weight of each vector where games
    are weighted (none: all games count once). A task adds up its packed batches and returns
    one short row per vector; these are summed on the cluster. Where weights differ but the
    vectors do not, games are filtered once and their values weighted.
    """
    sums, n_vec, n_par = _sums, *thetas.shape
    nu, nz = len(INPUTS), len(COVARIATES)
    equal = which is not None and n_vec > 1 and bool((thetas == thetas[0]).all())
    blocks = [slice(0, 1)] if equal else [slice(k, min(k + VECTORS, n_vec)) for k in range(0, n_vec, VECTORS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, room = np.zeros((n_vec, 1 + n_par)), _Room()
        held: list = [None] * len(blocks)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                data, lens = np.frombuffer(row.data).reshape(row.n, -1), np.frombuffer(row.lens, "i8")
                y, dt, u, z = (np.ascontiguousarray(v) for v in (data[:, 0], data[:, 1], data[:, 2 : 2 + nu], data[:, 2 + nu : 2 + nu + nz]))
                weights = np.frombuffer(row.weights, "u2").reshape(len(lens), -1) if row.weights and which is not None else None
                each = equal and weights is not None
                for k, block in enumerate(blocks):
                    own = None
                    if not each:
                        own = weights[:, which[block]].astype(float) if weights is not None else np.ones((len(lens), block.stop - block.start))
                    nll, g, held[k] = sums(thetas[block], u, y, z, dt, lens, own, row.first, row.last, held[k] if row.first >= 0 else None, room)
                    if each:
                        total += weights[:, which].astype(float).T @ np.column_stack([nll, g])
                    else:
                        total[slice(None) if equal else block] += np.column_stack([nll, g])
        yield pd.DataFrame({"k": np.arange(n_vec, dtype="int32"), "v": list(total)})

    # summed on the cluster: the driver gets one number per parameter vector and entry
    parts = prepared.mapInPandas(run, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "x"))
    got = parts.groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas()
    arr = np.zeros((n_vec, 1 + n_par))
    arr[got["k"].to_numpy(), got["i"].to_numpy()] = got["x"].to_numpy()
    return arr[:, 0], _completed(thetas, arr[:, 1:])


#: Rows of a game up to which it is packed whole; a longer one runs over several batches.
PACK_ROWS = 20_000


def prepare(df: DataFrame, *, game: str = "gameid", order: Sequence[str] = ("elapsed", "event_id"), weights: DataFrame | None = None, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Shuffle and sort once and keep the rows as batches of packed numbers.

    A batch has a bounded number of rows and ends with a game; only a game above `pack_rows`
    runs over several. Each epoch then reads plain buffers, step by step of all games, instead
    of converting columns. The rows are counted, and every core gets a share of the games.
    `weights` (game, weights) has one count per parameter vector; it travels as one header row per game.
    """
    src, by = _columns(df, [game, *order]), [F.col(c) for c in order]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, tasks_for(src)[0] or 1)
    if weights is not None:
        src, by = _with_headers(src, weights.select(game, "weights")), [F.col("_h"), *by]
    src = src.repartition(tasks, game).sortWithinPartitions(game, *by)
    segments, columns = _segments, ["y", "dt", *INPUTS, *COVARIATES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        rest, open_game = None, None  # rows that wait for the end of their game, the game that is packed in part

        def packed(pdf: pd.DataFrame, more: bool) -> pd.DataFrame:
            nonlocal open_game
            starts, lens = segments(pdf, [game])
            games = pdf[game].to_numpy()[starts]
            place = np.argsort(-lens, kind="stable")
            step = np.arange(len(pdf)) - np.repeat(starts, lens)
            rank = np.empty(len(lens), "i8")
            rank[place] = np.arange(len(lens))
            rows = np.lexsort((np.repeat(rank, lens), step))
            out = pd.DataFrame({
                "n": [len(pdf)], "first": [int(rank[0]) if open_game is not None and games[0] == open_game else -1], "last": [int(rank[-1]) if more else -1],
                "lens": [lens[place].astype("i8").tobytes()], "data": [np.ascontiguousarray(pdf[columns].to_numpy(float)[rows]).tobytes()],
                "weights": [np.stack([known[g] for g in games[place]]).tobytes() if known else None],
            })
            open_game = games[-1] if more else None
            for g in games[: len(games) - more]:
                known.pop(g, None)
            return out

        for pdf in batches:
            if "_h" in pdf:
                head = pdf[pdf["_h"] == 0]
                known.update({g: np.asarray(v, "u2") for g, v in zip(head[game], head["weights"])})
                pdf = pdf[pdf["_h"] == 1]
            pdf = pdf[[game, *columns]]
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            if not len(pdf):
                continue
            starts, lens = segments(pdf, [game])
            if lens[-1] > pack_rows:
                rest = None
                yield packed(pdf, True)
                continue
            if starts[-1]:
                yield packed(pdf.iloc[: starts[-1]], False)
            rest = pdf.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield packed(rest, False)

    return src.mapInPandas(run, "n int, first int, last int, lens binary, data binary, weights binary").persist()


@dataclass
class Fit:
    """Fitted vectors (one row each), their summed NLL, mean gradient norm, steps and whether it ended there."""

    theta: np.ndarray
    nll: np.ndarray
    slope: np.ndarray
    steps: np.ndarray
    converged: np.ndarray


def curvature(prepared: DataFrame, theta: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Hessian of the unweighted NLL by central differences of the gradient, in one job."""
    shift = step * np.eye(len(theta))
    _, g = likelihood(prepared, np.concatenate([theta + shift, theta - shift]))
    h = (g[: len(theta)] - g[len(theta) :]) / (2 * step)
    return (h + h.T) / 2


def _inverse(h: np.ndarray) -> np.ndarray:
    """A positive inverse: eigenvalues by size, small ones (the model's free scale) raised."""
    values, vectors = np.linalg.eigh(h)
    values = np.abs(values)
    return (vectors / np.maximum(values, 1e-6 * values.max())) @ vectors.T


def fit(prepared: DataFrame, start: np.ndarray, *, which: np.ndarray | None = None, inverse: np.ndarray | None = None, steps: int = 300, tolerance: float = 1e-5) -> Fit:
    """Minimise the summed NLL of each starting vector: BFGS with a halving line search.

    All vectors that go on share each Spark job, which evaluates one trial point of each.
    Without `which` all games count once.
    A vector has converged when no entry of its gradient per event exceeds `tolerance`;
    after `steps` jobs the rest is returned as it is, `converged` false.
    """
    theta = np.atleast_2d(np.asarray(start, float)).copy()
    n_vec, n_par = theta.shape
    which = None if which is None else np.asarray(which)
    events = prepared.agg(F.sum("n")).first()[0] or 1
    inv = np.repeat((_inverse(curvature(prepared, theta[0])) if inverse is None else inverse)[None], n_vec, axis=0)
    low, grad = likelihood(prepared, theta, which)
    size, taken = np.ones(n_vec), np.zeros(n_vec, int)
    slope = np.abs(grad).max(axis=1) / events
    for _ in range(steps):
        on = np.flatnonzero((slope > tolerance) & (size > 1e-9))
        if not len(on):
            break
        move = -np.einsum("rij,rj->ri", inv[on], grad[on])
        up = np.einsum("ri,ri->r", move, grad[on]) >= 0
        move[up] = -grad[on][up] / np.abs(grad[on][up]).max(axis=1, keepdims=True)  # no way down: along the gradient
        move *= np.minimum(1.0, 2.0 / np.abs(move).max(axis=1, keepdims=True))
        move *= size[on][:, None]
        nll, g = likelihood(prepared, theta[on] + move, None if which is None else which[on])
        good = np.isfinite(nll) & (nll <= low[on] + 1e-4 * np.einsum("ri,ri->r", move, grad[on]) + 1e-12 * np.abs(low[on]))
        for k, s, better, value, gradient in zip(on, move, good, nll, g):
            if not better:
                size[k] *= 0.3
                continue
            d = gradient - grad[k]
            sd = float(s @ d)
            if sd > 1e-10 * np.linalg.norm(s) * np.linalg.norm(d):
                left = np.eye(n_par) - np.outer(s, d) / sd
                inv[k] = left @ inv[k] @ left.T + np.outer(s, s) / sd
            theta[k], low[k], grad[k], size[k] = theta[k] + s, value, gradient, 1.0
            taken[k] += 1
        slope = np.abs(grad).max(axis=1) / events
    return Fit(theta, low, slope, taken, slope <= tolerance)


def bootstrap_weights(df: DataFrame, replicates: int, *, game: str = "gameid", seed: int = 11) -> DataFrame:
    """(game, weights): how often each game is drawn, with replacement, in each replicate.

    Draw i of replicate r takes the game whose number is a hash of (r, i). Draws are
    made and counted on the cluster.
    """
    games = df.select(game).distinct().withColumn("_g", F.pmod(F.xxhash64(game), F.lit(1024)))
    numbered = global_index(games, "_g", [game], "_i").select(game, "_i")
    n = numbered.count()
    draws = df.sparkSession.range(n * replicates).select(
        (F.col("id") % replicates).cast("int").alias("r"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("_i")
    )
    drawn = numbered.join(draws.groupBy("_i").agg(F.collect_list("r").alias("drawn")), "_i", "left").select(game, "drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                lists = part.column(1)
                rows = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                counts = np.bincount(rows * replicates + lists.flatten().to_numpy(), minlength=len(lists) * replicates)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * replicates, pa.int32()), pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), each], [game, "weights"])

    return drawn.mapInArrow(run, T.StructType([drawn.schema[game], T.StructField("weights", T.ArrayType(T.IntegerType()))]))


def bootstrap_effects(df: DataFrame, start: np.ndarray, *, replicates: int = 500, game: str = "gameid", batch: int = 250, **options) -> Fit:
    """The fit of every bootstrap replicate, warm-started from the fit of all games.

    `batch` replicates share each Spark job; their first step uses the curvature of the
    whole fit. Games are sorted and packed once, with their weights, for both.
    """
    ready = prepare(df, game=game, weights=bootstrap_weights(df, replicates, game=game))
    base = fit(ready, start, **options)
    inverse = _inverse(curvature(ready, base.theta[0]))
    found = []
    for k in range(0, replicates, batch):
        n = min(batch, replicates - k)
        found.append(fit(ready, np.repeat(base.theta, n, axis=0), which=np.arange(k, k + n), inverse=inverse, **options))
    ready.unpersist()
    return Fit(*(np.concatenate([getattr(f, name) for f in found]) for name in ("theta", "nll", "slope", "steps", "converged")))


def effects(theta: np.ndarray) -> np.ndarray:
    """The thirteen input effects of fitted vectors."""
    return np.atleast_2d(theta)[:, 1 : 1 + len(INPUTS)]


def half_life(a: Column) -> Column:
    return F.when((a > 0) & (a < 1), -F.ln(F.lit(2.0)) / F.ln(a)).otherwise(F.lit(float("inf")))


def response_area(a: Column, b: Column) -> Column:
    return F.when(a < 1, b / (1 - a)).otherwise(F.lit(float("inf")))


def impulse_response(effects: DataFrame, a: str, b: str, seconds: int = 180) -> DataFrame:
    """Effect b · a^t for t = 1 … seconds."""
    return effects.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(seconds)))).withColumn("response", F.col(b) * F.pow(F.col(a), F.col("t").cast("double")))


def team_summary(smoothed: DataFrame, plays: DataFrame, team: str) -> DataFrame:
    """Hits per game and mean smoothed momentum per team."""
    hits = plays.groupBy(team).agg((F.sum((F.col("type") == "hit").cast("bigint")) / F.count_distinct("gameid")).alias("hits_per_game"))
    mom = smoothed.groupBy(team).agg(F.avg("x_smooth").alias("momentum"))
    return hits.join(mom, team)


def goal_model(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """`p_goal`: probability of a goal soon from momentum and game state, and whether the fit `converged`.

    A row with a missing feature takes no part in the fit and has no probability.
    """
    kept = rows.dropna(subset=[*features, label]).withColumn("_one", F.lit(1.0))
    names = ["_one", *features]
    # each Newton step reads these few columns, not the rows' whole lineage
    data = kept.select(F.col(label), *names).persist()
    fit_ = fit_logits(data, label, {"goal": names})["goal"]
    data.unpersist()
    score = F.lit(float(fit_.theta[0]))
    for f, t in zip(features, fit_.theta[1:]):
        score = score + F.col(f) * float(t)
    return rows.withColumns({"p_goal": F.lit(1.0) / (1 + F.exp(-score)), "converged": F.lit(fit_.converged)})
