"""Forecast scoring and tests.

Regressions need sums of products only. Spark aggregates them; the driver solves
systems of two to five unknowns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from icestats.functions.scalars import bucket
from icestats.functions.tails import chi2_tail, normal_tail, t_tail_column
from icestats.plans.slicing import exact_quantiles, global_index

EPS = 1e-15


def brier(y: Column, p: Column) -> Column:
    return F.pow(y.cast("double") - p, F.lit(2.0))


def log_loss(y: Column, p: Column) -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def scoring_table(df: DataFrame, y: str, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Brier score and log loss per model, as rows."""
    cols = [c for m in models for c in (F.avg(brier(F.col(y), F.col(m))).alias(f"{m}|b"), F.avg(log_loss(F.col(y), F.col(m))).alias(f"{m}|l"))]
    wide = df.groupBy(*keys).agg(*cols)
    items = [F.struct(F.lit(m).alias("model"), F.col(f"`{m}|b`").alias("brier"), F.col(f"`{m}|l`").alias("log_loss")) for m in models]
    return wide.select(*keys, F.inline(F.array(*items)))


def _moments(df: DataFrame, names: Sequence[str], weight: Column | None = None) -> np.ndarray:
    """Σ w · v vᵀ over the named columns (with a leading 1) in one aggregation."""
    cols = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"m{i}_{j}"] or 0.0
    return out


def _linear(theta: Sequence[float], xs: Sequence[str]) -> Column:
    out = F.lit(float(theta[0]))
    for t, x in zip(theta[1:], xs):
        out = out + F.col(x) * float(t)
    return out


def robust_ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """OLS with heteroskedasticity-robust (HC1) errors; one row per coefficient."""
    rows = df.dropna(subset=[y, *xs])
    k = len(xs) + 1
    m = _moments(rows, [*xs, y])
    n, xtx, xty, tss = m[0, 0], m[:k, :k], m[:k, k], m[k, k] - m[0, k] ** 2 / m[0, 0]
    bread = np.linalg.inv(xtx)
    theta = bread @ xty
    e = F.col(y) - _linear(theta, xs)
    meat = _moments(rows, list(xs), e * e)
    cov = bread @ meat @ bread * n / (n - k)
    rss = m[k, k] - theta @ xty
    se = np.sqrt(np.diag(cov))
    out = [
        (name, float(b), float(s), float(b / s), normal_tail(b / s), int(n), float(1 - rss / tss))
        for name, b, s in zip(["const", *xs], theta, se)
    ]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, z double, p double, n long, r2 double"), cov


def forecast_encompassing(df: DataFrame, y: str, models: Sequence[str]) -> DataFrame:
    """Regression of the outcome on several forecasts at once."""
    return robust_ols(df, y, models)[0]


def mincer_zarnowitz(df: DataFrame, y: str, p: str) -> DataFrame:
    """Outcome on forecast with the joint test of intercept 0 and slope 1."""
    table, cov = robust_ols(df, y, [p])
    (a, b) = [r["coef"] for r in table.select("coef").collect()]
    gap = np.array([a, b - 1.0])
    wald = float(gap @ np.linalg.solve(cov, gap))
    return table.withColumns({"wald": F.lit(wald), "wald_p": F.lit(chi2_tail(wald, 2))})


def _two_step(zx: np.ndarray, zy: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cov = np.linalg.inv(zx.T @ w @ zx)
    return cov @ (zx.T @ w @ zy), cov


def gmm_efficiency(df: DataFrame, y: str, p: str, instruments: Sequence[str]) -> DataFrame:
    """Two-step GMM of outcome on forecast with extra instruments, and its J statistic."""
    rows = df.withColumn("_p2", F.col(p) * F.col(p)).dropna(subset=[y, p, *instruments])
    zs = [p, "_p2", *instruments]
    q = len(zs) + 1
    m = _moments(rows, [*zs, y])
    zz, zx, zy = m[:q, :q], m[:q, :2], m[:q, q]
    theta, _ = _two_step(zx, zy, np.linalg.inv(zz))
    e = F.col(y) - _linear(theta, [p])
    s = _moments(rows, zs, e * e)
    w2 = np.linalg.inv(s)
    theta, cov = _two_step(zx, zy, w2)
    g = zy - zx @ theta
    j, df_j = float(g @ w2 @ g), q - 2
    out = [(float(theta[0]), float(theta[1]), float(np.sqrt(cov[1, 1])), j, chi2_tail(j, df_j), df_j, int(m[0, 0]))]
    return df.sparkSession.createDataFrame(out, "alpha double, beta double, beta_se double, j double, j_p double, df int, n long")


def rolling_gmm(
    df: DataFrame, y: str, p: str, instruments: Sequence[str], *, date: str, order: Sequence[str], window: int = 50, chunk: int = 5000,
    fine: Column | str | None = None,
) -> DataFrame:
    """Two-step GMM over every run of `window` consecutive games.

    Rows are numbered globally and cut into chunks; the last rows of a chunk also go
    to the next one, so each chunk is solved on its own and no group is unbounded.
    Singular windows are left out. `date` is the last date inside the window.
    """
    rows = df.dropna(subset=[y, p, *instruments])
    ix = global_index(rows, date, order, "_i", fine)
    w = F.lit(window)
    # window ending before row i covers i-window .. i-1; the chunk of i needs them all
    last = ix.agg(F.max("_i")).scalar()
    span = ix.withColumn("_c", F.explode(F.sequence(F.floor((F.col("_i") + 1) / chunk), F.floor((F.col("_i") + w) / chunk))))
    span = span.select("_c", "_i", F.col(date).alias("last_date"), F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(instruments)], last.alias("_last"))
    zs = [f"_z{i}" for i in range(len(instruments))]
    date_type = df.schema[date].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        i = pdf["_i"].to_numpy()
        c, end = int(pdf["_c"].iloc[0]), int(pdf["_last"].iloc[0])
        z = np.column_stack([np.ones(len(pdf)), pdf["_p"], pdf["_p"] ** 2, *[pdf[k] for k in zs]]).astype(float)
        yv, x = pdf["_y"].to_numpy(float), z[:, :2]
        starts = np.arange(max(0, len(pdf) - window + 1))
        target = i[starts + window - 1] + 1 if len(starts) else np.array([], int)
        starts = starts[(target // chunk == c) & (target <= end)]
        names = ["i", "last_date", "alpha", "beta", "beta_se"]
        if not len(starts):
            return pd.DataFrame({n: [] for n in names})
        view = np.lib.stride_tricks.sliding_window_view

        def fit(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """All windows starting at `at` together, as stacked small matrices."""
            zw = view(z, window, axis=0)[at]  # windows × instruments × rows
            yw = view(yv, window)[at][..., None]
            zz, zy = zw @ zw.transpose(0, 2, 1), zw @ yw
            zx = zz[:, :, :2]

            def gmm(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                cov = np.linalg.inv(zx.transpose(0, 2, 1) @ w @ zx)
                return cov @ (zx.transpose(0, 2, 1) @ w @ zy), cov

            first, _ = gmm(np.linalg.inv(zz))
            e = yw[..., 0] - first[:, :1, 0] - first[:, 1:, 0] * zw[:, 1, :]
            return gmm(np.linalg.inv((zw * (e * e)[:, None, :]) @ zw.transpose(0, 2, 1)))

        theta, cov, kept = [], [], []
        for lo in range(0, len(starts), 512):
            part = starts[lo : lo + 512]
            try:
                groups = [(part, fit(part))]
            except np.linalg.LinAlgError:
                groups = []
                for one in part:
                    try:
                        groups.append((np.array([one]), fit(np.array([one]))))
                    except np.linalg.LinAlgError:
                        continue
            for at, (t, v) in groups:
                kept.append(at), theta.append(t[..., 0]), cov.append(v[:, 1, 1])
        if not kept:
            return pd.DataFrame({n: [] for n in names})
        at, t, v = np.concatenate(kept) + window - 1, np.concatenate(theta), np.concatenate(cov)
        return pd.DataFrame({
            "i": i[at] + 1, "last_date": pdf["last_date"].to_numpy()[at], "alpha": t[:, 0], "beta": t[:, 1],
            "beta_se": np.sqrt(np.where(v > 0, v, np.nan)),
        })

    return span.groupBy("_c").applyInPandas(solve, f"i long, last_date {date_type}, alpha double, beta double, beta_se double")


def efficiency_score(alpha: Column, beta: Column) -> Column:
    """1 less the distance of slope from one and intercept from zero."""
    return F.lit(1.0) - F.abs(beta - 1) - F.abs(alpha)


def diebold_mariano(df: DataFrame, y: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean loss difference, its t statistic and p-value for each pair of forecasts."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        d = brier(F.col(y), F.col(a)) - brier(F.col(y), F.col(b))
        aggs += [F.avg(d).alias(f"d{i}"), F.stddev_samp(d).alias(f"s{i}"), F.count(d).alias(f"n{i}")]
    wide = df.agg(*aggs)
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"d{i}").alias("mean_diff"),
                 (F.col(f"d{i}") / (F.col(f"s{i}") / F.sqrt(F.col(f"n{i}")))).alias("t"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)
    ])))
    return rows.withColumn("p", t_tail_column(F.col("t"), (F.col("n") - 1).cast("double")))


def calibration_curve(df: DataFrame, y: str, p: str, *, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean forecast and outcome share in equal-count bins of the forecast (right-closed)."""
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    by = list(keys) or ["_k"]
    rows = df if keys else df.withColumn("_k", F.lit(1))
    edges = exact_quantiles(rows, by, p, probs)
    got = rows.join(edges, by)
    n_below = sum((F.when(F.col(f"e{i}") < F.col(p), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return got.groupBy(*by, n_below.alias("bin")).agg(
        F.avg(p).alias("mean_forecast"), F.avg(F.col(y).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")
    ).drop("_k")


# Season segments by game number
SEGMENT_EDGES, SEGMENT_NAMES = (0, 25, 55, 82), ("early", "middle", "late")


def segment_calibration(df: DataFrame, y: str, p: str, game_no: str, bins: int = 10) -> DataFrame:
    """Calibration per season segment; game numbers outside of them form the segment `other`."""
    seg = df.withColumn("segment", F.coalesce(bucket(F.col(game_no), SEGMENT_EDGES, SEGMENT_NAMES), F.lit("other")))
    return calibration_curve(seg, y, p, keys=["segment"], bins=bins)


def range_histogram(df: DataFrame, p: str, edges: Sequence[float]) -> DataFrame:
    """Counts of forecasts in fixed right-closed ranges."""
    labels = [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    return df.groupBy(bucket(F.col(p), edges, labels).alias("range")).agg(F.count(F.lit(1)).alias("n"))


def rolling_scores(df: DataFrame, y: str, models: Sequence[str], *, keys: Sequence[str], game_no: str, window: int = 10) -> DataFrame:
    """Brier score over the last `window` game numbers; sums are taken per game number first."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), brier(F.col(y), F.col(m)).alias("b")) for m in models])
    per = df.select(*keys, F.col(game_no).alias("game_no"), F.inline(items)).groupBy(*keys, "model", "game_no").agg(
        F.sum("b").alias("s"), F.count("b").alias("n")
    )
    w = W.partitionBy(*keys, "model").orderBy("game_no").rangeBetween(-(window - 1), 0)
    return per.select(*keys, "model", "game_no", (F.sum("s").over(w) / F.sum("n").over(w)).alias("brier"))


def frontier(metrics: DataFrame, forecasts: DataFrame, measure: str, p: str) -> DataFrame:
    """Season measure of each team against its mean market probability."""
    sides = forecasts.select("season", F.inline(F.array(
        F.struct(F.col("home").alias("team"), F.col(p).alias("_p")), F.struct(F.col("away").alias("team"), (1 - F.col(p)).alias("_p"))
    )))
    market = sides.groupBy("season", "team").agg(F.avg("_p").alias("mean_market"))
    return metrics.select("season", "team", measure).join(market, ["season", "team"])


def better_measure_won(rows: DataFrame, measures: Mapping[str, tuple[Column, Column]], win_home: Column, keys: Sequence[str]) -> DataFrame:
    """How often the side with the better measure won: share, count and standard error in percent."""
    hit = lambda h, a: ((h >= a) == win_home).cast("double")
    wide = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(hit(h, a)).alias(f"p_{m}") for m, (h, a) in measures.items()]
    )
    items = [F.struct(F.lit(m).alias("measure"), (F.col(f"p_{m}") * 100).alias("ratio"),
                      (F.sqrt(F.col(f"p_{m}") * (1 - F.col(f"p_{m}")) / F.col("n")) * 100).alias("se")) for m in measures]
    return wide.select(*keys, "n", F.inline(F.array(*items)))


def classification_report(df: DataFrame, y: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support for both classes from four counts."""
    t, p = F.col(y) == 1, F.col(predicted) == 1
    c = lambda cond, n: F.sum(cond.cast("bigint")).alias(n)
    counts = df.groupBy(*keys).agg(c(t & p, "tp"), c(~t & p, "fp"), c(t & ~p, "fn"), c(~t & ~p, "tn"))

    def row(label: str, hit: str, wrong: str, missed: str) -> Column:
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return F.struct(
            F.lit(label).alias("class"), F.round(F.coalesce(F.try_divide(h, h + w), F.lit(0.0)), 3).alias("precision"),
            F.round(F.coalesce(F.try_divide(h, h + m), F.lit(0.0)), 3).alias("recall"),
            F.round(F.coalesce(F.try_divide(h * 2, h * 2 + w + m), F.lit(0.0)), 3).alias("f1"), (h + m).alias("support"),
        )

    return counts.select(*keys, F.inline(F.array(row("win", "tp", "fp", "fn"), row("loss", "tn", "fn", "fp"))))


def _both(c: str) -> tuple[str, str]:
    return c, f"{c}_against"


# The predictors' feature sets, over the season first, over the games so far below
KPI_SETS: dict[str, tuple[str, ...]] = {
    "win_rate": _both("kpi_wp"), "win_rate_difference": ("kpi_wp_diff",), "expectation": _both("kpi_pe"), "corsi": _both("corsi"), "corsi_level": ("corsi_lvl",),
    "fenwick": _both("fenwick"), "fenwick_level": ("fenwick_lvl",), "rpi": _both("rpi"), "pairwise": _both("pairwise_win"), "opponent": ("opponent_good", "opponent_better"),
    "opponent_and_rates": ("opponent_good", "opponent_better", *_both("kpi_wp"), *_both("kpi_pe")),
    "running_expectation": (*_both("rpe"), "rgame"), "last_ten_expectation": (*_both("rpe_10"), "rgame"), "running_win_rate": (*_both("rwp"), "rgame"),
    "running_fenwick": (*_both("rff_pct"), "rgame"), "running_corsi": (*_both("rcf_pct"), "rgame"),
}


@dataclass
class Logit:
    """One fitted set: coefficients, mean loss, largest entry of the mean gradient, and whether it ended there."""

    features: tuple[str, ...]
    theta: np.ndarray
    loss: float = np.inf
    slope: float = np.inf
    converged: bool = False


#: A mean loss below this has no finite optimum: a feature tells the classes apart.
SEPARATED = 1e-6


#: Rows in a packed row, and bytes of packed rows that go to a Python worker at once.
PACK_ROWS, BATCH_BYTES = 10_000, "4m"


@contextmanager
def _small_batches(df: DataFrame) -> Iterator[None]:
    """Spark fills an Arrow batch up to 64 MB; a task holds each several times, in the JVM's buffers and in Python."""
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(size, None)
    conf.set(size, BATCH_BYTES)
    try:
        yield
    finally:
        conf.unset(size) if before is None else conf.set(size, before)


def _packed(data: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """Label and features as rows of packed numbers, gaps in features as 0; kept on disk, as the executors' memory is the tasks'."""
    rows = data.select(F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names])
    size = PACK_ROWS

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), size):
                part = pdf[["label", *names]].iloc[low : low + size].to_numpy(float)
                yield pd.DataFrame({"n": [len(part)], "data": [np.ascontiguousarray(part.T).tobytes()]})

    # every step reads plain numbers instead of converting the columns again
    return rows.mapInPandas(pack, "n int, data binary").persist(StorageLevel.DISK_ONLY)


def fit_logits(
    data: DataFrame, label: str, sets: Mapping[str, Sequence[str]], *, steps: int = 60, tolerance: float = 1e-9, packed: DataFrame | None = None
) -> dict[str, Logit]:
    """Logistic models without intercept for several feature sets, all in one job per Newton step.

    Each task returns loss, gradient and Hessian sums keyed by set. A step that does not
    lower the loss is halved. A set has converged when its Newton decrement per row is
    below `tolerance`; one whose classes a feature separates never does. Who reads the rows again
    passes them in as `packed`.
    """
    names = sorted({f for fs in sets.values() for f in fs})
    places = [np.array([names.index(f) for f in fs]) for fs in sets.values()]
    own = packed is None
    packed = _packed(data, label, names) if own else packed

    def sums(thetas: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {k: np.zeros(2 + len(t) + len(t) ** 2) for k, t in thetas.items()}
            for pdf in batches:
                for data in pdf["data"]:
                    y, *x = np.frombuffer(data).reshape(len(names) + 1, -1)
                    for k, t in thetas.items():
                        own = np.stack([x[i] for i in places[k]])
                        z = t @ own
                        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                        hess = (own * (p * (1 - p))) @ own.T
                        total[k] += np.concatenate([[len(y), np.sum(np.logaddexp(0, z) - y * z)], own @ (p - y), hess.ravel()])
            yield pd.DataFrame([(k, i, v) for k, t in total.items() for i, v in enumerate(t)], columns=["k", "i", "v"])

        with _small_batches(packed):
            got = packed.mapInPandas(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
        return {k: part.sort_values("i")["v"].to_numpy() for k, part in got.groupby("k")}

    fits = [Logit(tuple(fs), np.zeros(len(fs))) for fs in sets.values()]
    move = {k: np.zeros(len(f.theta)) for k, f in enumerate(fits)}
    for _ in range(steps):
        got = sums({k: fits[k].theta + m for k, m in move.items()})
        for k, v in got.items():
            f, d = fits[k], len(fits[k].theta)
            n, loss, grad, hess = v[0], v[1], v[2 : 2 + d], v[2 + d :].reshape(d, d)
            if not loss <= f.loss * n + 1e-12 * abs(loss):
                move[k] = move[k] / 2
                continue
            newton = -np.linalg.lstsq(hess + 1e-12 * np.trace(hess) * np.eye(d), grad, rcond=None)[0]
            f.theta, f.loss, f.slope = f.theta + move[k], float(loss / n), float(np.abs(grad).max() / n)
            f.converged = bool(-(newton @ grad) / n <= tolerance and f.loss > SEPARATED)
            move[k] = newton
        move = {k: m for k, m in move.items() if k in got and not fits[k].converged}
        if not move:
            break
    if own:
        packed.unpersist()
    return dict(zip(sets, fits))


def win_predictors(df: DataFrame, y: str, sets: Mapping[str, Sequence[str]] = KPI_SETS, **options) -> DataFrame:
    """Logit without intercept per feature set (gaps count as 0) with its classification report.

    (features, class, precision, recall, f1, support, loss, slope, converged); all sets share
    each pass over the rows, the reports one more.
    """
    names = sorted({f for fs in sets.values() for f in fs})
    data = df.select(F.col(y).cast("int").alias("label"), *names)
    packed = _packed(data, "label", names)
    fits = fit_logits(data, "label", sets, packed=packed, **options)
    weights = [[(names.index(c), float(t)) for c, t in zip(f.features, f.theta)] for f in fits.values()]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                label, *x = np.frombuffer(data).reshape(len(names) + 1, -1)
                out = {"label": label}
                for k, terms in enumerate(weights):
                    score = np.zeros(len(label))
                    for i, t in terms:
                        score = score + x[i] * t
                    out[f"p{k}"] = (~(score < 0)).astype("i1")  # Spark orders NaN last
                yield pd.DataFrame(out)

    called = packed.mapInPandas(call, ", ".join(["label double", *[f"p{k} tinyint" for k in range(len(fits))]]))
    calls = [F.struct(F.lit(name).alias("features"), F.col(f"p{k}").cast("int").alias("pred")) for k, name in enumerate(fits)]
    hit = called.select(F.col("label").cast("int").alias("label"), F.inline(F.array(*calls)))
    report = classification_report(hit, "label", "pred", ["features"]).persist()
    with _small_batches(packed):
        report.count()
    packed.unpersist()
    about = df.sparkSession.createDataFrame([(n, f.loss, f.slope, f.converged) for n, f in fits.items()], "features string, loss double, slope double, converged boolean")
    return report.join(about, "features")
