"""Window functions that do not put a whole key into one task.

A plain window sends every row of a partition key to one task. When a single
key can hold a large part of the data, pass `slice_by`: a column that cuts the
key's rows into consecutive pieces, increasing with the order (a date bucket, a
block of seconds), as a column or as SQL text. Each piece is then a window partition of its own. What a piece
needs from earlier ones is computed from one small row per piece and enters the
window as a header row in front of the piece, so the data is shuffled once and not
joined. The results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BEFORE = W.unboundedPreceding


def as_column(piece: Column | str) -> Column:
    """A column, or SQL text of one."""
    return F.expr(piece) if isinstance(piece, str) else piece


#: Rows that a task is meant to sort. Spark deals out small shuffles by their compressed bytes,
#: of which wide rows take twenty times as much once they are sorted.
TASK_ROWS = 100_000
#: Most tasks: to more partitions than this a shuffle is sorted by its writer, which holds its rows.
MOST_TASKS = 200


def tasks_for(rows: DataFrame, factor: int = 1) -> tuple[int | None, int]:
    """Tasks that share the sort of `factor` times as many rows as these (none where one task does), and the rows of a task."""
    n = min(-(-rows.count() * factor // TASK_ROWS), MOST_TASKS)
    return n if n > 1 else None, TASK_ROWS


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() for c in order]


def _as_columns(columns: Mapping[str, Column | str]) -> dict[str, Column]:
    return {out: F.col(m) if isinstance(m, str) else m for out, m in columns.items()}


def _with_headers(rows: DataFrame, headers: DataFrame, last: bool = False) -> DataFrame:
    """Rows and header rows in one table; `_h` puts headers first (or last) in a piece."""
    return rows.withColumn("_h", F.lit(1)).unionByName(headers.withColumn("_h", F.lit(2 if last else 0)), allowMissingColumns=True)


def context(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    totals: Mapping[str, Column | str] | None = None,
    totals_before: Mapping[str, Column | str] | None = None,
    carry: Mapping[str, Column | str] | None = None,
    carry_before: Mapping[str, Column | str] | None = None,
    previous: Mapping[str, Column | str] | None = None,
    following: Mapping[str, Column | str] | None = None,
    slice_by: Column | str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """All values that a row takes from its neighbours in one pass: one shuffle and one sort.

    `totals` are running sums (0 where nothing came yet), `carry` the last non-null
    values, `previous` and `following` the columns of the row before and after; `*_before`
    leave the current row out. Ask for everything at once: each call reads its input once for the rows and,
    when sliced, once for the per-piece aggregates. `tasks` (see `tasks_for`) shares out the sort.
    """
    groups = [(_as_columns(totals or {}), "t", 0), (_as_columns(totals_before or {}), "t", -1),
              (_as_columns(carry or {}), "c", 0), (_as_columns(carry_before or {}), "c", -1)]
    prev, after = _as_columns(previous or {}), _as_columns(following or {})
    inputs = {f"_ctx_{kind}_{o}": c for cols, kind, _ in groups for o, c in cols.items()}
    if prev:
        inputs["_ctx_p"] = F.struct(*[c.alias(o) for o, c in prev.items()])
    if after:
        inputs["_ctx_f"] = F.struct(*[c.alias(o) for o, c in after.items()])
    rows = df.withColumns(inputs)
    part, by = list(keys), _order(order)
    if slice_by is not None:
        rows = rows.withColumn("_slice", as_column(slice_by))
        rank = F.struct(*[F.col(c) for c in order])
        reduce_one = lambda n: F.sum(n) if n.startswith("_ctx_t_") else F.min_by(n, rank) if n == "_ctx_f" else F.max_by(n, rank if n == "_ctx_p" else F.when(F.col(n).isNotNull(), rank))
        pieces = W.partitionBy(*keys).orderBy("_slice")
        earlier = pieces.rowsBetween(BEFORE, -1)
        pass_on = lambda n: F.sum(n).over(earlier) if n.startswith("_ctx_t_") else F.lag(n).over(pieces) if n == "_ctx_p" else F.lead(n).over(pieces) if n == "_ctx_f" else F.last(n, ignorenulls=True).over(earlier)
        headers = (
            rows.groupBy(*keys, "_slice").agg(*[reduce_one(n).alias(n) for n in inputs])
            .select(*keys, "_slice", *[pass_on(n).alias(n) for n in inputs])
        )
        # the same header stands before a piece's rows and, where the next row is asked for, behind them
        headers = headers.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in ((0, 2) if after else (0,))])))
        rows = rows.withColumn("_h", F.lit(1)).unionByName(headers, allowMissingColumns=True)
        part, by = [*keys, "_slice"], [F.col("_h"), *by]
    if tasks is not None:
        rows = rows.repartition(tasks, *part)
    w = W.partitionBy(*part).orderBy(*by)
    made = {}
    for cols, kind, end in groups:
        frame = w.rowsBetween(BEFORE, end)
        for o in cols:
            n = f"_ctx_{kind}_{o}"
            made[o] = F.coalesce(F.sum(n).over(frame), F.lit(0)) if kind == "t" else F.last(n, ignorenulls=True).over(frame)
    if prev:
        made["_ctx_n"] = F.lag("_ctx_p").over(w)
    if after:
        made["_ctx_x"] = F.lead("_ctx_f").over(w)
    out = rows.withColumns(made)
    if slice_by is not None:
        out = out.filter(F.col("_h") == 1).drop("_h", "_slice")
    return out.withColumns({**{o: F.col(f"_ctx_n.{o}") for o in prev}, **{o: F.col(f"_ctx_x.{o}") for o in after}}).drop("_ctx_n", "_ctx_x", *inputs)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Column | str],
    *,
    include_current: bool = True,
    slice_by: Column | str | None = None,
) -> DataFrame:
    """Add running sums `{out: measure}` per key; nothing summed yet gives 0."""
    return context(df, keys, order, slice_by=slice_by, **{"totals" if include_current else "totals_before": measures})


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, Column | str],
    *,
    include_current: bool = True,
    slice_by: Column | str | None = None,
) -> DataFrame:
    """Add `{out: last non-null value so far}` per key."""
    return context(df, keys, order, slice_by=slice_by, **{"carry" if include_current else "carry_before": columns})


def since_marker(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    marker: Column,
    measures: Mapping[str, Column | str],
    *,
    slice_by: Column | str | None = None,
) -> DataFrame:
    """Add running sums `{out: measure}` since the last row of the key where `marker` holds (0 there).

    A sum is the total so far less the total at the marker. With slices both are taken
    within a piece first; one row per piece then tells what the piece goes on from, so the
    input is read twice, for the pieces and for the rows.
    """
    cols = _as_columns(measures)
    inputs = {f"_sm_{o}": F.when(marker, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))) for o, c in cols.items()}
    rows = df.withColumns(inputs).withColumn("_slice", F.lit(0) if slice_by is None else as_column(slice_by))
    w = W.partitionBy(*keys, "_slice").orderBy(*_order(order)).rowsBetween(BEFORE, 0)
    rows = rows.withColumns({f"_st_{o}": F.sum(f"_sm_{o}").over(w) for o in cols})
    rows = rows.withColumns({f"_sl_{o}": F.last(F.when(marker, F.col(f"_st_{o}")), ignorenulls=True).over(w) for o in cols})
    drop = ["_slice", *inputs, *[f"_{k}_{o}" for o in cols for k in ("st", "sl", "sc")]]
    if slice_by is None:
        return rows.withColumns({o: F.col(f"_st_{o}") - F.coalesce(f"_sl_{o}", F.lit(0)) for o in cols}).drop(*drop)
    rank = F.struct(*[F.col(c) for c in order])
    pieces = rows.groupBy(*keys, "_slice").agg(
        *[F.sum(f"_sm_{o}").alias(f"_p_{o}") for o in cols], *[F.max_by(f"_st_{o}", F.when(marker, rank)).alias(f"_m_{o}") for o in cols]
    )
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(BEFORE, -1)
    pieces = pieces.withColumns({f"_b_{o}": F.coalesce(F.sum(f"_p_{o}").over(before), F.lit(0)) for o in cols})
    # what has come since the last marker before the piece
    carry = {f"_sc_{o}": F.col(f"_b_{o}") - F.coalesce(F.last(F.col(f"_b_{o}") + F.col(f"_m_{o}"), ignorenulls=True).over(before), F.lit(0)) for o in cols}
    heads = pieces.withColumns(carry).select(*[F.col(k).alias(f"_h_{k}") for k in (*keys, "_slice")], *carry)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in (*keys, "_slice")])
    out = rows.join(heads, on).drop(*[f"_h_{k}" for k in (*keys, "_slice")])
    return out.withColumns({o: F.col(f"_st_{o}") - F.coalesce(f"_sl_{o}", -F.col(f"_sc_{o}")) for o in cols}).drop(*drop)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], depth: int, *, slice_by: Column | str | None = None) -> DataFrame:
    """Add `c_lag1` … `c_lagN`: the columns of the N rows before, null where there are fewer.

    With slices the rows before are looked up within a piece first; the last N rows of the pieces
    before come with one row per piece, so the input is read twice whatever N is.
    """
    rows = df.withColumn("_slice", F.lit(0) if slice_by is None else as_column(slice_by)).withColumn("_lg_0", F.struct(*columns))
    w = W.partitionBy(*keys, "_slice").orderBy(*_order(order))
    rows = rows.withColumns({**{f"_lg_{k}": F.lag("_lg_0", k).over(w) for k in range(1, depth + 1)}, "_lg_n": F.row_number().over(w)})
    found = {k: F.col(f"_lg_{k}") for k in range(1, depth + 1)}
    drop = ["_slice", "_lg_n", *[f"_lg_{k}" for k in range(depth + 1)]]
    if slice_by is not None:
        rank = F.struct(*[F.col(c) for c in order])
        last = F.array_compact(F.array(*[F.col(f"_lg_{k}") for k in range(depth)]))  # the newest first
        pieces = rows.groupBy(*keys, "_slice").agg(F.max_by(last, rank).alias("_last"))
        by_piece = W.partitionBy(*keys).orderBy("_slice")
        none = F.slice(F.col("_last"), 1, 0)
        before = F.slice(F.concat(*[F.coalesce(F.lag("_last", k).over(by_piece), none) for k in range(1, depth + 1)]), 1, depth)
        heads = pieces.select(*[F.col(k).alias(f"_h_{k}") for k in (*keys, "_slice")], before.alias("_lg_b"))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in (*keys, "_slice")])
        rows = rows.join(heads, on).drop(*[f"_h_{k}" for k in (*keys, "_slice")])
        found = {k: F.when(F.col("_lg_n") > k, c).otherwise(F.try_element_at("_lg_b", k - F.col("_lg_n") + 1)) for k, c in found.items()}
        drop.append("_lg_b")
    out = rows.withColumns({f"_lg_f{k}": c for k, c in found.items()})
    return out.withColumns({f"{c}_lag{k}": F.col(f"_lg_f{k}.{c}") for k in found for c in columns}).drop(*drop, *[f"_lg_f{k}" for k in found])


def neighbour_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, Column | str],
    *,
    ahead: bool = False,
    slice_by: Column | str | None = None,
) -> DataFrame:
    """Add `{out: value on the previous row}` (or the next row, with `ahead`).

    All columns come from one struct, so the window is evaluated once.
    """
    return context(df, keys, order, slice_by=slice_by, **{"following" if ahead else "previous": columns})


def range_frame(
    df: DataFrame,
    keys: Sequence[str],
    clock: str,
    low: int,
    high: int,
    aggregates: Mapping[str, Column],
    *,
    slice_width: int | None = None,
) -> DataFrame:
    """Aggregates over the rows whose clock lies in `[t+low, t+high]`, both ends closed.

    With `slice_width` the clock is cut into blocks; a row is also sent to the
    neighbouring blocks whose frames can reach it and dropped there afterwards.
    """
    if slice_width is None:
        w = W.partitionBy(*keys).orderBy(clock).rangeBetween(low, high)
        return df.withColumns({o: a.over(w) for o, a in aggregates.items()})

    def block(shift: int) -> Column:
        return F.floor((F.col(clock) - F.lit(shift)) / F.lit(slice_width))

    rows = df.withColumn("_own", block(0)).withColumn(
        "_slice", F.explode(F.sequence(block(max(high, 0)), block(min(low, 0))))
    )
    w = W.partitionBy(*keys, "_slice").orderBy(clock).rangeBetween(low, high)
    out = rows.withColumns({o: a.over(w) for o, a in aggregates.items()})
    return out.filter(F.col("_own") == F.col("_slice")).drop("_own", "_slice")


def global_index(df: DataFrame, coarse: str, order: Sequence[str], out: str, fine: Column | str | None = None) -> DataFrame:
    """Consecutive row numbers (from 0) over the whole table without one global sort.

    `coarse` is a column of few distinct values that leads the order (a date); `fine`
    cuts a coarse value further, increasing with the order, where one date may hold very
    many rows. Rows are counted per piece; only the counts per coarse value meet in one
    window, and a calendar bounds their number.
    """
    rows = df.withColumn("_fine", F.lit(0) if fine is None else as_column(fine))
    counts = rows.groupBy(coarse, "_fine").agg(F.count(F.lit(1)).alias("_n"))
    inside = W.partitionBy(coarse).orderBy("_fine").rowsBetween(BEFORE, -1)
    days = counts.groupBy(coarse).agg(F.sum("_n").alias("_t"))
    w = W.orderBy(coarse).rowsBetween(BEFORE, -1)
    days = days.select(F.col(coarse).alias("_d"), F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_off"))
    pieces = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(days, F.col(coarse).eqNullSafe(F.col("_d")))
    pieces = pieces.select(F.col(coarse).alias("_c"), F.col("_fine").alias("_f"), (F.col("_in") + F.col("_off")).alias("_start"))
    inner = W.partitionBy(coarse, "_fine").orderBy(*_order(order))
    return (
        rows.join(pieces, F.col(coarse).eqNullSafe(F.col("_c")) & F.col("_fine").eqNullSafe(F.col("_f")))
        .withColumn(out, F.col("_start") + F.row_number().over(inner) - 1)
        .drop("_c", "_f", "_start", "_fine")
    )


#: Rows that a slice of values is meant to hold; a key with fewer is not cut.
SLICE_ROWS = 1_000_000


def slices_needed(df: DataFrame, keys: Sequence[str], slice_rows: int) -> int:
    """Slices into which the largest key has to be cut; counted in one aggregation."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    return max(1, -(-most // slice_rows))


def value_slices(df: DataFrame, keys: Sequence[str], value: str, slices: int) -> DataFrame:
    """Add `_share_slice`: the block of a key's values a row falls into, of about equal size.

    The borders are approximate quantiles, so outliers do not gather the rest in one block. They
    are finer than the slices asked for; a value that fills a block alone cannot be cut.
    """
    if slices == 1:
        return df.withColumn("_share_slice", F.lit(0))
    shares = [i / (2 * slices) for i in range(1, 2 * slices)]
    spans = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), shares, max(1000, 20 * slices)).alias("_edges"))
    on = reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    wide = df.alias("h").join(spans.alias("s"), on).select("h.*", "_edges")
    below = F.size(F.filter("_edges", lambda e: e <= F.col(value).cast("double")))
    return wide.withColumn("_share_slice", F.greatest(F.coalesce(below, F.lit(0)), F.lit(0))).drop("_edges")


def ranked(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, *, descending: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Row number within the key by value (then `tie`, a number); no task sorts many more than `slice_rows` rows.

    A larger key counts its distinct values first: a row's number is the count of the values
    before plus its number among equal values, which are cut by `tie` where they are many.
    """
    by = -F.col(value) if descending else F.col(value)
    rows = df.withColumn("_by", by)
    if slices_needed(rows, keys, slice_rows) == 1:
        w = W.partitionBy(*keys).orderBy("_by", tie)
        return rows.withColumn(out, F.row_number().over(w)).drop("_by")
    hist = rows.groupBy(*keys, "_by").agg(F.count(F.lit(1)).alias("_n"))
    blocks = value_slices(hist, keys, "_by", slices_needed(hist, keys, slice_rows))
    offset = running_total(blocks, keys, ["_by"], {"_off": "_n"}, include_current=False, slice_by=F.col("_share_slice")).drop("_n", "_share_slice")
    on = reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_by")])
    wide = rows.alias("h").join(offset.alias("s"), on).select("h.*", "_off")
    equal = [*keys, "_by"]
    cut = value_slices(wide, equal, tie, slices_needed(rows, equal, slice_rows))
    run = running_total(cut, equal, [tie], {out: F.lit(1)}, slice_by=F.col("_share_slice"))
    return run.withColumn(out, (F.col(out) + F.col("_off")).cast("int")).drop("_by", "_off", "_share_slice")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    slice_rows: int = SLICE_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles `{out: p}` per key, exact and without big groups.

    Values are counted first; the cumulative counts run over blocks of about `slice_rows`
    distinct values, so no task sees all values of a large key and nothing is held in an
    aggregation buffer. `weight` names a column of repeat counts.
    """
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    hist = keyed.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")
    )
    slices = slices_needed(hist, by, slice_rows)
    if slices == 1:
        w = W.partitionBy(*by)
        cum = hist.withColumns({"_cum": F.sum("_n").over(w.orderBy("_v")), "_total": F.sum("_n").over(w)})
    else:
        total = hist.groupBy(*by).agg(F.sum("_n").alias("_total"))
        on = reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by])
        wide = value_slices(hist, by, "_v", slices).alias("h").join(total.alias("s"), on).select("h.*", "_total")
        cum = running_total(wide, by, ["_v"], {"_cum": "_n"}, slice_by=F.col("_share_slice"))
    aggs = []
    for out, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        at = lambda r: F.max(F.when((F.col("_cum") - F.col("_n") <= r) & (r < F.col("_cum")), F.col("_v")))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * frac).alias(out))
    return cum.groupBy(*by).agg(*aggs).drop("_all")
