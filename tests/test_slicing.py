import numpy as np
import pytest
from pyspark.sql import functions as F

from icestats.plans import slicing as S


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds two thirds of the rows; a null key and null values are present."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else (None if i % 2 else f"k{i % 7}")
        data.append((i, key, int(rng.integers(0, 5000)), int(rng.integers(0, 9)) if i % 5 else None))
    return spark.createDataFrame(data, "id long, key string, t long, v long").cache()


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


SLICE = "floor(t / 300)"


@pytest.mark.parametrize("current", [True, False])
def test_running_total(rows, current):
    args = (["key"], ["t", "id"], {"s": "v", "n": F.lit(1)})
    same(S.running_total(rows, *args, include_current=current, slice_by=SLICE), S.running_total(rows, *args, include_current=current))


@pytest.mark.parametrize("current", [True, False])
def test_carry_last(rows, current):
    args = (["key"], ["t", "id"], {"last": "v"})
    same(S.carry_last(rows, *args, include_current=current, slice_by=SLICE), S.carry_last(rows, *args, include_current=current))


@pytest.mark.parametrize("slice_by", [None, SLICE, "floor(t / 40)"])
def test_since_marker(rows, slice_by):
    got = S.since_marker(rows, ["key"], ["t", "id"], F.col("id") % 7 == 0, {"s": "v", "n": F.lit(1)}, slice_by=slice_by)
    assert got.columns == [*rows.columns, "s", "n"]
    pdf = rows.toPandas().astype({"key": object}).sort_values(["t", "id"])
    want = {}
    for _, g in pdf.groupby("key", dropna=False):
        s = n = 0
        for i, v in zip(g["id"], g["v"]):
            s, n = (0, 0) if i % 7 == 0 else (s + (0 if v is None or np.isnan(v) else int(v)), n + 1)
            want[i] = (s, n)
    assert {r["id"]: (r["s"], r["n"]) for r in got.collect()} == want


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_since_marker_reads_its_input_twice(spark, tmp_path):
    spark.range(50).selectExpr("id % 3 AS key", "id AS t", "id AS v").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    assert scans(S.since_marker(df, ["key"], ["t"], F.col("v") % 5 == 0, {"s": "v"}, slice_by="floor(t / 10)")) == 2


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(rows, ahead):
    args = (["key"], ["t", "id"], {"nv": "v", "nid": "id"})
    same(S.neighbour_row(rows, *args, ahead=ahead, slice_by=SLICE), S.neighbour_row(rows, *args, ahead=ahead))


@pytest.mark.parametrize("slice_by", [None, SLICE, "floor(t / 40)"])
def test_lagged(rows, spark, tmp_path, slice_by):
    got = S.lagged(rows, ["key"], ["t", "id"], ["id", "v"], 3, slice_by=slice_by)
    assert got.columns == [*rows.columns, *[f"{c}_lag{k}" for k in (1, 2, 3) for c in ("id", "v")]]
    per, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r["t"], r["id"])):
        past = per.setdefault(r["key"], [])
        want[r["id"]] = [x for k in (1, 2, 3) for x in (past[-k] if len(past) >= k else (None, None))]
        past.append((r["id"], r["v"]))
    assert {r["id"]: list(r[4:]) for r in got.collect()} == want
    rows.write.parquet(str(tmp_path / "in"))
    assert scans(S.lagged(spark.read.parquet(str(tmp_path / "in")), ["key"], ["t", "id"], ["v"], 3, slice_by=SLICE)) == 2


def test_everything_in_one_pass(rows, spark, tmp_path):
    ask = dict(totals={"s": "v"}, totals_before={"b": "v"}, carry={"c": "v"}, previous={"p": "id"}, following={"f": "id", "fv": "v"})
    same(S.context(rows, ["key"], ["t", "id"], slice_by=SLICE, **ask), S.context(rows, ["key"], ["t", "id"], **ask))
    rows.write.parquet(str(tmp_path / "in"))
    assert scans(S.context(spark.read.parquet(str(tmp_path / "in")), ["key"], ["t", "id"], slice_by=SLICE, **ask)) == 2


@pytest.mark.parametrize("low,high", [(-90, 0), (1, 60), (-40, 40), (-700, -1)])
def test_range_frame(rows, low, high):
    args = (["key"], "t", low, high, {"s": F.sum("v"), "n": F.count(F.lit(1))})
    same(S.range_frame(rows, *args, slice_width=250), S.range_frame(rows, *args))


def test_exact_quantiles(rows):
    got = {r["key"]: r for r in S.exact_quantiles(rows, ["key"], "v", {"a": 0.0, "b": 0.4, "c": 0.95, "d": 1.0}, slice_rows=3).collect()}
    pdf = rows.toPandas()
    for key, r in got.items():
        v = pdf[pdf["key"].isna() if key is None else pdf["key"] == key]["v"].dropna()
        assert np.allclose([r["a"], r["b"], r["c"], r["d"]], np.quantile(v, [0, 0.4, 0.95, 1]))


def test_weighted_quantile_is_repeated_rows(spark):
    w = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 9.0, 2)], "k string, v double, n long")
    got = S.exact_quantiles(w, ["k"], "v", {"q": 0.7}, weight="n").first()["q"]
    assert got == pytest.approx(np.quantile([1, 1, 1, 5, 9, 9], 0.7))


def test_constant_value_quantile(spark):
    d = spark.createDataFrame([("a", 2.0)] * 5, "k string, v double")
    assert S.exact_quantiles(d, ["k"], "v", {"q": 0.3}).first()["q"] == 2.0


@pytest.mark.parametrize("fine", [None, "floor(id / 50)"])
def test_global_index(rows, fine):
    d = rows.withColumn("day", F.floor(F.col("t") / 1000))
    got = S.global_index(d, "day", ["id"], "i", fine).orderBy("day", "id").select("i").collect()
    assert [r["i"] for r in got] == list(range(600))


@pytest.mark.parametrize("slice_rows", [10**6, 40])
def test_ranked(rows, slice_rows):
    d = rows.filter("v is not null and key is not null")
    got = S.ranked(d, ["key"], "v", "id", "r", slice_rows=slice_rows).toPandas()
    assert len(got) == d.count()
    for _, g in got.groupby("key"):
        assert list(g.sort_values(["v", "id"], ascending=[False, True])["r"]) == list(range(1, len(g) + 1))


def test_slices_of_skewed_values_are_bounded(spark):
    """A third of the rows has one value, another third lies within a thousandth of the range."""
    rng = np.random.default_rng(2)
    v = np.concatenate([np.full(3000, 7.0), 1 + rng.random(3000) / 1000, rng.random(3000) * 1000])
    d = spark.createDataFrame([("k", int(i), float(x)) for i, x in enumerate(v)], "key string, id long, v double")
    hist = d.groupBy("key", "v").count()
    need = S.slices_needed(hist, ["key"], 300)
    sizes = [r["count"] for r in S.value_slices(hist, ["key"], "v", need).groupBy("_share_slice").count().collect()]
    assert need == 21 and max(sizes) <= 300
    ties = d.filter("v = 7")
    sizes = [r["count"] for r in S.value_slices(ties, ["key", "v"], "id", S.slices_needed(ties, ["key", "v"], 300)).groupBy("_share_slice").count().collect()]
    assert max(sizes) <= 300
    got = S.ranked(d, ["key"], "v", "id", "r", descending=False, slice_rows=300).toPandas().sort_values(["v", "id"])
    assert list(got["r"]) == list(range(1, 9001))


def test_sort_of_enriched_events_is_shared_out_by_rows(spark, monkeypatch):
    from icestats.operators import sequence as Q

    plays = spark.range(400).selectExpr(
        "id % 40 AS gameid", "id AS event_id", "1L AS period", "id AS elapsed", "'goal' AS type", "'HOM' AS owner", "'O' AS zone", "id AS shooter_id",
        "id AS blocker_id", "id AS committed_id", "id AS drawn_id", "1L AS duration")
    roster = spark.createDataFrame([(1, 1, "HOM")], "gameid long, player_id long, team string")
    whole = Q.enrich(plays, roster, "floor(elapsed / 100)")
    want = sorted(map(repr, whole.collect()))
    monkeypatch.setattr(S, "TASK_ROWS", 20)
    shared = Q.enrich(plays, roster, "floor(elapsed / 100)")
    assert whole.rdd.getNumPartitions() < 20 == shared.rdd.getNumPartitions()
    assert sorted(map(repr, shared.collect())) == want


def test_latest_lines_are_sorted_in_as_many_tasks_as_asked(spark):
    from icestats.operators import market as M

    odds = spark.range(300).selectExpr("id % 60 AS gameid", "concat('d', id % 60 % 2) AS description", "concat('p', id % 60 % 3) AS partner", "id AS updated", "id AS home_line", "-id AS away_line",
                                       "2020 AS season", "'A' AS home", "'B' AS away")
    games = spark.range(60).selectExpr("id AS gameid", "2020 AS season", "'A' AS home", "'B' AS away", "DATE'2020-01-01' AS game_date", "1 AS home_goals")
    for ask in (lambda n: M.latest_lines(odds, tasks=n), lambda n: M.odds_with_outcomes(odds, games, n)):
        assert sorted(map(repr, ask(12).select("gameid", "updated", "home_line").collect())) == sorted(map(repr, ask(None).select("gameid", "updated", "home_line").collect()))
    assert M.latest_lines(odds, tasks=12).rdd.getNumPartitions() == 12
