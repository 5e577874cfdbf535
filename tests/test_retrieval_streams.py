"""Retrieval for tables of queries against plain loops; keyed state of a stream over many batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from icestats.operators import documents as X
from icestats.streaming import feeds as N


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else None


@pytest.mark.parametrize("per_pass", [512, 3])
def test_vector_search_for_a_table_of_queries(spark, monkeypatch, per_pass):
    monkeypatch.setattr(X, "QUERIES_PER_PASS", per_pass)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 6)).round(2)
    base[100:140] = base[7]  # ties at the border of a result
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0])]
    asked = [(k, rows[i][1]) for k, i in enumerate((7, 100, 3, 250, 60, 61))] + [(10, None), (11, [0.0] * 6), (12, [2.0, 4.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    got = [tuple(r) for r in X.vector_search_many(v, q, 5).select("query_id", "rank", "vec_id").collect()]
    want = []
    for k, e in asked:
        scored = [(cosine(np.float32(x), e), i) for i, x in rows if x is not None and e is not None and len(x) == len(e) and cosine(x, e) is not None]
        want += [(k, r, i) for r, (_, i) in enumerate(sorted(scored, key=lambda s: (-round(s[0], 9), s[1]))[:5], 1)]
    assert sorted(got) == sorted(want)
    assert X.vector_search_many(v.limit(0), q, 5).count() == 0 and X.vector_search_many(v, q.limit(0), 5).count() == 0


def chunk_rows(spark):
    texts = {1: "The rating method. License A", 2: "license license", 3: "elo rating system LICENSE", 4: "nothing", 5: "a license, created and designed"}
    rows = [(d, k, f"f{d}", t, [float(d), float(k), 1.0] if d != 4 else None) for d, t in texts.items() for k in (0, 1)]
    return spark.createDataFrame(rows, "document long, chunk_index int, file_name string, chunk_text string, embedding array<float>"), rows


def test_hybrid_search_takes_both_branches(spark):
    chunks, rows = chunk_rows(spark)
    asked = [(1, "licen", None), (2, None, [5.0, 0.0, 1.0]), (3, "LICEN", [1.0, 0.0, 0.0]), (4, "", [1.0, 1.0, 1.0]), (5, "absent", None), (6, None, None)]
    got = X.hybrid_search(chunks, spark.createDataFrame(asked, "query_id long, keyword string, query_vector array<double>"), 4)
    found = {}
    for r in got.collect():
        found.setdefault((r["query_id"], r["branch"]), {})[r["rank"]] = (r["document"], r["chunk_index"])
    by_word = sorted((r for r in rows if "licen" in r[3].lower()), key=lambda r: (-score(r[3]), r[0], r[1]))[:4]
    assert [found[1, "keyword"][k] for k in (1, 2, 3, 4)] == [r[:2] for r in by_word] == [found[3, "keyword"][k] for k in (1, 2, 3, 4)]
    for q, e in ((2, [5.0, 0.0, 1.0]), (4, [1.0, 1.0, 1.0])):
        near = sorted((r for r in rows if r[4]), key=lambda r: (-round(cosine(r[4], e), 9), r[0], r[1]))[:4]
        assert [found[q, "vector"][k] for k in (1, 2, 3, 4)] == [r[:2] for r in near]
    assert {q for q, _ in found} == {1, 2, 3, 4}
    context = {r["query_id"]: r["context"] for r in X.context_text(got, 2).collect()}
    assert context[1] == f"[Document 1: {by_word[0][2]}]\n{by_word[0][3]}\n\n---\n\n[Document 2: {by_word[1][2]}]\n{by_word[1][3]}"


def score(text):
    low = text.lower()
    return sum(w in low for w in X.EXPLANATORY) + 5 * any(p in low for p in X.PHRASES)


LINE = "gameid long, description string, partner string, updated timestamp_ntz, home_line long, away_line long"


def test_latest_lines_stay_bounded_and_survive_a_restart(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    rng = np.random.default_rng(6)
    frames, sizes = [], []
    for batch in range(12):
        n = 60
        frames.append(pd.DataFrame({
            "gameid": rng.integers(0, 8, n), "description": "d", "partner": "p", "updated": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**6, n), "s"),
            "home_line": rng.integers(-200, 200, n), "away_line": rng.integers(-200, 200, n),
        }))
        spark.createDataFrame(frames[-1], LINE).coalesce(1).write.mode("append").parquet(src)
        # each turn is a restart of the query from its checkpoint
        run = N.keep_latest_lines(N.file_stream(spark, src, spark.read.parquet(src).schema), state)
        run.awaitTermination()
        sizes.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = pd.concat(frames).sort_values(["updated", "home_line", "away_line"]).groupby("gameid").last()
    got = {r["gameid"]: (r["updated"], r["home_line"], r["away_line"]) for r in N.read_latest_lines(spark, state).collect()}
    assert got == {g: (r["updated"].to_pydatetime(), r["home_line"], r["away_line"]) for g, r in rows.iterrows()}
    assert N.read_latest_lines(spark, state).select(F.count(F.lit(1))).first()[0] == 8
    assert max(sizes) == 8  # as many rows as keys, whatever has come
