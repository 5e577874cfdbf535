"""Queries of momentum and documents."""

import numpy as np
from pyspark.sql import functions as F

from icestats.operators import documents as X
from icestats.operators import momentum as Z
from icestats.operators import sequence as Q
from icestats.registry.base import query
from icestats.registry.sequence import BLOCK, DAY, PRIORS, SCORE, WIDTH, flag
from icestats.registry.sequence import master as sequence_master
from icestats.registry.teams import r6

col = F.col


def demo_params():
    b = [0.05 * (i % 5 - 2) for i in range(len(Z.INPUTS))]
    return Z.MomentumParams(a0=3.0, b=b, c=-0.5, d=[0.1, 0.05, -0.02, 0.03], alpha=0.1, beta=0.2)


def master(t):
    """Model rows: gaps in days of a surrogate clock, zone share as the observation, priors of the game."""
    return sequence_master(t).withColumns({"dt": col("dt") / F.lit(float(DAY)), "y": col("zone_share")})


def _sum_of(names, weights, sql):
    return " + ".join(f"({w}) * {sql[n]}" for n, w in zip(names, weights))


FLAGS = {
    **{f"hit_{n}_{z}": flag("hit", w, z) for n, w in (("for", "="), ("against", "<>")) for z in "ODN"},
    "shot_for": flag("shot-on-goal", "="), "shot_against": flag("shot-on-goal", "<>"), "takeaway": flag("takeaway", "="),
    "giveaway": flag("giveaway", "="), "block_for": flag("blocked-shot", "="), "block_against": flag("blocked-shot", "<>"), "faceoff_win": flag("faceoff", "="),
}
P = demo_params()
# the model as a recursion over the event number, all games side by side
FILTER = f"""{SCORE}, {PRIORS}, mm AS (SELECT p.gameid, p.event_id, owner, type, row_number() OVER w AS rn, {_sum_of(Z.INPUTS, P.b, FLAGS)} AS bu,
 sum(CASE WHEN owner = 'HOM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER v / count(*) OVER v AS y, CAST(elapsed - lag(elapsed, 1, 0) OVER w AS DOUBLE) / {DAY} AS dt,
 0.1::DOUBLE + 0.05::DOUBLE * coalesce(dp, 0) - 0.02::DOUBLE * coalesce(ds, 0) + 0.03::DOUBLE * greatest(-2, least(2, gf - ga)) AS dz, 0.1::DOUBLE + 0.2::DOUBLE * coalesce(dp, 0) AS mu
 FROM plays p JOIN sc ON sc.event_id = p.event_id LEFT JOIN pri ON pri.gameid = p.gameid WINDOW w AS (PARTITION BY p.gameid ORDER BY elapsed, p.event_id), v AS (PARTITION BY p.gameid ORDER BY elapsed RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)),
kf AS (SELECT gameid, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0.0::DOUBLE AS dt, 0.0::DOUBLE AS xp, 0.0::DOUBLE AS pp, mu AS x, 1.0::DOUBLE AS p, 0.0::DOUBLE AS nll FROM mm WHERE rn = 1
 UNION ALL SELECT gameid, rn, event_id, dt, xp, pp, xp + pp * c / s * (y - c * xp - dz), (1 - pp * c * c / s) * pp, 0.5 * (ln(s) + pow(y - c * xp - dz, 2) / s)
 FROM (SELECT *, c * c * pp + exp(-1) AS s FROM (SELECT m.gameid, m.rn, m.event_id, m.dt, m.y, m.dz, exp(-0.5) AS c, pow({P.decay!r}, m.dt) * k.x + m.bu AS xp, pow({P.decay!r}, 2 * m.dt) * k.p + exp(-2) AS pp FROM kf k JOIN mm m ON m.gameid = k.gameid AND m.rn = k.rn + 1)))"""
SMOOTH = FILTER + f""", fl AS (SELECT *, max(rn) OVER (PARTITION BY gameid) AS n FROM kf WHERE rn > 0),
sm AS (SELECT gameid, rn, event_id, x, x AS xs, p AS ps, xp, pp, dt FROM fl WHERE rn = n
 UNION ALL SELECT f.gameid, f.rn, f.event_id, f.x, f.x + f.p * pow({P.decay!r}, s.dt) / s.pp * (s.xs - s.xp), f.p + pow(f.p * pow({P.decay!r}, s.dt) / s.pp, 2) * (s.ps - s.pp), f.xp, f.pp, f.dt
 FROM sm s JOIN fl f ON f.gameid = s.gameid AND f.rn = s.rn - 1)"""


@query("momentum_filter_i7", f"WITH RECURSIVE {FILTER} SELECT event_id, round(xp, 6) AS x_pred, round(pp, 6) AS p_pred, round(x, 6) AS x_filt, round(p, 6) AS p_filt, round(nll, 6) AS nll FROM kf WHERE rn > 0")
def _(t):
    return Z.kalman_filter(master(t), demo_params(), slice_by=BLOCK).select("event_id", *r6("x_pred", "p_pred", "x_filt", "p_filt", "nll"))


@query("momentum_smoother_i8", f"WITH RECURSIVE {SMOOTH} SELECT event_id, round(x, 6) AS x_filt, round(xs, 6) AS x_smooth, round(ps, 6) AS p_smooth FROM sm")
def _(t):
    return smoothed(master(t)).select("event_id", *r6("x_filt", "x_smooth", "p_smooth"))


def smoothed(rows):
    p = demo_params()
    return Z.rts_smoother(Z.kalman_filter(rows, p, slice_by=BLOCK), p, slice_by=BLOCK)


NAMES = ("decay", *Z.INPUTS, "log_loading", *(f"covariate_{c}" for c in Z.COVARIATES), "log_state_noise", "log_noise", "log_start_variance", "start_home", "start_prior")


@query("momentum_fit_i9")
def _(t):
    ready = Z.prepare(master(t))
    f = Z.fit(ready, demo_params().vector())
    ready.unpersist()
    rows = [(n, float(v), float(f.nll[0]), float(f.slope[0]), int(f.steps[0]), bool(f.converged[0])) for n, v in zip(NAMES, f.theta[0])]
    return t.spark.createDataFrame(rows, "parameter string, estimate double, nll double, slope double, steps int, converged boolean")


@query("momentum_bootstrap_i10")
def _(t):
    f = Z.bootstrap_effects(master(t), demo_params().vector(), replicates=500, batch=500, tolerance=1e-4, steps=60)
    low, high = np.quantile(Z.effects(f.theta), [0.025, 0.975], axis=0)
    rows = [(n, float(a), float(b), len(f.theta), int(f.converged.sum())) for n, a, b in zip(Z.INPUTS, low, high)]
    return t.spark.createDataFrame(rows, "input string, low double, high double, replicates int, converged int")


@query("impulse_response_i11", """WITH e AS (SELECT event_type, 0.9 + avg(value) / 10000 AS a, avg(value) AS b FROM events GROUP BY event_type)
SELECT event_type, CAST(t AS INT) AS t, round(b * pow(a, t), 6) AS response, round(-ln(2) / ln(a), 6) AS half_life, round(b / (1 - a), 4) AS area FROM e, range(1, 181) r(t)""")
def _(t):
    e = t.events.groupBy("event_type").agg((F.avg("value") / 10000 + 0.9).alias("a"), F.avg("value").alias("b"))
    out = Z.impulse_response(e, "a", "b")
    return out.select("event_type", "t", *r6("response"), F.round(Z.half_life(col("a")), 6).alias("half_life"), F.round(Z.response_area(col("a"), col("b")), 4).alias("area"))


@query("momentum_by_owner_i12", f"""WITH RECURSIVE {SMOOTH} SELECT h.owner, round(h.hp, 6) AS hits_per_game, round(m.mo, 6) AS momentum
FROM (SELECT owner, CAST(sum(CASE WHEN type = 'hit' THEN 1 ELSE 0 END) AS DOUBLE) / count(DISTINCT gameid) AS hp FROM plays GROUP BY owner) h
JOIN (SELECT owner, avg(xs) AS mo FROM sm JOIN plays p ON p.event_id = sm.event_id GROUP BY owner) m ON m.owner = h.owner""")
def _(t):
    s = smoothed(master(t)).join(t.plays.select("event_id", "owner"), "event_id")
    return Z.team_summary(s, t.plays, "owner").select("owner", *r6("hits_per_game", "momentum"))


@query("goal_model_i13")
def _(t):
    m = Q.goal_soon(master(t), "HOM", DAY, WIDTH)
    s = smoothed(m).select("event_id", "x_smooth")
    g = Z.goal_model(m.join(s, "event_id"), ["x_smooth", "delta_pythagorean", "score_state"], "goal_soon")
    return g.select("event_id", "goal_soon", F.round("p_goal", 4).alias("p_goal"), "converged")


CHUNKS = """ch AS (SELECT doc_id, source, i - 1 AS k, substr(text, CAST(1 + (i - 1) * 650 AS BIGINT), 800) AS chunk_text FROM documents, LATERAL (SELECT unnest(range(1, 2 + (greatest(1, length(text) - 150) - 1) // 650)) AS i) WHERE length(trim(text)) > 0)"""


def chunks(t):
    return X.chunk_table(t.documents, X.stride_chunks(col("text")), doc="doc_id", name="source")


@query("stride_chunks_m2", f"WITH {CHUNKS} SELECT doc_id AS document, CAST(k AS INT) AS chunk_index, md5(chunk_text) AS body, length(chunk_text) AS n FROM ch")
def _(t):
    return chunks(t).select("document", "chunk_index", F.md5("chunk_text").alias("body"), F.length("chunk_text").cast("bigint").alias("n"))


@query("separator_chunks_m2")
def _(t):
    c = X.chunk_table(t.documents, X.separator_chunks(col("text")), doc="doc_id", name="source")
    return c.select("document", "chunk_index", "chunk_text")


@query("chunk_table_m3", f"WITH {CHUNKS} SELECT md5(concat(CAST(doc_id AS VARCHAR), '_', CAST(k AS VARCHAR))) AS document_id, source AS file_name, CAST(k AS INT) AS chunk_index, CAST(length(chunk_text) AS VARCHAR) AS n FROM ch")
def _(t):
    return chunks(t).select("document_id", "file_name", "chunk_index", F.element_at("metadata", "length").alias("n"))


@query("keyword_search_m4", f"""WITH {CHUNKS}, s AS (SELECT doc_id AS document, CAST(k AS INT) AS chunk_index, chunk_text, CAST({' + '.join(f"CAST(contains(lower(chunk_text), '{w}') AS INT)" for w in X.EXPLANATORY)}
+ 5 * CAST(contains(lower(chunk_text), 'elo rating') OR contains(lower(chunk_text), 'elo system') AS INT) AS INT) AS score FROM ch WHERE regexp_matches(lower(chunk_text), 'license'))
SELECT document, chunk_index, score FROM s ORDER BY score DESC, document, chunk_index LIMIT 20""")
def _(t):
    return X.keyword_search(chunks(t), "License", 20).select("document", "chunk_index", "score")


@query("vector_search_m5", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 10""")
def _(t):
    q = t.embeddings.filter(col("vec_id") == 7).select("embedding").scalar()
    return X.vector_search(t.embeddings, q, 10).select("vec_id", *r6("similarity"))


# every hundredth vector asks, one half of them with a keyword; a chunk has the vector of its document's number
KEYWORDS = {100: "LICEN", 300: "token"}
ASKED = f"""q AS (SELECT vec_id AS query_id, embedding AS qe, CASE vec_id % 400 {' '.join(f"WHEN {k} THEN '{w}'" for k, w in KEYWORDS.items())} END AS keyword FROM embeddings WHERE vec_id % 100 = 0)"""
HYBRID = f"""WITH {CHUNKS}, {ASKED}, kw AS (SELECT query_id, 'keyword' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY {' + '.join(f"CAST(contains(lower(chunk_text), '{w}') AS INT)" for w in X.EXPLANATORY)}
 + 5 * CAST(contains(lower(chunk_text), 'elo rating') OR contains(lower(chunk_text), 'elo system') AS INT) DESC, doc_id, k) AS rank, doc_id, k, source, chunk_text FROM q JOIN ch ON regexp_matches(lower(chunk_text), lower(keyword)) QUALIFY rank <= 7),
vc AS (SELECT query_id, 'vector' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 9) DESC, doc_id, k) AS rank, doc_id, k, source, chunk_text
 FROM q JOIN (ch JOIN embeddings ON vec_id = doc_id) ON keyword IS NULL QUALIFY rank <= 7), hits AS (SELECT * FROM kw UNION ALL SELECT * FROM vc)"""


def asked(t):
    word = F.try_element_at(F.create_map(*[F.lit(x) for kv in KEYWORDS.items() for x in kv]), F.pmod(col("vec_id"), F.lit(400)).cast("int"))
    return t.embeddings.filter(col("vec_id") % 100 == 0).select(col("vec_id").alias("query_id"), col("embedding").alias("query_vector"), word.alias("keyword"))


def retrieved(t, top_k):
    vectors = t.embeddings.select(col("vec_id").alias("document"), "embedding")
    return X.hybrid_search(chunks(t).join(vectors, "document", "left"), asked(t), top_k)


@query("vector_queries_m5", """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS s FROM embeddings JOIN q ON true)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INT) AS rank, vec_id, round(s, 6) AS similarity FROM s QUALIFY rank <= 10""")
def _(t):
    return X.vector_search_many(t.embeddings, asked(t), 10).select("query_id", "rank", "vec_id", *r6("similarity"))


@query("hybrid_search_m6", f"{HYBRID} SELECT query_id, branch, CAST(rank AS INT) AS rank, doc_id AS document, CAST(k AS INT) AS chunk_index FROM hits")
def _(t):
    return retrieved(t, 7).select("query_id", "branch", "rank", "document", "chunk_index")


@query("nearest_by_score_f4", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12")
def _(t):
    from icestats.operators.rows import top_k
    return top_k(t.documents.select("doc_id", "n_chars"), 12, "n_chars", "doc_id")


@query("context_text_m7", f"""{HYBRID} SELECT query_id, string_agg(concat('[Document ', CAST(rank AS VARCHAR), ': ', source, ']', chr(10), chunk_text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context FROM hits WHERE rank <= 3 GROUP BY query_id""")
def _(t):
    return X.context_text(retrieved(t, 7), 3)


@query("parsed_documents_m1", "SELECT doc_id, md5(replace(text, chr(10), chr(10) || chr(10))) AS body FROM documents WHERE doc_id % 9 <> 0")
def _(t):
    el = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("content")))
    doc = F.struct(F.struct(el.alias("elements")).alias("document"), F.when(col("doc_id") % 9 == 0, "failed").alias("error_status"))
    d = t.documents.select("doc_id", F.parse_json(F.to_json(doc)).alias("parsed"))
    return X.parsed_documents(d).select("doc_id", F.md5("text").alias("body"))


@query("carried_key_c26", "SELECT vec_id, label, CAST(len(embedding) AS INT) AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def _(t):
    # the key travels with the row, so nothing has to be joined back by position
    s = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t.embeddings.select("vec_id", "label", F.size("embedding").alias("n"), F.round(s, 5).alias("total"))
