"""Shards, mix, sketches, wrappers, join, passages and the pipeline against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import DOCS, clashing, edge_rows, edges, prose, table_dir

import corpus_pipeline
from icestats.llm import fingerprints, jaccard, mixing, passages, pieces, shards, wrappers
from icestats.llm.common import components, shingles, words_of


# --- shards


def test_shards_by_rows(spark):
    docs = clashing(edges(spark).unionByName(spark.createDataFrame([(100 + i, "copy", "en", "s", 1) for i in range(300)], DOCS)))
    got = shards.ring_shards(docs, 8).collect()
    n = docs.count()
    count = Counter(r["shard"] for r in got)
    assert len(got) == n and set(count) <= set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    again = shards.ring_shards(docs.repartition(3), 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert shards.ring_shards(docs.limit(0), 8).count() == 0


@pytest.mark.parametrize("shards_, slack", [(8, 0.0), (5, 0.1)])
def test_shards_equal_a_plain_ring(spark, shards_, slack):
    """Row by row around the ring: into the owner of the row's cell, else on to the next shard with room."""
    import struct

    import xxhash

    def spark_hash(first: bytes, seed: int) -> int:
        return xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(first, seed=42).intdigest()).intdigest()

    texts = [f"text {i % 1500}" if i % 3 else "one text of a third" for i in range(3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    owner, seed = shards.ring(shards_), 17
    subs = max(1, shards.COUNTED // len(owner))
    order = []
    for i, t in enumerate(texts):
        number = spark_hash(struct.pack("<q", i), seed + 1)
        sub = (number - (number >> 63 << 64)) % subs
        order.append((spark_hash(t.encode(), seed) * len(owner) >> 64, sub, i))
    left, held, want = shards.room(len(texts), shards_, slack), Counter(), {}
    for cell, _, i in sorted(order):
        while not left[owner[cell % len(owner)]]:
            cell += 1
        s = owner[cell % len(owner)]
        want[i] = (s, held[s])
        left[s] -= 1
        held[s] += 1
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.ring_shards(docs, shards_, slack=slack, seed=seed).collect()}
    assert got == want


def test_walk_goes_on_clockwise():
    owner = [0, 1, 2, 1]
    pieces_ = shards.walk({(0, 0): 7, (1, 0): 1, (3, 0): 1}, owner, 3, 0.0)
    assert [(c, a, b, s) for c, _, a, b, s, _ in pieces_] == [(0, 0, 3, 0), (0, 3, 6, 1), (0, 6, 7, 2), (1, 0, 1, 2), (3, 0, 1, 2)]


def test_slack_moves_few_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(4000)], DOCS)
    old = {r["doc_id"]: r["shard"] for r in shards.ring_shards(docs, 8, slack=0.1).collect()}
    new = {r["doc_id"]: r["shard"] for r in shards.ring_shards(docs, 9, slack=0.1).collect()}
    assert max(Counter(old.values()).values()) <= 4000 * 1.1 / 8 + 2
    assert sum(old[k] != new[k] for k in old) < 0.35 * 4000  # a modulo moves 8 of 9


# --- mix


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, total = set(names), {}, 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in left}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left.discard(s)
    return out


@pytest.mark.parametrize("block", [64, 4])
def test_mix_meets_targets(spark, block):
    rows = [(i, prose(i, 5 + i % 90), "en", [None, "a", "b", "B", "c", ""][i % 6 if i > 60 else 1], 1) for i in range(400)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.per_row(mixing.mixed(docs, block=block)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(len(r[1].split()) for r in rows if r[3] == s)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.02)
    again = mixing.per_row(mixing.mixed(docs.repartition(5), block=block)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pivots_keep_the_mean(spark):
    """Over many seeds a document stands as often as its fraction says."""
    units = spark.createDataFrame([("s", i, float(3 + i % 5), 0.1 + 0.2 * (i % 4), 40) for i in range(40)], "source string, h long, s double, p double, n long")
    total = Counter()
    for seed in range(30):
        for r in mixing.pivotal_round(units, 40, 8, seed).collect():
            total[r["h"]] += r["bit"]
    for low in range(4):
        own = [total[i] / 30 for i in range(40) if i % 4 == low]
        assert np.mean(own) == pytest.approx(0.1 + 0.2 * low, abs=0.1)


def test_mix_edges(spark):
    docs = clashing(edges(spark))
    got = mixing.per_row(mixing.mixed(docs))
    assert got.count() == docs.count()
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    per = Counter((r["doc_id"], r["text"]) for r in rows.collect())
    have = Counter((r[0], r[1]) for r in edge_rows())
    assert all(per[k] <= 2 * have[k] for k in per)
    words = sum(len(words_of(t)) * n for (_, t), n in per.items())
    assert words == got.agg(F.sum("taken")).first()[0]
    assert mixing.mix_rows(docs.limit(0)).count() == 0 and mixing.per_row(mixing.mixed(docs.limit(0))).count() == 0
    one = mixing.per_row(mixing.mixed(spark.createDataFrame([(7, "x y", None, None, 1)] * 9, DOCS))).collect()
    assert len(one) == 9 and 26 <= sum(r["taken"] for r in one) <= 28


# --- sketches


def paragraphs(text):
    import re

    return {p for p in (x.strip(" ") for x in re.split(r"\n|(?<=[.!?])[\x20\t]+", text or "")) if p}


def test_sketches_equal_sets(spark):
    rows = edge_rows()
    docs = clashing(edges(spark))
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows)
    ordered = [(r[0], r[1] or "") for r in rows if r[0] is not None]
    ids = [r[0] for r in ordered]
    by_id = {}
    for k, t in ordered:
        by_id.setdefault(k, t)
    unique = sorted(set(ids), reverse=True)
    single = {k for k in unique if ids.count(k) == 1}
    for r in got:
        k = r["doc_id"]
        if k not in single or k == unique[-1]:
            continue
        following = by_id[unique[unique.index(k) + 1]]
        text = by_id[k]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r["near_edited"], edited), (r["near_next"], following)):
            a, b = paragraphs(text), paragraphs(other)
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    same = [r["fingerprint"] for r in got if r["doc_id"] in (1, 2)]
    assert len(set(same)) == 1
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.fingerprints(docs.where("doc_id = 9")).first()
    assert alone["near_next"] == 1.0


def test_slices_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE_ROWS", 10)
    docs = spark.createDataFrame([(i * i % 997, f"text {i}") for i in range(300)], "doc_id long, text string")
    ids = sorted({i * i % 997 for i in range(300)}, reverse=True)
    got = fingerprints.with_next(docs.dropDuplicates(["doc_id"]), "doc_id", "text").collect()
    text = {r["id"]: r["text"] for r in got}
    assert len(got) == len(ids)
    assert all(r["next_text"] == text[ids[(ids.index(r["id"]) + 1) % len(ids)]] for r in got)


def test_recovered_digests(spark):
    a, b = list(range(1, 400)), list(range(200, 500))
    pair = spark.createDataFrame([(1, 0, a, b), (2, 0, a, a), (3, 0, [], [5])], "rid long, t int, a array<long>, b array<long>")
    got = {(r["rid"]): (r["n_a"], r["n_b"], r["n_diff"]) for r in fingerprints.differences(pair).collect()}
    assert got == {1: (399, 300, 299), 2: (399, 399, 0), 3: (0, 1, 1)}
    keys = {(r["rid"], r["digest"], r["side"]) for r in fingerprints.recovered(pair).collect()}
    assert {k for k in keys if k[0] == 1} == {(1, x, 1) for x in range(1, 200)} | {(1, x, -1) for x in range(400, 500)}


def test_small_sketches_are_retried(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROUNDS", 1)
    pair = spark.createDataFrame([(i, 0, list(range(i, i + 150)), list(range(1000, 1100))) for i in range(3)], "rid long, t int, a array<long>, b array<long>")
    assert all(r["n_diff"] == 250 for r in fingerprints.differences(pair, rounds=1, grow=4).collect())


# --- wrappers


def page(title, body, n_menu=3, extra="", ad="buy"):
    menu = "".join(f"<li><a href='/{i}'>m{i}{title}</a></li>" for i in range(n_menu))
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x='</p>';</script></head><body><header>Site</header>"
        f"<nav><ul>{menu}</ul></nav><div class='ad'>{ad} {title}</div><article><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in body)
        + f"</article><aside>side</aside>{extra}<div id='comments'><p>first!</p></div><form><p>mail</p></form><footer>&copy; {title}</footer></body></html>"
    )


def test_article_of_each_page(spark):
    rows, want = [], {}
    for i in range(12):
        body = [f"Paragraph {i}.{k} &amp; <b>bold</b>\n  text" for k in range(1 + i % 4)]
        rows.append((i, f"http://h{i % 2}.org/{i}", page(f"T{i}", body, 1 + i % 5)))
        want[i] = "\n".join([f"T{i}", *(f"Paragraph {i}.{k} & bold text" for k in range(1 + i % 4))])
    rows += [(20, None, None), (21, "http://h0.org/x", ""), (22, "bad", "<p>plain<br>words</p><p>next"), (23, "http://h0.org/y", "no tags at all"), (0, rows[0][1], rows[0][2])]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = wrappers.extract(pages).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert {k: text[k] for k in want} == want
    assert text[20] == text[21] == "" and text[22] == "plain words\nnext" and text[23] == "no tags at all"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_template_texts_are_no_content(spark):
    rows = [(i, "http://t.org/", f"<body><section><p>Follow us</p></section><div><p>{prose(i, 20)}</p></div></body>") for i in range(10)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: prose(i, 20) for i in range(10)}


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_part_of_one_page_is_kept(spark):
    extra = {4: "<blockquote>One quote</blockquote>"}
    for tag in ("article", "div"):
        rows = [(i, "http://q.org/", f"<body><{tag}><h1>{prose(50 + i, 4)}</h1>{extra.get(i, '')}<div>{prose(i, 20)}</div></{tag}></body>") for i in range(10)]
        want = {i: "\n".join([prose(50 + i, 4), *["One quote"] * (i == 4), prose(i, 20)]) for i in range(10)}
        assert texts_of(spark, rows) == want


def test_texts_shared_by_articles_and_copies_are_kept(spark):
    same = [(i, "http://c.org/", "<body><h1>Title</h1><div><p>One and only</p></div></body>") for i in range(10)]
    assert set(texts_of(spark, same).values()) == {"Title\nOne and only"}
    article = [(i, "http://a.org/", f"<body><article><h1>Daily</h1><div>{prose(i, 9)}</div></article></body>") for i in range(10)]
    assert texts_of(spark, article) == {i: f"Daily\n{prose(i, 9)}" for i in range(10)}


@pytest.mark.parametrize("n", [2, 3, 7, 8])
def test_notices_go_on_any_host(spark, n):
    for notice in ("Read our terms", "We keep small files on your device to see who reads what. " * 12):
        rows = [(i, "http://n.org/", f"<body><section><p>{notice}</p></section><div><p>{prose(i, 20)}</p></div></body>") for i in range(n)]
        assert texts_of(spark, rows) == {i: prose(i, 20) for i in range(n)}


def test_near_copies_keep_their_text(spark):
    rows = [(i, f"http://n{i // 2}.org/", f"<body><h1>Title</h1><h2>More</h2><div><p>The one</p></div><section>{prose(i, 5)}</section></body>") for i in range(4)]
    assert texts_of(spark, rows) == {i: f"Title\nMore\nThe one\n{prose(i, 5)}" for i in range(4)}


def test_words_do_not_overrule_an_article(spark):
    open_ = ["class='content has-sidebar'", "class='no-sidebar'", "class='side-by-side'", "id='menu-page'", "class='menu'", "class='sidebar share'"]
    rows = [(i, f"http://w{i}.org/", f"<body><main><h1>T</h1><div {x}><article><p>text {i}</p><div class=comments><article>c</article></div></article></div></main></body>") for i, x in enumerate(open_)]
    rows += [(10 + i, f"http://v{i}.org/", f"<body><div {x}><p>text {i}</p></div></body>") for i, x in enumerate(open_)]
    rows += [(20, "http://u.org/", "<div class=sidebar>s</div><p>text</p><div class=side-by-side>more</div>")]
    want = {i: f"T\ntext {i}" for i in range(6)} | {10 + i: f"text {i}" for i in range(6)} | {20: "text\nmore"}
    assert texts_of(spark, rows) == want


def test_wrapper_is_union_free():
    a, b = (wrappers.of_page(wrappers.Page(page(f"T{n}", ["x"] * n, n)))[0] for n in (2, 4))
    both = a.merge(b)
    assert both.pages == 2 and "|" not in both.pattern() and "(<li> <a> # </a> </li>)+" in both.pattern()
    assert [x[0] for x in wrappers.Wrapper.load(both.dump()).items] == [x[0] for x in both.items]
    one = wrappers.of_page(wrappers.Page(page("T", ["x"], 1)), both.groups)[0]
    assert "(<p> # </p>)+" in [x[0] for x in one.items]


# --- join


def plain_links(texts, similar=0.8):
    sets = [set(s.tolist()) for s in shingles([words_of(t) for t in texts])]
    out = defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]) - 1e-9:
                out[i].add(j)
                out[j].add(i)
    return sets, out


def edited(text, seed, k):
    r, words = np.random.default_rng(seed), text.split()
    for at in r.integers(0, len(words), k):
        words[at] = f"w{seed}x{at}"
    return " ".join(words)


def near_corpus():
    rows = []
    for g in range(12):
        base = prose(100 + g, 150)
        rows += [base] + [edited(base, g * 50 + k, k % 4) for k in range(6 + 10 * (g == 0))]
    rows += [prose(500 + i, 60) for i in range(60)]
    return rows


@pytest.mark.parametrize("leaf,block", [(1024, 128), (6, 4)])
def test_join_equals_brute_force(spark, leaf, block):
    texts = near_corpus()
    sets, links = plain_links(texts)
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(docs, leaf=leaf, block=block).collect()}
    for i in range(len(texts)):
        seen, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()] - seen:
                seen.add(j)
                queue.append(j)
        assert got[i]["class_id"] == min(seen)
        assert got[i]["n_links"] == len(links[i])
        assert got[i]["n_text_links"] == len({frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])})
        assert got[i]["copy_of"] == min(j for j in seen if sets[j] == sets[i])


def test_recall_of_paths(spark):
    """Pairs close to the threshold, without other pairs that could join them."""
    pairs = []
    for g in range(150):
        base = prose(2000 + g, 200)
        pairs += [base, edited(base, g, 4)]
    _, links = plain_links(pairs)
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    got = jaccard.jaccard_classes(docs).where("n_links > 0").count()
    assert got >= 0.97 * len(links) and len(links) > 150


def test_buckets_are_compared_in_full():
    """Two sets near different pivots, and near each other only."""
    row = np.arange(64, dtype=np.uint32)
    own = lambda k, n: np.where(np.arange(64) < n, row, 1000 * k + row).astype(np.uint32)
    x, y = own(1, 64), own(2, 56)
    first, second = x.copy(), y.copy()
    first[:24] += 5000  # agrees with x on 40 places, with y on 32
    second[:24] += 7000
    table = pa.table({"sig": pa.array([b"a", b"b", b"x", b"y"], pa.binary()), "sketch": pa.array([v.tobytes() for v in (first, second, x, y)], pa.binary())})
    found = [e for batch in jaccard._compare(0.6)(table) for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    assert sorted(found) == [(b"a", b"b"), (b"a", b"x"), (b"a", b"y")]


@pytest.mark.parametrize("leaf", [1024, 24])
def test_recall_of_long_chains(spark, leaf):
    """Each version a few words from the last: links and classes against brute force."""
    texts = []
    for g in range(12):
        last = prose(4000 + g, 150)
        for k in range(30):
            texts.append(last)
            last = edited(last, 9000 + 30 * g + k, 1 + k % 3)
    _, links = plain_links(texts)
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), leaf=leaf).collect()}
    pairs = [(i, j) for i in links for j in links[i]]
    met = sum(got[i]["class_id"] == got[j]["class_id"] for i, j in pairs)
    assert len(pairs) > 900 and met >= 0.99 * len(pairs)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * len(pairs)


def test_join_edges(spark):
    docs = clashing(edges(spark))
    got = jaccard.jaccard_classes(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert by[2]["class_id"] == by[3]["class_id"] == 1 and by[3]["n_links"] == 3
    assert by[5]["class_id"] == 5 and by[4]["n_links"] == by[6]["n_links"] == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert not {2, 3} & set(ids) and ids[1] == ids[10] == 1 and {4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15} <= set(ids) and ids[None] == 2
    assert jaccard.keep_one(docs.limit(0)).count() == 0 and jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges_ = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges_, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# --- passages


def plain_windows(values, width):
    n, out = len(values), set()
    for c in range(n):
        left = c
        while left > 0 and values[left - 1] > values[c]:
            left -= 1
        right = c
        while right < n - 1 and values[right + 1] >= values[c]:
            right += 1
        if right - left + 1 >= width:
            out.add((left, c, right))
    return out


def test_compact_windows_equal_plain_scan():
    r = np.random.default_rng(3)
    for n in (5, 46, 47, 200, 400):
        for spread in (5, 2**40):
            values = r.integers(0, spread, n).astype(np.uint64)
            assert set(zip(*(x.tolist() for x in passages.compact_windows(values, 46)))) == plain_windows(values.tolist(), 46)


def test_best_segments_equal_all_stretches():
    r = np.random.default_rng(8)
    tokens, similar = 10, 0.8
    share = 2 * similar / (1 + similar)
    width, mid = 2 * tokens - 1, tokens - 1
    hit = r.random((300, width)) < np.repeat([0.8, 0.9, 0.97], 100)[:, None]
    inside = np.arange(width)[None, :] >= r.integers(0, 6, 300)[:, None]
    first, last = passages.best_segments(hit & inside, inside, tokens, similar)
    a, b = passages.middle_runs(hit & inside)
    for k in range(300):
        own = (hit & inside)[k]
        want = max((
            j - i + 1 for i in range(mid + 1) for j in range(mid, width)
            if j - i + 1 >= tokens and inside[k, i : j + 1].all() and (own[i] or i == mid) and own[j] and own[i : j + 1].sum() >= share * (j - i + 1) - 1e-9
        ), default=0)
        assert last[k] - first[k] + 1 == want
        if own[mid]:
            assert own[a[k] : b[k] + 1].all() and (a[k] == 0 or not own[a[k] - 1]) and (b[k] == width - 1 or not own[b[k] + 1])
        else:
            assert b[k] < a[k]


def test_windows_stay_within_their_text(spark):
    texts = [prose(k, n) for k, n in enumerate((10, 49, 50, 51, 400, 3, 90, 700))] + ["again " * 200]
    rows = passages.keyed(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).coalesce(1), "doc_id", "text")
    got = {}
    for r in passages.windows(rows).where("source_key is null").collect():
        got.setdefault(r["id"], []).append((r["h"] % 2**64, *passages._unpack(r["place"])))
    for i, t in enumerate(texts):
        own = shingles([words_of(t)], 5)[0]
        want = []
        for f in range(passages.HASHES):
            values = np.maximum(passages.mix64(own, 50 + f), 1)
            want += [(int(values[c]), c, min(c - a, 45), min(b - c, 45)) for a, c, b in plain_windows(values.tolist(), 46)]
        assert sorted(got.get(i, [])) == sorted(want)


def repeated_words(texts, ids, size=50):
    """Words inside an exact window of `size` words that an earlier document holds."""
    seen, out = {}, {}
    for i in sorted(range(len(texts)), key=lambda k: ids[k]):
        w = texts[i].split()
        hit = set()
        for k in range(len(w) - size + 1):
            if seen.get(tuple(w[k : k + size]), i) != i:
                hit.update(range(k, k + size))
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), i)
        out[ids[i]] = hit
    return out


def passage_corpus():
    shared = [prose(900 + k, 55 + 20 * k).split() for k in range(4)]
    texts = []
    for i in range(60):
        w = prose(1000 + i, 90 + i).split()
        if i % 2:
            p = shared[i % 4 if i % 3 else 0]
            w = w[: 20 + i] + p + w[20 + i :]
        if i % 7 == 0:
            w = w[:10] + "released under the same short licence line as all others".split() + w[10:]
        texts.append(" ".join(w))
    texts.append(" ".join(shared[1] * 6))  # repeats itself
    texts.append(texts[5])
    return texts


@pytest.mark.parametrize("leaf", [4096, 8])
def test_repeated_passages_are_found(spark, leaf):
    texts = passage_corpus()
    ids = list(range(len(texts)))
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))
    want = repeated_words(texts, ids)
    got = passages.passages(docs, leaf=leaf).collect()
    assert len(got) == len(texts)
    for r in got:
        words = {k for s in r["spans"] for k in range(s["first"], s["end"])}
        assert want[r["doc_id"]] <= words
        assert len(words) <= len(want[r["doc_id"]]) + 12  # a passage may take in a changed word at its ends
        assert r["n_repeated"] == len(words) and all(s["source"] < r["doc_id"] for s in r["spans"])


def test_changed_passage_is_found(spark):
    p = prose(77, 120).split()
    q = [*p[:60], "other", *p[61:]]
    a, b = prose(78, 40), prose(79, 40)
    docs = spark.createDataFrame([(1, f"{a} {' '.join(p)}"), (2, f"{b} {' '.join(q)} end"), (3, prose(80, 300))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.passages(docs).collect()}
    assert got[1]["n_repeated"] == got[3]["n_repeated"] == 0 and 115 <= got[2]["n_repeated"] <= 125


def test_recall_of_changed_passages(spark):
    """Passages of 50 to 60 words with one changed word, no 50 words of them unchanged."""
    rows, want = [], []
    for g in range(600):
        p = prose(20_000 + g, 50 + g % 11).split()
        at = 12 + g % (len(p) - 24)
        q = [*p[:at], f"other{g}", *p[at + 1 :]]
        a, b = (set(x.tolist()) for x in shingles([[w.encode() for w in x] for x in (p, q)]))
        if len(a & b) >= 0.8 * len(a | b):
            want.append((2 * g + 1, len(p)))
        rows += [(2 * g, f"{prose(30_000 + g, 30)} {' '.join(p)} {prose(40_000 + g, 30)}"), (2 * g + 1, f"{prose(50_000 + g, 30)} {' '.join(q)} {prose(60_000 + g, 30)}")]
    got = {r["doc_id"]: r["n_repeated"] for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(n - 2 <= got[i] <= n + 2 for i, n in want)
    print("found", found, "of", len(want))
    assert len(want) > 500 and found >= 0.99 * len(want)


def test_cut_text(spark):
    assert passages.without("a  b\nc d ", [(1, 3)]) == "a  d "
    assert passages.without("é b c", [(0, 1)]) == "b c"
    docs = clashing(edges(spark))
    cut = passages.cut_passages(docs)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r for r in cut.collect() if r["doc_id"] is not None}
    assert 2 not in got and got[1]["text"] == edge_rows()[0][1] and got[9]["text"] == edge_rows()[8][1]
    assert {4, 5, 6, 7, 8} <= set(got)  # only what loses its words goes
    assert passages.cut_passages(docs.limit(0)).count() == 0 and passages.passages(docs.limit(0)).count() == 0


# --- pipeline


def test_pipeline_against_plain_python(spark, tmp_path_factory):
    shared = prose(900, 70)
    rows = []
    for i in range(40):
        rows.append((i, prose(3000 + i, 120 + i) + (" " + shared if i % 5 == 0 else ""), "en", f"s{i % 3}", 1))
    rows += [(100, edited(rows[1][1], 1, 1), "en", "s1", 1), (101, rows[2][1], "en", "s2", 1), (102, "spam " * 300, "en", "s0", 1), (103, None, "en", "s0", None), (104, "short text", "en", None, 10)]
    folder = table_dir(tmp_path_factory, documents=spark.createDataFrame(rows, DOCS))
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        counts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = set(range(40)) | {100, 101}
    assert set(counts["quality_rules"]) == good
    assert set(counts["ngram_jaccard_join"]) == set(range(40))
    texts = counts["substring_dedup"]
    assert set(texts) == set(range(40))
    for i in range(40):
        own = prose(3000 + i, 120 + i)
        if i % 5 == 0 and i:  # the passage may take a common word before it along
            assert own.startswith(texts[i].strip()) and len(own.split()) - len(texts[i].split()) <= 2
        else:
            assert texts[i] == own + (" " + shared if i == 0 else "")
    final = corpus_pipeline.run(spark, folder).collect()
    taken = Counter(r["doc_id"] for r in final)
    assert all(1 <= n <= 2 for n in taken.values())
    words = {i: len(t.split()) for i, t in texts.items()}
    assert sum(words[r["doc_id"]] for r in final) == pytest.approx(1.5 * sum(words.values()), rel=0.03)
    model = pieces.Model(pieces.read_model())
    for r in final:
        assert r["decoded"] == texts[r["doc_id"]] and model.decode(r["ids"]) == r["decoded"]


def test_rows_without_a_long_stretch_cost_no_square():
    """op3 check: every right end was held against every left end, also in rows that have no stretch long enough."""
    import tracemalloc

    tokens, rng = 400, np.random.default_rng(4)
    hit = rng.random((500, 2 * tokens - 1)) < 0.5
    hit[:, tokens - 1] = True
    inside = np.ones(hit.shape, dtype=bool)
    tracemalloc.start()
    first, last = passages.best_segments(hit, inside, tokens, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (last < first).all() and peak < 50_000_000  # 500 rows of 400 x 400 places are 80 MB
    hit[3, tokens - 20 : 2 * tokens - 10] = True
    first, last = passages.best_segments(hit, inside, tokens, 0.8)
    assert last[3] - first[3] + 1 >= tokens and (np.delete(last < first, 3)).all()


def test_groups_of_many_unlike_surroundings():
    """op3 check: what a turn takes away is counted anew, not the whole group; passages equal those of all pairs."""
    import pyarrow as pa

    tokens, rng = 6, np.random.default_rng(9)
    base = rng.integers(1, 2**31, 2 * tokens - 1).astype(np.uint32)
    rows = []
    for k in range(120):
        own = rng.integers(1, 2**31, 2 * tokens - 1).astype(np.uint32)
        a, b = rng.integers(0, tokens, 2)
        own[tokens - 1 - a : tokens + b] = base[tokens - 1 - a : tokens + b]
        rows.append((k, int(a), int(b), own))
    table = pa.table({
        "h": pa.array([1] * len(rows), pa.int64()), "i": pa.array([0] * len(rows), pa.int32()), "j": pa.array([0] * len(rows), pa.int32()),
        "id": [r[0] for r in rows], "key": [r[0] + 1000 for r in rows], "place": pa.array([50] * len(rows), pa.int64()), "region": pa.array([r[3].tobytes() for r in rows], pa.binary()),
    })
    found = {r["id"] for b in passages._verify(tokens, 5, 1.0)(table) for r in b.to_pylist()}

    def repeats(k, j):
        return min(rows[k][1], rows[j][1]) + 1 + min(rows[k][2], rows[j][2]) >= tokens

    assert found == {k for k in range(120) if any(repeats(k, j) for j in range(k))} and 0 < len(found) < 119


def test_a_turn_costs_its_own_rows():
    """op3 check: each turn read all tokens of its group again and again; rows in pairs meet their partners alone."""
    import time

    import pyarrow as pa

    tokens, n, rng = 46, 4000, np.random.default_rng(3)
    region = np.repeat(rng.integers(1, 2**31, (n // 2, 2 * tokens - 1)).astype(np.uint32), 2, axis=0)
    region[:, tokens - 1] = 7
    region[1::2, 0] ^= 1
    table = pa.table({
        "h": pa.array([1] * n, pa.int64()), "i": pa.array([0] * n, pa.int32()), "j": pa.array([0] * n, pa.int32()),
        "id": pa.array(range(n)), "key": pa.array(range(n)), "place": pa.array([50 << 20] * n, pa.int64()), "region": pa.array([r.tobytes() for r in region], pa.binary()),
    })
    mark, began = np.zeros(n * region.shape[1], dtype=bool), time.process_time()
    for _ in range(n // 4):  # one pass over all tokens for each turn, were half of the rows still there
        mark[np.arange(mark.size).reshape(region.shape)]
    passes, began = time.process_time() - began, time.process_time()
    found = [(r["id"], r["source"]) for b in passages._verify(tokens, 5, 0.8)(table) for r in b.to_pylist()]
    took = time.process_time() - began
    assert sorted(found) == [(k, k - 1) for k in range(1, n, 2)]
    assert took < 3.5 * passes
