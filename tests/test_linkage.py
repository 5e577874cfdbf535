import itertools
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from icestats.operators import linkage as L


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def score(a, b, method):
    if method == "edit":
        top = max(len(a), len(b))
        return int((top - lev(a, b)) * 100.0 / top + 0.5)
    return int(200.0 * lcs(a, b) / (len(a) + len(b)) + 0.5)


@pytest.mark.parametrize("method,threshold", [("edit", 78), ("indel", 78), ("edit", 60), ("indel", 90)])
def test_same_pairs_as_brute_force(spark, method, threshold):
    rnd = random.Random(5)
    words = ["anna", "lee", "smith", "jo", "x", "mackenzie", "oconnor", "petersson", "peterson", "li"]

    def noisy(s):
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(s) + 1)
            s = rnd.choice([s[:i] + rnd.choice("aeiost") + s[i:], s[:i] + s[i + 1 :], s[:i] + "z" + s[i + 1 :]]) or "q"
        return s

    make = lambda n: [(rnd.choice("AB"), noisy(" ".join(rnd.sample(words, rnd.randint(1, 2))))) for _ in range(n)]
    left, right = make(70), make(70)
    got = L.similar_names(*(spark.createDataFrame(d, "block string, name string") for d in (left, right)), ["block"], threshold=threshold, method=method)
    want = {
        (b, x, y, score(x, y, method)) for (b, x), (c, y) in itertools.product(set(left), set(right))
        if b == c and x and y and score(x, y, method) > threshold
    }
    assert {tuple(r) for r in got.collect()} == want and want


def test_token_sort_ignores_order_case_accents(spark):
    d = spark.createDataFrame([("Tomáš  Hertl",), ("hertl, TOMAS",)], "n string")
    assert d.select(L.token_sort(F.col("n")).alias("t")).distinct().count() == 1


def test_exact_first_then_fuzzy(spark):
    l = spark.createDataFrame([(1, 2020, "BUF", "Jack Eichel"), (2, 2020, "BUF", "Jak Eichel"), (3, 2020, "MIN", "Nobody Here")], "l int, season int, team string, name string")
    r = spark.createDataFrame([(9, 2020, "BUF", "Jack Eichel")], "r int, season int, team string, name string")
    got = {(x["l"], x["r"], x["phase"]) for x in L.link_people(l, r, ["season", "team"], left_id="l", right_id="r", name="name").collect()}
    assert got == {(1, 9, "exact"), (2, 9, "fuzzy")}


def test_links_in_factors_equal_all_pairs(spark):
    rnd = random.Random(9)
    names = ["anna smith", "ana smith", "jo petersson", "jo peterson", "li lee", "lie lee"]
    left = [(i, rnd.choice("AB"), rnd.choice(names)) for i in range(60)]
    right = [(100 + i, rnd.choice("AB"), rnd.choice(names)) for i in range(60)]
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} int, block string, name string")
    links = L.fuzzy_links(make(left, "l"), make(right, "r"), ["block"], left_id="l", right_id="r", name="name")
    tokens = {n: " ".join(sorted(n.split())) for n in names}
    want = {(b, i, j, score(tokens[x], tokens[y], "edit")) for i, b, x in left for j, c, y in right if b == c and score(tokens[x], tokens[y], "edit") > 78}
    assert {tuple(r) for r in L.pairs(links).collect()} == want
    assert sum(r["n_left"] * r["n_right"] for r in L.class_links(links).collect()) == len(want)
    assert links.edges.count() <= 2 * len(names) ** 2 < len(want)  # names, not rows
    per = {r["l"]: r["n_links"] for r in L.members(links).collect()}
    assert per == {i: sum(w[1] == i for w in want) for i, _, _ in left}
    best = {r["l"]: (r["r"], r["score"]) for r in L.best_links(links).collect()}
    assert best == {i: min(((w[2], w[3]) for w in want if w[1] == i and w[3] >= 85), key=lambda x: (-x[1], x[0])) for i in {w[1] for w in want if w[3] >= 85}}
    linked = L.link_people(make(left, "l"), make(right, "r"), ["block"], left_id="l", right_id="r", name="name").collect()
    assert len(linked) == len({r["l"] for r in linked}) == len({w[1] for w in want})


def test_fuzzy_links_query_writes_out_every_pair_of_ids(spark, tmp_path):
    # three right rows of one name: a link each, with its own id
    rows = [(1, "B", "ab cd", "X Y"), (3, "B", "ab cd", "X Y"), (2, "B", "ab cd", "X Y"), (4, "B", "ab cd", "X Y"), (6, "B", "ab cd", "X Y"), (8, "C", "ab cd", "X Y")]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["left_id"], r["right_id"]) for r in queries()["fuzzy_links_c16"](spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i in (1, 3) for j in (2, 4, 6)}


def test_linked_people_keeps_every_partner(spark):
    l = spark.createDataFrame([(1, "A", "jo petersson"), (3, "A", "li lee"), (5, "A", "nobody here")], "l int, block string, name string")
    r = spark.createDataFrame([(2, "A", "jo petersson"), (4, "A", "jo petersson"), (6, "A", "jo peterson"), (8, "A", "lie lee"), (10, "A", "lii lee")], "r int, block string, name string")
    got = {tuple(x) for x in L.linked_people(l, r, ["block"], left_id="l", right_id="r", name="name").collect()}
    assert got == {("A", 1, 2, 100, "exact"), ("A", 1, 4, 100, "exact"), ("A", 3, 8, 86, "fuzzy"), ("A", 3, 10, 86, "fuzzy")}


def test_repeated_names_are_joined_in_pieces(spark, monkeypatch):
    left = spark.createDataFrame([(i, ["A", "B", None][i % 3], "hot" if i % 3 == 0 else str(i)) for i in range(300)], "l int, block string, name string")
    right = spark.createDataFrame([(i, ["A", "B", None][i % 3], "hot" if i % 3 == 0 else str(i)) for i in range(300)], "r int, block string, name string")
    plain = sorted(map(tuple, left.join(right, ["block", "name"], "left").collect()), key=repr)
    monkeypatch.setattr(L, "PIECE_ROWS", 500)
    monkeypatch.setattr(L, "TASK_ROWS", 1000)
    got = L.exact_links(left, right, ["block", "name"])
    assert sorted(map(tuple, got.collect()), key=repr) == plain
    # the hundred rows of one name make 10,000 joined rows, which no task makes alone
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 5000
