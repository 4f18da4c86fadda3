"""Searches by tiles of packed blocks, against all pairs in plain Python; no table of pairs is made."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from talus.functions.text import fnv32, fnv32_of
from talus.operators import retrieval as R


def texts(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string").repartition(3)


def random_texts(seed, n, most=14):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice(["common", "other", *(f"word{j}" for j in range(30))]) for _ in range(rnd.randrange(most)))) for k in range(n)] + [(n, None), (n + 1, "...")]


def half_up(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def best(scores, k):
    by = {}
    for (q, i), s in scores.items():
        by.setdefault(q, []).append((-half_up(s), i))
    return {(q, i, -s, r + 1) for q, x in by.items() for r, (s, i) in enumerate(sorted(x)[:k])}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("small", [False, True])
def test_recall_and_bm25_by_tiles(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(R.S, "ASKED", 5)
        monkeypatch.setattr(R.S, "ROWS", 7)
    prompts, lessons = random_texts(1, 60), random_texts(2, 90)
    got = R.recall(texts(spark, prompts, "query"), texts(spark, lessons, "id"), 4)
    assert "Join Inner, (term" not in plan(got) and "map" in plan(got).lower()
    want = {}
    for q, a in prompts:
        a = (a or "").replace(".", "").split()
        for i, b in lessons:
            b = (b or "").replace(".", "").split()
            if m := sum(w in b for w in a):
                want[q, i] = m / len(a) + 0.5 * m / len(b)
    assert {tuple(r) for r in got.collect()} == best(want, 4)
    docs = {i: Counter((b or "").replace(".", "").split()) for i, b in lessons}
    mean, df = sum(sum(c.values()) for c in docs.values()) / len(docs), Counter(w for c in docs.values() for w in c)
    want = {}
    for q, a in prompts:
        for i, c in docs.items():
            s = sum(n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, n in Counter((a or "").replace(".", "").split()).items() if c[w])
            if s:
                want[q, i] = s
    got = R.bm25(texts(spark, lessons, "id").selectExpr("id", "text"), texts(spark, prompts, "query"), 3)
    exact = best(want, 3)
    assert {r["query"] for r in got.collect()} == {x[0] for x in exact}
    assert sorted((r["query"], r["rank"], round(r["score"], 5)) for r in got.collect()) == sorted((q, r, round(s, 5)) for q, _, s, r in exact)


def test_signatures_and_features_by_tiles(spark):
    rows = random_texts(3, 70)
    t = texts(spark, rows, "id")
    sig = {}
    for i, a in rows:
        w = [x for x in (a or "").replace(".", "").split() if len(x) > 1]
        sig[i] = set(w) if len(w) <= 2 else set(w) | {f"{x} {y}" for x, y in zip(w, w[1:])}
    got = R.jaccard_lookup(t.withColumnRenamed("id", "query"), t, 0.2)
    sims = {(a, b): len(sig[a] & sig[b]) / len(sig[a] | sig[b]) for a in sig for b in sig if a != b and sig[a] & sig[b]}
    assert {tuple(r) for r in got.collect()} == {x[:3] for x in best({k: s for k, s in sims.items() if s >= 0.2}, 1)}
    near = R.top(R.sparse_cosine(R.features(t, "id", "text"), R.features(t, "id", "text")), "query", "score", "id", 5)
    side = lambda most: R.S.packed(R.spread(t, "id", "text").select("id", R.parts_of(R.words(R.F.col("text"))).alias("f")), R.feature_vectors, most)
    mine = R.S.best_rows(side(9), side(11), 5, lambda s, *_: s.copy())
    flat = lambda d: sorted((r["query"], r["rank"], round(r["score"], 5)) for r in d.collect())
    assert flat(mine) == flat(near)


def test_signatures_are_whole(spark):
    """Texts of over 2,000 words and pairs keep all of them; words whose 32-bit hashes meet stay apart."""
    w = [f"w{k}" for k in range(3000)]
    corpus = texts(spark, [(1, " ".join(w[:1500])), (2, " ".join(w[1800:])), (3, "liquid altarage"), (4, None)], "id")
    got = {tuple(r) for r in R.jaccard_lookup(texts(spark, [(9, " ".join(w)), (8, "costarring zinke")], "query"), corpus, 0.05).collect()}
    assert got == {(9, 1, half_up(2999 / 5999))}


def test_hash_of_arrow_texts(spark):
    values = ["", "a", "été", "x" * 300, "word"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", fnv32(R.F.col("t")).alias("h")).orderBy("k").collect()
    assert np.array_equal(fnv32_of(R.pa.array(["skip", *values]).slice(1)), np.array([r["h"] for r in rows], np.uint64))


def test_rows_that_share_an_id_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "disk error"), (1, "error again"), (None, "disk")], "id long, text string")
    got = {(r["query"], r["id"]) for r in R.recall(spark.createDataFrame([(5, "disk error")], "query long, text string"), docs).collect()}
    assert got == {(5, 1), (5, None)}


def test_blocks_of_vectors_are_never_broadcast(spark):
    v = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(40)], "id long, vec array<double>")
    near = R.dense_top(v, v.where("id = 0").withColumnRenamed("id", "query"), 2)
    assert "SortMergeJoin" in near._jdf.queryExecution().sparkPlan().toString()


def test_resolution_joins_one_symbol_a_name_and_folder(spark):
    from talus.operators import symbols as S

    rows = [("Run", f"T{k}.Run", f"src/a/f{k % 3}.go", k) for k in range(30)] + [("Run", "Z.Run", "src/b/a.go", 1)]
    s = spark.createDataFrame(rows, "name string, full_name string, file string, line int")
    found = S.find(s, spark.createDataFrame([("Run",), ("b.Run",), ("x/Run",)], "ref string"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("Run", "T0.Run", "src/a/f0.go", 0, "exact"), ("b.Run", "Z.Run", "src/b/a.go", 1, "folder"), ("x/Run", "T0.Run", "src/a/f0.go", 0, "tail")}


def test_rows_of_a_task_do_not_grow(spark, monkeypatch):
    """Blocks of rows lie in as many partitions as there are blocks, however few cores there are."""
    monkeypatch.setattr(R.S, "ROWS", 2)
    monkeypatch.setattr(R.S, "ASKED", 2)
    rows = random_texts(5, 120)
    out = R.bm25(texts(spark, rows, "id"), texts(spark, rows[:6], "query"), 3)
    assert max(map(int, re.findall(r"Repartition (\d+)", plan(out)))) >= 60
