"""The stored full-text index: its questions, its files, and ranks against a plain version."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from talus.operators import textindex as T

ROWS = "id long, name string, text string"


def table():
    rnd = random.Random(8)
    pool = ["greet", "user", "func", "Été", "数据", "snake_case", "x1", "the", "the", "the", "or"]
    rows = [(k, rnd.choice(["main.go", "util.go", None]), " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25)))) for k in range(120)]
    return [*rows, (500, None, None), (501, "greet user", ""), (502, "x", "func  greet, USER! the-end"), (503, "main.go", "the " * 3000 + "func greet")]


QUESTIONS = {
    1: "greet",
    2: '"func greet"',
    3: '"greet user" OR "user greet" NOT func',
    4: 'name:main the "the the the"',
    5: "AND été and NOT",
    6: 'name:"main go" OR text:数据',
    7: "nowhere OR snake_case AND x1",
    8: "... !!",
    9: "unknown:func",
    10: "NOT the",
}
#: By hand: alternatives of (column, words, negative).
MEANT = {
    1: [[(None, "greet", False)]],
    2: [[(None, "func greet", False)]],
    3: [[(None, "greet user", False)], [(None, "user greet", False), (None, "func", True)]],
    4: [[("name", "main", False), (None, "the", False), (None, "the the the", False)]],
    5: [[(None, "été", False)]],
    6: [[("name", "main go", False)], [("text", "数据", False)]],
    7: [[(None, "nowhere", False)], [(None, "snake_case", False), (None, "x1", False)]],
    8: [],
    9: [[(None, "unknown func", False)]],
    10: [[(None, "the", False)]],
}


def plain(rows, groups, k):
    held = {r[0]: {c: re.findall(r"\w+", (v or "").lower()) for c, v in zip(("name", "text"), r[1:], strict=True)} for r in rows}
    size = {i: sum(map(len, h.values())) for i, h in held.items()}
    mean = sum(size.values()) / len(size)

    def times(h, col, said):
        want = said.split()
        return sum(w[p : p + len(want)] == want for c, w in h.items() if col in (None, c) for p in range(len(w)))

    f = [[{i: n for i, h in held.items() if (n := times(h, col, said))} for col, said, _ in g] for g in groups]
    hits = {i for i in held for g, ff in zip(groups, f, strict=True) if all((i in x) != c[2] for c, x in zip(g, ff, strict=True))}
    out = {}
    for i in hits:
        out[i] = sum(max(math.log((len(held) - len(x) + 0.5) / (len(x) + 0.5)), 1e-6) * x[i] * 2.2 / (x[i] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for ff in f for x in ff if i in x)
    best = sorted(out.items(), key=lambda p: (-round(p[1], 6), p[0]))[:k]
    return [(i, s, n + 1) for n, (i, s) in enumerate(best)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    T.build(spark.createDataFrame(table(), ROWS).repartition(3), "id", ["name", "text"], path, shards=5)
    return path


def test_questions(spark, index):
    """All questions at once over one saved index."""
    got = {}
    for r in T.ask(spark, index, QUESTIONS, ["name", "text"], 40).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"], r["rank"]))
    for q, groups in MEANT.items():
        want = plain(table(), groups, 40)
        assert [(i, n) for i, _, n in got.get(q, [])] == [(i, n) for i, _, n in want], q
        assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got.get(q, []), want, strict=True))
    assert len(got[2]) > 2 and len(got[3]) > 2 and 8 not in got


def test_reads_only_its_shards(spark, index):
    held = spark.read.parquet(f"{index}/postings")
    assert held.select("shard").distinct().count() > 2
    plan = T.ask(spark, index, {1: "greet"}, ["name", "text"])
    assert plan.count() == 20
    one = held.where("term = 'greet'")
    assert one.select("shard").distinct().count() == 1 and one.where(F.col("shard") != T.shard_of(F.col("term"), 5)).count() == 0


def test_phrases_of_a_table(spark, index):
    asked = spark.createDataFrame([(1, "Func greet and more"), (2, None), (3, "the")], "id long, text string")
    got = {(r["query"], r["id"]) for r in T.ask_all(spark, index, T.phrases_of(asked, "id", "text", 2), 500).collect()}
    assert got == {(q, i) for q, said in ((1, "func greet"), (3, "the")) for i, _, _ in plain(table(), [[(None, said, False)]], 500)}


def test_empty_table(spark, tmp_path):
    T.build(spark.createDataFrame([], ROWS), "id", ["name", "text"], str(tmp_path / "i"))
    assert T.ask(spark, str(tmp_path / "i"), {1: "greet"}, ["name", "text"]).count() == 0


def test_rows_that_share_an_id(spark, tmp_path):
    """One row: phrases are found in each text, and none goes from one to the next."""
    rows = [(1, "x", "func greet the"), (1, "y", "func greet user"), (2, None, "the func")]
    T.build(spark.createDataFrame(rows, ROWS), "id", ["name", "text"], str(tmp_path / "i"))
    got = T.ask(spark, str(tmp_path / "i"), {1: '"func greet"', 2: '"the func"', 3: "greet", 4: '"user func"'}, ["name", "text"]).collect()
    assert sorted((r["query"], r["id"]) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_a_phrase_of_many_questions(spark, index):
    """Whoever asks, a row's words are laid out once, and every question gets the same rows."""
    asked = spark.createDataFrame([(k, "the the the") for k in range(300)], "id long, text string")
    clauses = T.phrases_of(asked, "id", "text", 3).withColumnRenamed("col", "want")
    found = T.phrases(T.postings(spark, index), clauses, ["query"]).groupBy("id", "f").count().collect()
    want = {i: n for i, _, text in table() if (n := sum(w == ["the"] * 3 for w in zip(*(re.findall(r"\w+", (text or "").lower())[k:] for k in range(3)), strict=False) for w in [list(w)]))}
    assert {r["id"]: r["f"] for r in found} == want and {r["count"] for r in found} == {300}
