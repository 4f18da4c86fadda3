"""Token counts against the tiktoken library, and the vector index against all pairs."""

import base64
import random

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from talus.operators import retrieval as R
from talus.operators import tokens as T
from talus.operators import vectorindex as V
from talus.plans.texts import VOCABULARY

T_WORDS = regex.compile(T.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(VOCABULARY, "rb") as rows:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rows)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts(spark, library):
    rnd = random.Random(1)
    letters = [chr(k) for k in [*range(32, 127), 9, 10, 13, 0x85, 0xA0, 0xE9, 0x3000, 0x6570, 0x5D0, 0x1F600, 0x663, 0x301, 0x200B, 0x2028]]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(300)] + ["the the  the\n\n  the", "don't we'll  it's", "a" * 20_000, " " * 999 + "x", "", None, "\r\n \t x"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (0, " more")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = {}
    for k, t in rows:
        want[k] = want.get(k, 0) + len(library.encode_ordinary(t or ""))
    for hot in (20_000, 5, 0):
        got = {r["id"]: r["tokens"] for r in T.token_counts(docs, VOCABULARY, hot=hot).collect()}
        assert got == want
    assert T.token_counts(docs.limit(0), VOCABULARY).count() == 0


def test_token_counts_without_a_shuffle(spark, library, monkeypatch):
    """Where no id repeats, texts are counted in place, whatever the batches and however few sizes are remembered."""
    rows = [(k, " ".join(f"w{(k * j) % 37}é" for j in range(k % 60))) for k in range(700)] + [(700, None), (701, ""), (None, "a" * 9_000)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = {k: (len(library.encode_ordinary(t or "")), len(w := T_WORDS.findall(t or "")), len(set(w))) for k, t in rows}
    for kept, batch in ((1 << 17, "10000"), (3, "7")):
        monkeypatch.setattr(T, "KEPT", kept)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        out = T.token_counts(docs, VOCABULARY)
        assert {r["id"]: (r["tokens"], r["words"], r["distinct"]) for r in out.collect()} == want
        assert " Join " not in out._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_merges(library):
    ranks = T.ranks_of(VOCABULARY)
    rnd = random.Random(2)
    for _ in range(2000):
        word = "".join(rnd.choice("aeinrstl") for _ in range(rnd.randint(1, 60)))
        assert T.size_of(word.encode(), ranks) == len(library.encode_ordinary(word))
    assert T.size_of(b"ab" * 100_000, ranks) == len(library.encode_ordinary("ab" * 100_000))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 12))
    x = np.concatenate([centres[rng.integers(0, 25, 1500)] + 0.35 * rng.normal(size=(1500, 12)), np.tile(centres[0], (900, 1)) + 0.01 * rng.normal(size=(900, 12))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 12), (9002, [float("nan")] * 12), (9003, [None, *[1.0] * 11]), (9004, [1e200] * 12), (9005, (-x[0]).tolist())]
    return spark.createDataFrame(rows + odd, "id long, vec array<double>").repartition(4)


def test_index(spark, vectors, tmp_path):
    """A crowded list is several blocks; the exact way equals all pairs, the approximate one has a recall of 0.9."""
    path = str(tmp_path / "v")
    V.build(vectors, path, sample=800, rows=32)
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.agg(F.max("blocks")).first()[0] > 3
    asked = vectors.where("id % 20 = 0 or id >= 9000").withColumnRenamed("id", "query")
    exact = R.dense_top(V.sound(vectors.where("id <> 9004")), V.sound(asked.where("query <> 9004")), 5)
    key = lambda df: sorted(map(tuple, df.where("query <> 9004 and id <> 9004").select("query", "id", "score", "rank").collect()))
    got = V.search(spark, path, asked, 5, probes=3, exact=True)
    assert {r["query"] for r in got.where("query >= 9000").collect()} == {9004, 9005}
    a, b = key(got), key(exact)
    assert [r[:2] for r in a] == [r[:2] for r in b] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b, strict=True))
    assert V.recall(V.search(spark, path, asked, 5, probes=6), got) >= 0.9
    few = V.search(spark, path, asked.where("query = 40"), 3000, probes=1, exact=True)
    assert few.count() == vectors.count() - 4 - 1


def test_index_of_nothing(spark, vectors, tmp_path):
    V.build(vectors.where("id = 9000"), str(tmp_path / "v"))
    assert V.search(spark, str(tmp_path / "v"), vectors.withColumnRenamed("id", "query"), exact=True).count() == 0


def test_recall_on_the_tables(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    V.build(v, str(tmp_path / "v"))
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query")
    near = V.search(spark, str(tmp_path / "v"), asked, 5)
    assert V.recall(near, R.dense_top(v, asked, 5)) >= 0.9


def test_questions_by_list_are_few_at_once(monkeypatch):
    """However many lists are open, a worker makes at most PAIRS rows at once, and all of them."""
    monkeypatch.setattr(V, "PAIRS", 7)
    part = pd.DataFrame({"query": range(5), "vec": [[float(k)] for k in range(5)]})
    open_ = np.random.default_rng(1).random((5, 40)) < 0.5
    made = list(V.by_list(part, open_, np.arange(40) * 3))
    assert max(map(len, made)) == 7
    got = [(q, v, k) for m in made for q, v, k in zip(m["query"], m["vec"], m["list"], strict=True)]
    assert got == [(i, [float(i)], 3 * j) for i in range(5) for j in range(40) if open_[i, j]]
