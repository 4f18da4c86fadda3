"""Whole-table bindings of queries that SQL does not cover."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talus.operators import events as E
from talus.operators import graph as G
from talus.plans import events, graph, texts


def test_shingle_jaccard_among_queries(spark, tmp_path):
    """Copied opening turns, all of them queries, find each other but not themselves."""
    rows = [(1, 0, "user", "how do I join two tables"), (2, 0, "user", "how do I join two tables"), (2, 1, "assistant", "use a key"), (3, 0, "user", "alone here")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in texts.shingle_jaccard(spark, str(tmp_path)).collect()}
    assert got == {(1000, 2000, 1.0), (2000, 1000, 1.0)}


def test_service_inference_of_all_views(spark):
    """Against all pairs: every view event, and errors as alerts, which never name themselves."""
    sf = "/root/testdata/sf0.001"
    rows = events.events(spark, sf).toPandas().to_dict("records")
    errors = [r for r in rows if r["event_type"] == "error"]

    def want(kind):
        out = {}
        for r in rows:
            near = [e for e in errors if e["event_id"] != r["event_id"] and r["ts"] - timedelta(minutes=30) <= e["ts"] <= r["ts"]]
            if r["event_type"] == kind and near:
                out[r["event_id"]] = max(near, key=lambda e: (e["ts"], e["event_id"]))["user_id"]
        return out

    got = events.service_inference(spark, sf).collect()
    assert len(got) > 0 and dict(map(tuple, got)) == want("view") and len(got) == len(want("view"))
    e = events.events(spark, sf)
    assert dict(map(tuple, E.infer_service(e.where("event_type = 'error'"), e).collect())) == want("error")


def test_communities_of_parts(spark, tmp_path):
    """Parts that two orders share are one community; a pair of a single order is no edge."""
    rows = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4), (5, 1), (5, 9)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["id"]: r["label"] for r in graph.communities(spark, str(tmp_path)).collect()}
    assert set(got) == {"part:1", "part:2", "part:3", "part:4"}
    assert got["part:1"] == got["part:2"] != got["part:3"] == got["part:4"]


def test_service_inference_in_one_instant(spark):
    """All events within a minute, most of them at one time: spread over tasks, and the same as all pairs."""
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=rnd.choice([30, 30, 30, rnd.randrange(60)])), f"u{rnd.randrange(9)}", rnd.choice(["error", "view", "view", "login"]), 1.0) for k in rnd.sample(range(9000), 900)]
    rows += [(9001, start - timedelta(hours=3), "old", "view", 1.0), (9002, start - timedelta(hours=2), "old", "error", 1.0), (9003, None, "none", "error", 1.0), (9004, None, "none", "view", 1.0)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id string, event_type string, value double")
    errors = [r for r in rows if r[3] == "error" and r[1]]

    def want(kind):
        near = {r[0]: [x for x in errors if x[0] != r[0] and x[1] <= r[1] and x[1] >= r[1] - timedelta(minutes=30)] for r in rows if r[3] == kind and r[1]}
        return {k: max(v, key=lambda x: (x[1], x[0]))[2] for k, v in near.items() if v}

    for kind in ("view", "error"):
        got = E.infer_service(e.where(F.col("event_type") == kind), e)
        assert dict(map(tuple, got.collect())) == want(kind)
    busy = E.as_of(e.where("event_type = 'view'").select("event_id", "ts"), e.where("event_type = 'error'").select("event_id", "ts", "user_id"))
    assert busy.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    nothing = e.limit(0)
    assert E.infer_service(nothing, e).count() == 0 and E.infer_service(e, nothing).count() == 0


@pytest.mark.parametrize("tile", [2_000, 7, 1])
def test_cochange_of_wide_commits(spark, tile):
    """Commits cut into tiles of files give what whole ones give."""
    rnd = random.Random(2)
    commits = [("wide", k) for k in range(60)] + [("wider", k) for k in range(0, 90, 2)] + [(f"c{n}", rnd.randrange(90)) for n in range(40) for _ in range(4)] + [(None, 1), ("c1", None)]
    by = {}
    for c, f in commits:
        if c is not None and f is not None:
            by.setdefault(c, set()).add(f)
    n = Counter((a, b) for files in by.values() for a in files for b in files if a != b)
    want = set()
    for f in range(90):
        best = sorted(((-k, b) for (a, b), k in n.items() if a == f and k >= 2))[:3]
        want |= {(f, b, -k, i + 1) for i, (k, b) in enumerate(best)}
    got = G.cochange(spark.createDataFrame(commits, "commit string, file long"), tile=tile)
    assert set(map(tuple, got.select("file", "partner", "n", "rank").collect())) == want


def test_cochange_counts_each_pair_once_in_bounded_tasks(spark, monkeypatch):
    """Tasks that count pairs grow in number with the pairs; a pair stands for both its files."""
    commits = [(c, f) for c in range(40) for f in range(c % 7, 20 + c % 5)]
    pairs = sum(k * (k - 1) // 2 for k in Counter(c for c, _ in commits).values())
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "PAIRS", 100)
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = {(r["file"], r["partner"]): r["n"] for r in G.cochange(spark.createDataFrame(commits, "commit long, file long"), top=99).collect()}
    by = [{f for c, f in commits if c == k} for k in range(40)]
    assert got == {(a, b): n for a in range(24) for b in range(24) if a != b and (n := sum(a in x and b in x for x in by)) >= 2}
    dealt = [x for p in plans for x in p.splitlines() if "RepartitionByExpression" in x and "partner" in x and "file" in x]
    assert dealt and all(x.rstrip().endswith(str(-(-pairs // 100))) for x in dealt)


def test_json_is_read_before_the_join(spark, tmp_path):
    """What is no JSON equals nothing, and the join compares spellings only."""
    from talus.plans.events import json_equality

    rows = [(1, '{"a": 1, "b": [2]}'), (2, '{"b":[2],"a":1.0}'), (3, "x"), (4, "x"), (5, None), (6, None), (7, '"c d"'), (8, '"c d"'), (9, '"cd"'), (10, "1"), (11, " 1 ")]
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    out = json_equality(spark, str(tmp_path))
    assert sorted(r["event_id"] for r in out.collect()) == [2, 8, 11]
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any("json" in x for x in joins)
