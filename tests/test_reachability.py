"""Components, reach counts, flows and longest paths against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import reachability as R


def table(spark, pairs):
    return spark.createDataFrame(pairs, "caller string, callee string").repartition(3)


def graphs():
    rnd = random.Random(4)
    name = lambda k: f"n{k:02}"
    dag = [(name(a), name(b)) for a in range(30) for b in rnd.sample(range(a + 1, 31), min(3, 30 - a))]
    cyclic = [(name(rnd.randrange(26)), name(rnd.randrange(26))) for _ in range(44)] + [("r0", name(1)), ("r1", name(2)), ("r1", "leaf"), ("r2", "r2"), ("r2", "x"), ("x", "y"), ("y", "x"), ("y", "z")]
    return {"dag": dag, "cyclic": cyclic, "self": [("a", "a")], "two": [("a", "b"), ("b", "a")]}


def callees(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    return {k: sorted(v) for k, v in out.items()}


def reached(near, start):
    seen, todo = {start}, [start]
    while todo:
        for c in near[todo.pop()]:
            if c not in seen:
                seen.add(c)
                todo.append(c)
    return seen - {start}


def deepest(near, root, fan, depth):
    best = [root]

    def walk(node, path):
        nonlocal best
        following = [c for c in near[node] if c not in path][:fan]
        if len(path) >= depth or not following:
            if len(path) > len(best):
                best = path
            return
        for c in following:
            walk(c, [*path, c])

    walk(root, [root])
    return best


@pytest.mark.parametrize("which", ["dag", "cyclic", "self", "two"])
def test_counts_and_components(spark, which):
    pairs = graphs()[which]
    near = callees(pairs)
    edges = table(spark, pairs)
    got = {r["id"]: r["head"] for r in R.cycles(edges).collect()}
    want = {}
    for a in near:
        same = {b for b in reached(near, a) if a in reached(near, b)} | {a}
        if len(same) > 1:
            want[a] = max(same)
    assert got == want
    if which == "self":
        return
    for reverse in (False, True):
        turned = near if not reverse else callees([(b, a) for a, b in pairs])
        n = {r["id"]: (r["reached"], r["exact"]) for r in R.reach_counts(edges, reverse).collect()}
        assert n == {a: (len(reached(turned, a)), True) for a in near if any(b != a for b in turned[a]) or any(a in v and a != k for k, v in turned.items())}


@pytest.mark.parametrize(("fan", "depth"), [(3, 12), (2, 5), (1, 12)])
def test_longest_paths(spark, fan, depth):
    for which, pairs in graphs().items():
        near = callees(pairs)
        roots = [k for k in sorted(near) if which != "dag" or k < "n20"]
        got = {r["root"]: r["path"] for r in R.longest_paths(table(spark, pairs), spark.createDataFrame([(r,) for r in roots], "id string"), fan, depth).collect()}
        assert got == {r: deepest(near, r, fan, depth) for r in roots}


def test_flows_count_exactly_beyond_sketches(spark):
    """With sketches of 16 hashes the counts of the top are estimates, and are counted again."""
    pairs = [(f"r{k}", f"m{k}_{j}") for k in range(12) for j in range(10 + 9 * k)] + [(f"m{k}_0", "end") for k in range(12)]
    edges = table(spark, pairs)
    n = {r["id"]: r for r in R.reach_counts(edges, lg=4).collect()}
    assert not n["r11"]["exact"] and n["r0"]["exact"] and n["r0"]["reached"] == 11
    assert abs(n["r11"]["reached"] - 110) < 110
    roots = spark.createDataFrame([(f"r{k}",) for k in range(12)], "id string")
    got = [tuple(r)[:3] for r in R.flows(edges, roots, 3, lg=4).collect()]
    assert got == [("r11", 3, 110), ("r10", 3, 101), ("r9", 3, 92)]
    assert {r["root"]: (r["reached"], r["path"]) for r in R.flows(edges, roots, None).collect()} == {f"r{k}": (11 + 9 * k, [f"r{k}", f"m{k}_0", "end"]) for k in range(12)}
    levels = {r["id"]: (r["dependents"], r["level"]) for r in R.criticality_of_all(edges).collect()}
    assert levels["end"] == (24, "critical") and levels["m3_0"] == (1, "low") and levels["r3"] == (0, "low")
    assert G.criticality(edges, spark.createDataFrame([("end",)], "id string")).first()["dependents"] == 24


def test_closures_write_no_edges(spark, monkeypatch):
    """The edges are read as they are: what closures write are nodes only."""
    written = []
    monkeypatch.setattr(G, "cut", lambda df: written.append(df.columns) or df)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b")], "caller string, callee string")
    roots = spark.createDataFrame([("c",)], "id string")
    assert {tuple(r) for r in G.closure(edges, roots, reverse=True).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    assert {tuple(r) for r in G.reach(edges, roots, reverse=True).collect()} == {("c", "c", 0), ("c", "b", 1), ("c", "a", 2)}
    assert written and not any("src" in columns for columns in written)


def test_counts_of_few_and_many_without_cycles(spark):
    """Nodes of exact pairs, of sketches, of callees alone and without callees, against closures by hand; no sketch is made for what
    nothing calls."""
    pairs = {("r", "m1"), ("r", "m2"), ("r", "x1"), ("m1", "x1"), ("m1", "x2"), ("m2", "x2"), ("flat", "x3"), ("big", "wide"), ("big", "x1")} | {("wide", f"w{k}") for k in range(40)}
    edges = spark.createDataFrame(sorted(pairs), "caller string, callee string")
    got = {r["id"]: (r["reached"], r["exact"]) for r in R.reach_counts(edges, lg=4).collect()}
    assert {n: got[n] for n in ("r", "m1", "m2", "flat", "x1")} == {"r": (4, True), "m1": (2, True), "m2": (1, True), "flat": (1, True), "x1": (0, True)}
    assert len(got) == len({n for p in pairs for n in p}) and not got["big"][1] and not got["wide"][1] and got["big"][0] > 16
    roots = spark.createDataFrame([("big",), ("r",), ("flat",)], "id string")
    assert {r["root"]: r["reached"] for r in R.flows(edges, roots, lg=4).collect()} == {"big": 42, "r": 4, "flat": 1}


def test_numbers_in_order_of_names(spark):
    """Numbers of nodes sort as their names do, and lead back to them."""
    from talus.plans import graph as P

    keys = [0, 1, 2, 9, 10, 11, 19, 100, 101, 110, 999, 1000, 123456789012345]
    nodes = spark.createDataFrame([(k * P.STEP + key,) for k in range(1, 7) for key in keys], "id long")
    rows = nodes.select("id", P.name(F.col("id")).alias("name"), P.ranked(F.col("id")).alias("code"), P.unranked(P.ranked(F.col("id"))).alias("back")).collect()
    assert [r["name"] for r in sorted(rows, key=lambda r: r["code"])] == sorted(r["name"] for r in rows)
    assert all(r["back"] == r["id"] for r in rows)


def test_flows_keep_no_table_that_is_read_no_more(spark):
    """Sketches, counts and levels are gone once the flows are known; what reaches nodes over several ways counts them once."""
    from pathlib import Path

    from talus.shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("cut-*"))
    edges = table(spark, [("r", "a"), ("r", "b"), ("r", "d"), ("a", "c"), ("b", "c"), ("c", "d"), ("s", "c"), ("q", "a"), ("q", "x")])
    roots = spark.createDataFrame([("r",), ("s",), ("q",)], "id string")
    got = {r["root"]: (r["reached"], r["path"]) for r in R.flows(edges, roots).collect()}
    assert got == {"r": (4, ["r", "a", "c", "d"]), "s": (2, ["s", "c", "d"]), "q": (4, ["q", "a", "c", "d"])}
    columns = [set(spark.read.parquet(str(p)).columns) for p in set(folder.glob("cut-*")) - before]
    assert columns and not any(c & {"sketch", "under"} or c == {"id", "height"} for c in columns)
