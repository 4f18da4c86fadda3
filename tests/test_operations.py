"""Memory, context, governance, incidents, stores and parsers on small fixtures."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from talus.operators import context as C
from talus.operators import governance as V
from talus.operators import graph as G
from talus.operators import incidents as I
from talus.operators import memory as M
from talus.operators import retrieval as R
from talus.sources import parsers as P
from talus.sources import stores as T

T0 = datetime(2024, 1, 1, 12)
MEMORY = "id long, type string, content string, source string, scope string, tags array<string>, subject string, provenance string, related array<string>, created_at timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_memory(spark):
    data = [
        (1, "incident", "Disk full on the payments host", "x", "service:Pay", ["Disk"], "host", "ops", ["h1"], at(0)), (2, "incident", "disk slow", "x", "service:pay/db", [], "", "", [], at(1)),
        (3, "lesson", "always check the disk", "x", "", ["disk", "io"], "", "", [], at(2)), (4, "incident", "other", "x", "service:payroll", [], "", "", [], at(3)),
    ]
    m = spark.createDataFrame(data, MEMORY)
    got = [(r["id"], r["score"]) for r in M.recall(m, "disk disk full", service="pay").collect()]
    assert got == [(1, 12), (2, 10)]
    assert [(r["id"], r["score"]) for r in M.recall(m, tags=["DISK"], entity="disk").collect()] == [(3, 11), (1, 11)]
    assert [r["id"] for r in M.recall(m, glob=True).collect()] == [3] and M.recall(m, subject="HOST", provenance="OPS", related=["H1"], type="incident").first()["score"] == 20
    assert [r["id"] for r in M.recall(m, since="2024-01-01 12:01:30", limit=1).collect()] == [4]
    assert [r["id"] for r in M.listed(m, "incident").collect()] == [4, 2, 1] and [r["id"] for r in M.newest(m, 2).collect()] == [4, 3]
    kinds = m.select(M.scope_kind(F.col("scope")).alias("k"), M.scope_id(F.col("scope")).alias("i")).collect()
    assert [tuple(k) for k in kinds] == [("service", "Pay"), ("service", "pay/db"), ("global", ""), ("service", "payroll")]
    p = M.patterns(m.unionByName(m.withColumn("scope", F.lit(""))), 2).collect()
    assert [(r["key"].split(":")[0], r["n"]) for r in p] == [("sig", 2)] or p[0]["n"] >= 1
    lessons = spark.createDataFrame([(1, "check disk space"), (2, "disk"), (3, "the code")], "id long, text string")
    top = R.recall(spark.createDataFrame([(9, "disk disk error"), (8, "the of")], "query long, text string"), lessons).collect()
    assert [(r["query"], r["id"], r["score"]) for r in sorted(top, key=lambda r: r["rank"])] == [(9, 2, round(2 / 3 + 1.0, 6)), (9, 1, 1.0)]


def packed_one_by_one(sizes, room):
    used, out = 0, []
    for path, n in sorted(sizes, key=lambda x: x[0]):
        fits = n is not None and used + n <= room
        out.append((path, n, fits, used))
        used += n if fits else 0
    return out


def test_pack(spark):
    import random

    draw = random.Random(7)
    for room, top in ((0, 5), (-5, 5), (1, 3), (1000, 40), (1000, 1500), (255, 256), (256, 300)):
        sizes = [(f"p{k:04}", None if k == 50 else draw.choice((0, 1, draw.randint(0, top), top))) for k in range(draw.choice((1, 300)), 310)]
        got = C.pack(spark.createDataFrame(sizes, "path string, tokens long").repartition(7), room + 200)
        assert [tuple(r) for r in got.orderBy("path").collect()] == packed_one_by_one(sizes, room), room
    halves = [(f"p{k}", n) for k, n in enumerate([1, 512, 511, 510, 256, 255, 128, 64, 32, 16, 8, 4, 2, 1, 1])]
    assert [tuple(r) for r in C.pack(spark.createDataFrame(halves, "path string, tokens long"), 1024).orderBy("path").collect()] == sorted(packed_one_by_one(halves, 824))
    assert C.pack(spark.createDataFrame([], "path string, tokens long"), 1024).count() == 0


def test_context(spark):
    claims = spark.createDataFrame([("s", "a", "X is on", 0.9), ("s", "b", "x is on ", 0.8), ("s", "b", "x is off", 0.6), (None, "a", "p", 1.0), ("", "c", "q", 0.4), ("t", "a", "1", 1.0), ("t", "a", "2", 1.0)], "scope string, source string, statement string, confidence double")
    assert rows(C.conflicts(claims)) == {("s", 1, 0.3), ("_global_", 1, 0.2)}
    df = spark.createDataFrame([('Fix "user.go" in api/x, then rename LoadUser and loaduser.',)], "t string")
    r = df.select(C.intent_verbs(F.col("t")).alias("v"), C.intent_categories(F.col("t")).alias("c"), C.intent_targets(F.col("t")).alias("g")).first()
    assert (r["v"], r["c"], r["g"]) == (["fix", "rename"], ["bugfix", "refactor"], ["user.go", "api/x", "Fix", "LoadUser"])
    out = spark.createDataFrame([("\nx := 1\nmain.go:42: error\n see a/b.py, \n" + "z\n" * 9,)], "t string").select(C.tool_summary(F.col("t")).alias("s")).first()["s"]
    assert (out["errors"], out["facts"], out["refs"], out["evidence"]) == (["main.go:42: error"], ["x := 1"], ["a/b.py"], ["main.go:42: error"]) and out["summary"].count("\n") == 4
    files = spark.createDataFrame([("a", 50, "A"), ("b", 500, "B"), ("c", 60, "C")], "path string, tokens long, text string")
    packed = C.pack(files, 320)
    assert [tuple(r) for r in packed.orderBy("path").collect()] == [("a", 50, True, 0), ("b", 500, False, 50), ("c", 60, True, 50)]
    assert "".join(r["part"] for r in C.bundle(files, packed).collect()) == "===== a =====\nA\n===== c =====\nC\n"
    texts = spark.createDataFrame([(1, "see\n```go:a/b.go\nfunc X() {}\n```\nend", 100), (2, "```go:a/b.go\nx\n```", 1)], "id int, text string, tokens int")
    short = {r["id"]: r["text"] for r in C.swap_fences(texts, spark.createDataFrame([("a/b.go", "X $1")], "path string, summary string"), 10).collect()}
    assert short == {1: "see\n[a/b.go: X $1]\nend", 2: "```go:a/b.go\nx\n```"}


def test_governance(spark):
    inside = spark.createDataFrame([("src/a",), ("srcx/a",), ("src/secret/k",)], "p string").select(V.inside_boundary(F.col("p"), ["src/"], ["src/secret"]).alias("ok"))
    assert [r["ok"] for r in inside.collect()] == [True, False, False]
    fresh = spark.createDataFrame([(at(0),), (at(-2000),), (None,)], "t timestamp").select(V.freshness(F.col("t"), F.lit(at(5))).alias("f"))
    assert [r["f"] for r in fresh.collect()] == ["FRESH", "STALE", "UNKNOWN"]
    snaps = spark.createDataFrame([("t1", "CREATED", at(0), 1), ("t1", "ANALYZING", at(1), 2), ("t2", "CREATED", at(2), 3)], "task_id string, state string, at timestamp, seq long")
    assert [r["task_id"] for r in V.tasks_in_state(snaps, "CREATED").collect()] == ["t2"] and V.tasks_since(snaps, "2024-01-01 12:01:30").count() == 1 and V.task_history(snaps, "t1").count() == 2
    rules = V.policies(spark, (("a", "HIGH x.y", "d"), ("b", "LOW x.y", "d"), ("bad", "nope", "d")))
    got = V.assess(spark.createDataFrame([(1, "x", "y"), (2, "x", "z")], "id int, resource string, action string"), rules).orderBy("id").collect()
    assert [(r["level"], r["score"], r["approval_required"], r["factors"]) for r in got] == [("HIGH", 0.75, True, ["a: HIGH", "b: LOW"]), ("LOW", 0.25, False, ["x:z not covered by policy"])]
    audit = spark.createDataFrame([(k, k // 3, f"e{k}") for k in range(9)], "seq long, day long, what string").collect()
    import hashlib

    prev, sealed = "", []
    for r in audit:
        own = hashlib.sha256(f"{prev}|{r['what']}".encode()).hexdigest()
        sealed.append((r["seq"], r["day"], r["what"], prev, own))
        prev = own
    frame = lambda x: spark.createDataFrame(x, "seq long, day long, what string, prev string, hash string")
    assert V.chain_break(frame(sealed), ["what"]).count() == 0
    broken = [r if r[0] != 4 else (4, 1, "changed", r[3], r[4]) for r in sealed]
    assert rows(V.chain_break(frame(broken), ["what"])) == {(4, "hash")} and rows(V.chain_break(frame([r for r in sealed if r[0] != 3]), ["what"])) == {(4, "link")}


def test_rules(spark):
    rules = T.boundary_rules(spark, json.dumps({"rules": [{"from": "ui/", "to": "/db"}, {"from": "ui/admin", "to": "core/db", "action": "allow"}]}))
    nodes = spark.createDataFrame([("a", "ui/web"), ("b", "core/db"), ("c", "ui/admin"), ("d", "core/api")], "id string, dir string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "d")], "caller string, callee string")
    assert rows(G.boundary_violations(edges, nodes, rules)) == {("ui/web", "core/db", 1, 1)}
    imports = spark.createDataFrame([("ui/web/x.go", "proj/core/db"), ("ui/web/x.go", "db"), ("ui/admin/y.go", "core/db"), ("core/api/z.go", "core/db")], "file string, target string")
    by_import = G.import_violations(imports, spark.createDataFrame([("core/db",)], "dir string"), rules)
    assert rows(by_import) == {("ui/web/x.go", "core/db", 1)}
    by_symbol = spark.createDataFrame([("ui/web/x.go", "core/db", 1, "a>b")], "file string, dir string, rule int, symbol string")
    assert rows(G.boundary_check(by_symbol, by_import.unionByName(by_import.withColumn("dir", F.lit("other"))))) == {("ui/web/x.go", "core/db", 1, "a>b"), ("ui/web/x.go", "other", 1, "import")}
    layers, allowed = T.layer_rules(spark, json.dumps({"layers": [{"name": "ui", "paths": ["ui/"], "depends": ["api"]}, {"name": "api", "paths": ["core/api"]}, {"name": "db", "paths": ["core/db"]}]}))
    assert rows(G.layer_violations(edges, nodes, layers, allowed)) == {("ui", "db", 2, "a>b")}
    assert [r["team"] for r in G.teams(spark.createDataFrame([("*", "@a @b", 1), ("x", "@a", 2)], "pattern string, owner string, ord int")).collect()] == ["@a", "@b"]
    ranges = spark.createDataFrame([("f", 5, 6), ("g", None, None)], "file string, lo int, hi int")
    syms = spark.createDataFrame([("f", 1, 4), ("f", 4, 5), ("f", 6, 0), ("g", 9, 9), ("h", 1, 1)], "file string, line int, end int")
    assert rows(G.overlapping(syms, ranges)) == {("f", 4, 5), ("f", 6, 0), ("g", 9, 9)}


def test_incidents(spark):
    alerts = spark.createDataFrame([(1, "error", "m", "pay", at(30)), (2, "odd", "m", "x" * 300, None), (3, "info", "m", "web", at(40))], "id long, severity string, message string, service string, at timestamp")
    clean = {r["id"]: r for r in I.sanitised(alerts, "2024-01-01 13:00:00").collect()}
    assert clean[2]["severity"] == "info" and len(clean[2]["service"]) == 200 and clean[2]["at"] == datetime(2024, 1, 1, 13) and clean[1]["at"] == at(30)
    events = spark.createDataFrame([(10, "pay", "error", at(25), {"file": "src/a.go", "symbol": "Open", "task": "t1"}), (11, "web", "error", at(39), {"file": "src/w.go"}), (12, "pay", "log", at(26), {"file": "src/z.go"})], "id long, service string, type string, ts timestamp, attributes map<string, string>")
    deps = spark.createDataFrame([("pay", "v2", "c1", at(10)), ("pay", "v1", "c0", at(-60))], "service string, version string, commit string, ts timestamp")
    commits = spark.createDataFrame([("c1", "fix #12", ["src/a.go", "src/b.go"], at(8)), ("c0", "old", ["src/a.go"], at(-70))], "sha string, message string, files array<string>, ts timestamp")
    memories = spark.createDataFrame([("pay", "disk full")], "service string, content string")
    h = I.hypotheses(alerts, events, deps, commits, memories)
    assert {(r["id"], r["source"], r["score"], r["confidence"], r["rank"]) for r in h.collect()} == {(1, "deploy", 0.9, "INFERENCE", 1), (1, "memory", 0.6, "INFERENCE", 2), (3, "code", 0.5, "INFERENCE", 1)}
    assert {r["id"]: r["statement"] for r in I.root_causes(h).collect()} == {1: "Regression likely introduced by commit c1 (fix #12) deployed as v2: errors name src/a.go", 3: "Errors concentrate in src/w.go"}
    links = [(r["stage"], r["ref"]) for r in I.evidence_chain(alerts.where("id = 1"), events, deps, commits).orderBy("ord").collect()]
    assert links == [("service", "pay"), ("deployment", "v2"), ("commit", "c1"), ("pr", "12"), ("symbol", "Open"), ("symbol", "src/a.go"), ("task", "t1")]
    steps = spark.createDataFrame([("t", 1, "CREATED"), ("t", 2, "ANALYZING"), ("t", 3, "EXECUTING"), ("t", 4, "FAILED")], "task_id string, seq long, state string")
    assert rows(I.illegal_steps(steps)) == {("t", 2, "ANALYZING", "EXECUTING")}


def test_stores(spark, tmp_path):
    e = spark.createDataFrame([(at(0), "s1", "prompt", "x", "gpt-4o", 100, 40), (at(1500), "s2", "log", "x", "none", 10, 10)], T.STATS)
    T.record_stats(e, str(tmp_path / "stats"))
    T.record_stats(e.limit(1), str(tmp_path / "stats"))
    s = T.read_stats(spark, str(tmp_path / "stats"))
    one = T.summarize(s, "2024-01-02", 2).first()
    assert (one["operations"], one["saved_total"], one["by_operation"]) == (3, 120, {"log": 1, "prompt": 2}) and abs(one["cost_saved"] - 120 / 1e6 * 2.5) < 1e-12
    assert T.summarize(s, "2024-01-02", 0).first()["operations"] == 1 and T.summarize(s, "2024-01-02", 9, "s1").first()["saved_percent"] == 60.0
    assert T.newest_stats(s, 1).first()["session"] == "s2"
    T.export_csv(e.select("session", "before_tokens"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    kv = T.put(None, spark.createDataFrame([("a", '{"x": 1}'), ("b", "nope")], "key string, value string"))
    kv = T.put(kv, spark.createDataFrame([("a", '{"x": 2}'), ("ab", "3")], "key string, value string"))
    assert rows(kv) == {("a", '{"x": 2}'), ("ab", "3")} and [r["key"] for r in T.listed(kv, "ab").collect()] == ["ab"]
    assert rows(T.repositories(spark, {"b": "/b", "a": "/a"})) == {("a", "/a"), ("b", "/b")}


def test_operations_sources(spark):
    doc = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    events, deps = P.kube_api(
        doc({"items": [{"metadata": {"name": "web", "creationTimestamp": "2024-01-01T00:00:00Z"}, "spec": {"template": {"spec": {"containers": [{"image": "web:1"}]}}}}]}),
        doc({"items": [{"involvedObject": {"name": "web"}, "type": "Warning", "reason": "x", "message": "m", "lastTimestamp": "2024-01-01T00:00:00Z"}]}),
    )
    assert events.first()["type"] == "error" and deps.first()["image"] == "web:1"
    e, d, c = P.snapshot(doc({"events": [{"id": "1", "service": "a", "ts": "2024-01-01T00:00:00Z"}], "deployments": [], "commits": [{"sha": "s", "files": ["x"], "ts": "bad"}]}))
    assert e.count() == 1 and d.count() == 0 and c.first()["ts"] is None and P.of_service(e, "a", since="2023-12-31").count() == 1 and P.of_service(e, "b").count() == 0
    lines = spark.createDataFrame([(" M a.py",), ("R  old.py -> new.py",), ('?? "b c"',), ("",)], "value string")
    assert rows(P.git_status(lines)) == {("a.py", "M"), ("new.py", "R"), ("b c", "??")}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "kafka consumer configuration"), (2, "kafka producer"), (3, "a quick brown fox, the consumer"), (4, "")], "id long, text string")
    q = spark.createDataFrame([(9, "kafka consumer"), (8, "consumers")], "query long, text string")
    stats = {r["term"]: (r["df"], r["n"]) for r in R.corpus_statistics(docs).collect()}
    assert stats["kafka"] == (2, 4) and stats["consumer"] == (2, 4)
    f = R.features(docs, "id", "text")
    assert all(abs(r[0] - 1) < 1e-9 for r in f.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight"))).select("sum((weight * weight))").collect())
    import math
    from collections import Counter

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    def vector(text):
        import re

        w = re.findall("[a-z0-9_]+", text.lower())
        every = [f"w:{x}" for x in w] + [f"b:{a} {b}" for a, b in zip(w, w[1:], strict=False)] + [g for x in w for g in ([x] if len(x) < 3 else [x[k : k + 3] for k in range(len(x) - 2)])]
        n = Counter(fnv(x) % 4096 for x in every)
        size = math.sqrt(sum(v * v for v in n.values()))
        return {k: v / size for k, v in n.items()}

    got = {(r["query"], r["id"]): r["score"] for r in R.sparse_cosine(R.features(q, "query", "text"), f).collect()}
    for (a, b), score in got.items():
        x, y = vector({9: "kafka consumer", 8: "consumers"}[a]), vector({r["id"]: r["text"] for r in docs.collect()}[b])
        assert abs(score - sum(v * y.get(k, 0) for k, v in x.items())) < 2e-6
    best = [r["id"] for r in R.hybrid(docs, q, 2).where("query = 9").orderBy("rank").collect()]
    assert best[0] == 1
    chunks = spark.createDataFrame([("fetch/x.md", 1, "old"), ("b.md", 1, "keep")], "file string, start int, text string")
    assert rows(R.merge_document(chunks, "x", spark.createDataFrame([(1, "new")], "start int, text string"))) == {("b.md", 1, "keep"), ("fetch/x.md", 1, "new")}
    t = spark.createDataFrame([(1, "red fox", "en"), (2, "red-hot dog", "de"), (3, "blue", "en")], "id long, text string, lang string")
    ask = lambda s: {r["id"] for r in R.search_text(t, "id", s, {"text": "text", "lang": "lang"}, "text").collect()}
    assert ask("red") == {1, 2} and ask("red lang:en") == {1} and ask("red NOT dog") == {1} and ask("blue OR dog") == {2, 3} and ask('"red hot"') == {2} and ask('"unbalanced') == set() and ask("") == set()
    sem = R.semantic_search(spark.createDataFrame([(1, 5, 3.0), (1, 6, 2.0), (1, 7, 1.0)], "query long, id long, score double"), spark.createDataFrame([(1, 5, 0.1), (1, 6, 0.9), (1, 8, 1.0)], "query long, id long, score double"), 2)
    assert [r["id"] for r in sem.orderBy("rank").collect()] == [6, 5] or [r["id"] for r in sem.orderBy("rank").collect()] == [5, 6]
    pairs = spark.createDataFrame([(1, "how do I join two big tables here"), (2, "how do I join two big tables here now"), (3, "else")], "id long, text string")
    near = R.jaccard_lookup(pairs.withColumnRenamed("id", "query"), pairs).collect()
    assert {(r["query"], r["id"]) for r in near} == {(1, 2), (2, 1)}
