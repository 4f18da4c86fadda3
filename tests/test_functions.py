"""Text functions, parsers and graph operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from talus.functions import diffs as D
from talus.functions import logs as L
from talus.functions import pii as I
from talus.functions import prose as W
from talus.functions import scan as X
from talus.functions import schema as J
from talus.functions import text as T
from talus.operators import graph as G
from talus.operators import retrieval as R
from talus.sources import parsers as P


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_token_estimate(spark):
    assert one(spark, T.token_estimate, "") == 0
    assert one(spark, T.token_estimate, "a") == 1
    assert one(spark, T.token_estimate, "one two three") == (11 + 3) // 4


def test_logs(spark):
    log = "2024-01-01T00:00:00 INFO start\n2024-01-01T00:00:01 ERROR broken\n---\n\n\nkept: a\nkept: a\nshort\nheartbeat ok=1\nat run (x)\n"
    want = "ERROR broken\n\nkept: a\nat run (x)"
    assert one(spark, L.compress_log, log) == want and one(spark, L.compress_log, None) == "" == one(spark, L.compress_log, "\n \n---\n")
    assert one(spark, L.compress_log, "\n".join(f"k={k}" for k in range(300))).count("\n") == 199
    gaps = "\n\n".join(f"k={k}" for k in range(300))
    for most, lines in ((200, 201), (201, 201), (202, 203), (1, 1)):
        out = one(spark, lambda c: L.compress_log(c, most), gaps).split("\n")  # noqa: B023
        assert len(out) == lines and out == gaps.split("\n")[:lines], most
    assert one(spark, L.compress_log, "  a=1 \t\n\nb=1\n\na=1\nb=1\nc=1") == "  a=1\n\nb=1\n\nc=1"
    long = "\n".join(f"12:00:0{k % 10} ERROR step {k % 5000}" for k in range(60_000))
    assert one(spark, lambda c: L.compress_log(c, 10_000), long).split("\n") == [f"ERROR step {k}" for k in range(5000)]
    assert one(spark, L.compact_output, "[INFO] x\n a \nDownloading y\nerror z") == "a\nerror z" and one(spark, L.compact_output, None) == ""
    many = "\n".join([*(f"l{k}" for k in range(70)), "a warning"])
    assert one(spark, L.compact_output, many).split("\n")[59:] == ["l59", "a warning"]
    assert one(spark, L.compact_output, "\n".join(f"fail {k}" for k in range(500))).count("\n") == 119
    assert one(spark, T.fit_lossless, "a\nb\na\n") == "a\nb\n"


def test_budget():
    text = "\n".join([*(f"head {k}" for k in range(30)), "fatal error here", *("tail" for _ in range(50)), "é" * 50])
    for n in range(1, 60):
        out = L.fit_budget(text, n)
        assert out and L.count_tokens(out) <= n
    assert "fatal error here" in L.fit_budget(text, 45) and L.KEPT_MARK in L.fit_budget(text, 45)
    assert L.fit_budget("a b", 50) == "a b" and L.fit_budget("", 5) == "" == L.fit_budget("x", 0)


def test_chunks():
    parts = L.chunk_text("\n".join(["ü" * 1500, "b" * 100, "", "", "c" * 10]))
    assert all(40 <= len(p.encode()) <= 2000 for _, p in parts) and sum(p.count("ü") for _, p in parts) == 1500
    assert parts[-1] == (1, "b" * 100 + "\n\n\n" + "c" * 10)
    assert L.chunk_text("") == [] and L.chunk_text("\n\n" + "x" * 60) == [(3, "x" * 60)]


def test_prose():
    assert W.strip_reply("Sure!\nx = 1\n\n\nWell, I think that, you know, it just works.\n```\nsure\n```\nLet me know if you need more") == ("x = 1\n\nIt just works.\n```\nsure\n```", 2)
    assert W.strip_prompt("Hello there\nfix parse() now\nthanks in advance!") == ("fix parse() now", 2)
    assert W.strip_prompt("Thanks!") == ("Thanks!", 0)
    assert W.compress_prompt_text("  a line  \n\n\na line\na line\nthanks\n") == "a line\n\na line"
    assert W.payload("- item") and not W.payload("plain words") and W.small_talk("sure great question")


def test_html(spark):
    html = "<html><title> T </title><script>bad()</script><p>a &amp; b</p><!-- c --><div>d</div></html>"
    assert one(spark, T.html_to_text, html) == "T\na & b\nd"
    assert one(spark, T.html_to_text, "a<b>b</b>&#65;&#x1F600;&lt;&#0;") == "a b A😀<&#0;"
    assert one(spark, T.html_title, html) == "T"


def test_segments_and_hash(spark):
    assert one(spark, T.identifier_segments, "parseHTTPResponse2xx_old") == ["parse", "http", "response2xx", "old"]
    assert one(spark, T.fnv32, "a") == 0xE40C292C
    assert one(spark, T.strip_diacritics, "Ñandú") == "nandu"
    assert one(spark, T.first_failure, "ok\nfatal: no\nx") == "fatal: no"


@pytest.mark.parametrize(
    ("text", "label", "n"),
    [
        ("mail a.b@example.com or c@example.org", "EMAIL", 2), ("boxicons@2.1.4", "EMAIL", 0), ("at 8.8.8.8", "IP", 1), ("at 192.168.0.1 and 127.0.0.1", "IP", 0), ("2001:db8::1 x", "IPV6", 1),
        ("fe80::1", "IPV6", 0), ("call +49 170 1234567", "PHONE", 1), ("id 12345678901234567890", "PHONE", 0), ("123-45-6789", "SSN", 1), ("AKIA" + "A" * 16, "AWS", 1),
        ("AKIA" + "A" * 17, "AWS", 0), ("api_key = 'abcdefghijklm'", "KEY", 1), ("password: hunter2", "PASSWORD", 1), ("password: hunter", "PASSWORD", 0), ("https://me:pw1@host/x", "URL_CRED", 1),
        ("ghp_" + "a1" * 16, "GITHUB", 1), ("Bearer " + "x" * 24, "BEARER", 1), ("eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "JWT", 1), ("plain words", "EMAIL", 0),
    ],
)
def test_labels(text, label, n):
    masked, names, count = I.mask_text(text)
    assert count.get(label, 0) == n and I.unmask_text(masked, names) == text


def test_masking(spark):
    import base64

    secret = "password = hunter2hunter2"
    for run in (base64.b64encode(secret.encode()).decode(), secret.encode().hex(), "".join(f"%{b:02x}" for b in secret.encode()), "".join(f"\\u{ord(c):04x}" for c in secret)):
        masked, names, _ = I.mask_text(f"x {run} y")
        assert run not in masked and len(names) == 1 and I.unmask_text(masked, names) == f"x {run} y"
    assert I.mask_text(base64.b64encode(b"an image of a cat, no secret at all").decode())[2] == {}
    text = "Ann met ann at a@b.org"
    masked, names, count = I.mask_text(text, ("Ann",))
    assert count == {"NAME": 2, "EMAIL": 1} and I.unmask_text(masked, names) == text
    row = spark.createDataFrame([(text,)], "t string").select(I.mask("t", ("Ann",)).alias("m"), "t").select("*", I.unmask(F.col("m.masked"), F.col("m.names")).alias("back")).first()
    assert row["m"]["masked"] == masked and row["back"] == text


def test_security(spark):
    rules = lambda path, text: [(r[1], r[2]) for r in X.findings_of(path, text)]
    assert rules("a.go", 'x\ndb.Query("select " + id)') == [(2, "sql-injection")]
    assert rules("a.go", "h := md5.New()") == [(1, "weak-crypto")] and rules("a.go", 're = regexp.MustCompile("md5.New()")') == []
    assert rules("a.go", "// password=secret123") == [] and rules("a_test.go", "h := md5.New()") == []
    assert rules("a.js", "Math.random()") == [] and rules("a.js", "token = Math.random()") == [(1, "insecure-random")]
    assert rules("a.html", '<input placeholder="x@example.com">') == [] and rules("a.css", "/* x@example.com */") == []
    assert rules("app.yml", "db.password: hunter2\nssl.verify=false") == [(1, "hardcoded-config-cred"), (1, "hardcoded-secret"), (2, "disabled-ssl-verify")]
    assert rules("v.js", "x" * 2500 + " md5.New()") == []
    f = X.scan_files(spark.createDataFrame([("a.go", "md5.New()\neval(x)"), ("b.go", None)], "path string, text string"))
    assert {(r["severity"], r["n"]) for r in X.severity_counts(f).collect()} == {("warning", 1), ("info", 1)}
    assert X.by_severity(f, ["INFO "]).count() == 1 and X.by_severity(f, []).count() == 2


def test_schema(spark):
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "min": 1, "max": 3}, "b": {"type": "array", "items": {"type": "string", "pattern": "^x", "minLength": 2}}, "c": {"enum": [1, "two"]}}, "additionalProperties": False}
    asked = {
        '{"a": 2, "b": ["xy"], "c": "two"}': [],
        '{"b": ["y", 3], "c": 5, "d": 0}': ["$.a: missing required field", "$.d: unexpected field", "$.b[0]: shorter than minLength 2", "$.b[0]: does not match pattern ^x", "$.b[1]: expected type string", "$.c: not in enum"],
        '{"a": 9.0}': ["$.a: over max 3"], '{"a": 2.0, "c": 1e0}': [], '{"a": 0}': ["$.a: under min 1"], '{"a": 1.5}': ["$.a: expected type integer"],
        '{"a": true}': ["$.a: expected type integer"], '{"a": null}': ["$.a: expected type integer"], '{"a": 1, "b": {}}': ["$.b: expected type array"], '{"a": 1, "b": []}': [],
        '{"a": 1, "z": 1, "d": [1]}': ["$.d: unexpected field", "$.z: unexpected field"], "[]": ["$: expected type object"], ' {"a": 1} ': [], "null": ["$: expected type object"],
    }
    asked |= {x: ["output is not valid JSON"] for x in ("nope", "", "1 2", '{"a": 1}}', "1, 2", "1] [2", '{"a": 1', '{"a": 1, "a": 2}', '1}, {"v": 2')}
    df = spark.createDataFrame([(x,) for x in [*asked, None]], "x string").select("x", J.validate("x", json.dumps(s)).alias("v"))
    got = {r["x"]: r["v"] for r in df.collect()}
    assert got.pop(None) == ["output is not valid JSON"] and got == asked
    deep = {"type": "array", "items": {"type": "object", "properties": {"k v": {"type": "array", "items": {"enum": [None, {"p": 1, "q": [True]}, "x"]}}, "n": {"type": "null"}, "s": {"type": "string", "maxLength": 2, "pattern": "("}}}}
    text = '[{"k v": [null, {"q": [true], "p": 1.0}, "x", "y"], "n": null}, 3, {"n": 0, "s": "üa"}]'
    assert one(spark, lambda c: J.validate(c, json.dumps(deep)), text) == ["$[0].k v[3]: not in enum", "$[1]: expected type object", "$[2].n: expected type null", "$[2].s: longer than maxLength 2", "$[2].s: schema declares invalid pattern ("]
    assert one(spark, lambda c: J.validate(c, "{}"), "[1]") == []
    pairs = spark.createDataFrame([('{"a": 1, "b": [2]}', '{"b":[2.0],"a":1}'), ("nope", "{}"), ("1", "1 2"), ("[1]", "[1, 2]")], "x string, y string")
    assert [r["e"] for r in pairs.select(J.equal_json(F.col("x"), F.col("y")).alias("e")).collect()] == [True, None, None, False]


def test_diffs(spark):
    d = D.diff_text("a\nb\nc", "a\nx\nc")
    assert d.split("\n")[3:] == [" a", "-b", "+x", " c"] and D.diff_text("a", "a") == ""
    git = "diff --git a/src/app/x.go b/src/app/x.go\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+// fix crash\n+func Open() {\n-old\ndiff --git a/src/app/y.go b/src/app/z.go\n+x"
    assert D.message_of(git).split("\n") == ["fix(app): open", "", "- src/app/x.go (2+,1-)", "- src/app/z.go (renamed) (1+,0-)"]
    assert D.message_of("") == "chore: update" and D.change_type(D.parse_diff("diff --git a/a_test.go b/a_test.go\n+add")) == "test"
    assert one(spark, D.diff_summary, git).startswith("## a/src/app/x.go b/src/app/x.go\n@@ -1 +1 @@\n+// fix crash")
    assert one(spark, D.harmless, "a\n b\x01c" + "d" * 600) == "a bc" + "d" * 496
    assert D.symbols_in("rename `Store.Save` in db/conn.go and GetUser") == ["Store.Save", "conn", "GetUser"] or D.symbols_in("rename `Store.Save` in db/conn.go and GetUser")[0] == "Store.Save"
    assert D.symbols_in("Save") == ["Save"]
    texts = spark.createDataFrame([(1, "see a/b.go:3, a/b.go:9 and Store.Save on /api/users, not /api/none or /2024/01/02")], "id long, text string")
    files = spark.createDataFrame([("a/b.go", 5)], "path string, lines long")
    syms = spark.createDataFrame([("Store.Save", "Save", False, ""), ("list", "list", True, "/v1/api/users")], "full_name string, name string, entry boolean, route string")
    assert {tuple(r) for r in D.check_claims(texts, files, syms).collect()} == {(1, "file", "a/b.go:3", True), (1, "file", "a/b.go:9", False), (1, "symbol", "Store.Save", True), (1, "route", "/api/users", True), (1, "route", "/api/none", False)}
    row = spark.createDataFrame([("Hi {{name}}, {{ .n }} {{x}}", "A$1", 3)], "t string, a string, n int").select(D.render(F.col("t"), {"name": F.col("a"), "n": F.col("n")})).first()
    assert row[0] == "Hi A$1, 3 {{x}}"


def test_parsers(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    m = P.prometheus(lines("# HELP x", 'up{service="api"} 1 1700000000000', "bad line here now", "down 0")).collect()
    assert [(r["service"], r["message"], r["value"]) for r in m] == [("api", "up", 1.0), (None, "down", 0.0)]
    o = P.otel(lines('{"logs":[{"service":"a","severity":"ERROR","body":"x","time":"2024-01-01T00:00:00Z"},{"service":"","time":"2024-01-01T00:00:00Z"}],"traces":[],"metrics":[{"service":"b","name":"m","time":"nope"}]}'))
    assert [r["type"] for r in o.collect()] == ["error"]
    e, d = P.kubernetes(lines('{"events":[{"type":"Normal","reason":"BackOff","object":"p","time":"2024-01-01T00:00:00Z"}],"deployments":[{"name":"p","image":"i","time":"2024-01-01T00:00:00Z"}]}'))
    assert e.first()["type"] == "error" and d.count() == 1
    assert P.git_log(lines("c1\na.py\nb.py\n\nc2\na.py")).count() == 3
    assert [tuple(r) for r in P.codeowners(lines("# c", "*.py @a @b")).collect()] == [("*.py", "@a"), ("*.py", "@b")]
    diff = "diff --git a/x b/x\n@@ -1,0 +2,3 @@\n+a\n@@ -9 +12 @@\n+b\ndiff --git a/y b/y\nBinary files differ"
    assert {tuple(r) for r in P.changed_ranges(lines(diff)).collect()} == {("x", 2, 4), ("x", 12, 12), ("y", None, None)}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("d", "e")], "caller string, callee string")
    roots = spark.createDataFrame([("c",)], "id string")
    assert {tuple(r) for r in G.closure(e, roots, reverse=True).collect()} == {("c", 0), ("b", 1), ("a", 2), ("t", 3)}
    assert tuple(G.shortest_path(e, "t", "c").first()) == (["t", "a", "c"], 2)
    assert G.shortest_path(e, "t", "e").count() == 0
    labels = {r["id"]: r["label"] for r in G.label_propagation(e).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["d"]
    wide = {r["id"]: r["label"] for r in G.label_propagation(e, gate=2).collect()}
    assert wide["a"] == wide["b"] == wide["c"] != wide["d"] == wide["e"]
    long = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(60)], "caller string, callee string")
    far = G.closure(long, spark.createDataFrame([("n000",)], "id string")).agg(F.max("dist")).first()[0]
    assert far == 60 and G.shortest_path(long, "n000", "n060").first()["hops"] == 60
    owners = G.owners(spark.createDataFrame([("src/a/b.go",), ("src/c.tar.gz",), ("x",)], "path string"), spark.createDataFrame([("*", "all", 0), ("src/", "s", 1), ("src/a/", "a", 2), ("*.go", "g", 3), ("x", "x", 4)], "pattern string, owner string, ord int"))
    assert {tuple(r) for r in owners.collect()} == {("src/a/b.go", "a"), ("src/c.tar.gz", "s"), ("x", "x")}


def test_dense_and_fuse(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vec array<double>")
    got = R.dense_top(v, v.where("id = 1").withColumnRenamed("id", "query"), 1).collect()
    assert [(r["query"], r["id"]) for r in got] == [(1, 2)]
    lists = spark.createDataFrame([(1, 5, 1), (1, 5, 2)], "query long, id long, rank int")
    assert abs(R.fuse(lists).first()["score"] - round(1 / 61 + 1 / 62, 6)) < 1e-9
