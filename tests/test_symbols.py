"""Source trees: admission, extraction, and the questions asked of an index built from them."""

import pytest
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import knowledge as K
from talus.operators import symbols as S
from talus.sources import extract as X
from talus.sources import project as P

TREE = {
    "store/store.go": 'package store\nimport "fmt"\n// Store keeps things.\ntype Store struct {\n\tBase\n\tn int\n}\nfunc (s *Store) Save(x int) error {\n\ts.check("a(b)")\n\tfmt.Println("call(")\n\treturn helper(x)\n}\nfunc (s *Store) check(t string) {}\nfunc helper(x int) error { return nil }\nfunc unused() {}\n',
    "api/api.go": 'package api\nimport "store"\nfunc Serve() {\n\tr.HandleFunc("/a", Handle)\n}\nfunc Handle() {\n\tstore.helper(1)\n\tw := &Store{}\n\tw.Save(1)\n}\nfunc main() {\n\tServe()\n}\n',
    "api/api_test.go": "package api\nfunc TestHandle() {\n\tHandle()\n}\n",
    "py/shapes.py": 'class Shape:\n    """def fake(): """\n    def area(self):\n        pass\n\nclass Square(Shape):\n    def area(self):\n        return side(2)\n\ndef side(n):\n    # def no(): pass\n    return n\n\ndef total(s):\n    return Shape.area(s)\n',
    "web/App.vue": '<template><div onclick="no()"></div></template>\n<script lang="ts">\nexport function load(x) {\n  return fetchAll(x)\n}\n</script>\n',
    "run": "#!/usr/bin/env python\ndef go():\n    side(1)\n",
    "gen/x.pb.go": "package gen\nfunc Made() {}\n",
    "node_modules/x.js": "function no() {}\n",
    "skip/me.py": "def no(): pass\n",
    "keep/log.py": "def yes(): pass\n",
    "bin.py": "def no():\x00 pass\n",
    "min.js": "x" * 6000,
    ".gitignore": "# c\nskip/\n*.log\n/keep/*\n!keep/log.py\n",
    "docs/guide.md": "# Guide\n\n" + "words and words " * 10 + "\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    return P.read_tree(spark, str(root)).cache()


@pytest.fixture(scope="module")
def index(tree):
    return P.build_index(P.admitted(tree))


def rows(df):
    return {tuple(r) for r in df.collect()}


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_admission(tree):
    got = {r["path"]: (r["lang"], r["generated"]) for r in P.admitted(tree).collect()}
    assert got == {
        "store/store.go": ("go", False), "api/api.go": ("go", False), "api/api_test.go": ("go", False), "py/shapes.py": ("python", False), "web/App.vue": ("typescript", False),
        "run": ("python", False), "gen/x.pb.go": ("go", True), "keep/log.py": ("python", False), "docs/guide.md": ("markdown", False),
    }


def test_ignore_rules(spark):
    rules = {line: P.ignore_rule(line) for line in ("", "# x", "!a", "a/", "/a", "a/b", "[z-a]", "*.py", "**/x", "a?c", "[!a]b", "\\#x")}
    assert rules[""] is None and rules["# x"] is None and rules["[z-a]"] is None and rules["!a"][1]
    files = spark.createDataFrame([(".gitignore", "build/\n!build/keep.go\n*.tmp\n!keep.tmp\n/top\n"), ("sub/.gitignore", "x.py\n!y.tmp\n")], "path string, text string")
    paths = ["build/keep.go", "a/build/b.go", "a.tmp", "keep.tmp", "top", "sub/top", "x.py", "sub/x.py", "sub/d/x.py", "sub/y.tmp", "building.go"]
    got = rows(P.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), P.ignore_rules(files)))
    assert got == {(p,) for p in ("build/keep.go", "a/build/b.go", "a.tmp", "top", "sub/x.py", "sub/d/x.py")}


def test_banners(spark):
    cases = [("a.go", "// Code generated by x. DO NOT EDIT.\n", True), ("a.go", 's := "code generated, do not edit"\n', False), ("a.ts", "/* @generated */", True), ("a.ts", "x@generated", False), ("a_pb2.py", "", True), ("a.min.js", "", True)]
    df = spark.createDataFrame([(p, t) for p, t, _ in cases], "p string, t string").select(P.generated(F.col("p"), F.col("t")).alias("g"))
    assert [r["g"] for r in df.collect()] == [g for _, _, g in cases]


def test_extraction(index):
    got = {(r["kind"], r["full_name"], r["file"], r["line"], r["end"]) for r in index["symbols"].where("kind <> 'heading'").collect()}
    assert {("struct", "Store", "store/store.go", 4, 7), ("method", "Store.Save", "store/store.go", 8, 12), ("func", "helper", "store/store.go", 14, 14), ("class", "Square", "py/shapes.py", 6, 9), ("method", "Square.area", "py/shapes.py", 7, 9), ("func", "load", "web/App.vue", 2, 4)} <= got
    assert not {n for _, n, *_ in got} & {"fake", "no"}
    calls = rows(index["calls"])
    assert {("Store.Save", "Store.check"), ("Store.Save", "fmt.Println"), ("Store.Save", "helper"), ("Handle", "Store.Save"), ("Handle", "store.helper"), ("Square.area", "side"), ("load", "fetchAll")} <= calls
    assert rows(index["inherits"]) == {("Square", "extends", "Shape"), ("Store", "embeds", "Base")}
    assert {("store/store.go", "fmt"), ("api/api.go", "store")} <= rows(index["imports"])
    callers = rows(index["callers"])
    assert ("Handle", "helper") in callers and ("total", "Square.area") in callers  # by folder, and by dispatch
    entry = index["symbols"].where("entry").select("full_name", "framework", "route")
    assert ("Handle", "net-http", "/a") in rows(entry)


def test_languages():
    java = '@RestController\n@RequestMapping("/api")\npublic class Ctl extends Base implements A, B {\n  @GetMapping("/users")\n  public List<User> list() {\n    return service.find(1);\n  }\n}\n'
    got = X.scan_file("Ctl.java", java, "java")
    assert ("method", "list", "Ctl", "/api/users") in {(r[3], r[4], r[5], r[10]) for r in got if r[0] == "symbol"}
    assert {(r[3], r[5]) for r in got if r[0] == "inherit"} == {("extends", "Base"), ("implements", "A"), ("implements", "B")}
    js = "// function no() {}\nclass A extends B {\n  go(x) {\n    return this.run(`${no()}`)\n  }\n}\nconst f = (x) => g(x)\nrouter.get('/u', list)\nfunction list() {}\n"
    got = X.scan_file("a.js", js, "javascript")
    assert {("class", "A", ""), ("method", "go", "A"), ("func", "f", ""), ("func", "list", "")} <= {(r[3], r[4], r[5]) for r in got if r[0] == "symbol"}
    assert ("A.go", "A.run") in {(r[4], r[5]) for r in got if r[0] == "call"} and ("list", "/u") in {(r[4], r[10]) for r in got if r[8]}
    rust = "pub struct P { x: i32 }\nimpl P {\n    pub fn new(x: i32) -> P {\n        check(x)\n    }\n}\n"
    assert ("method", "new", "P") in {(r[3], r[4], r[5]) for r in X.scan_file("a.rs", rust, "rust")}
    ruby = "module M\n  class C < D\n    def go!\n      helper(1)\n    end\n  end\nend\n"
    got = X.scan_file("a.rb", ruby, "ruby")
    assert ("method", "go!", "C") in {(r[3], r[4], r[5]) for r in got} and ("inherit", "extends", "C", "D") in {(r[0], r[3], r[4], r[5]) for r in got}
    c = "#include <x.h>\nstatic int add(int a, int b)\n{\n  return sum(a, b);\n}\nint Foo::bar(int x) {\n  return add(x, 1);\n}\n"
    got = X.scan_file("a.cpp", c, "cpp")
    assert {("func", "add", ""), ("method", "bar", "Foo")} <= {(r[3], r[4], r[5]) for r in got} and {("add", "sum"), ("Foo.bar", "add")} <= {(r[4], r[5]) for r in got if r[0] == "call"}
    php = "<?php\nRoute::get('/p', [Ctl::class, 'show']);\nfinal class Ctl extends Base {\n  public function show() {\n    return view('x');\n  }\n}\n"
    assert ("show", "Ctl") in {(r[4], r[5]) for r in X.scan_file("a.php", php, "php") if r[0] == "symbol"}
    assert X.scan_file("a.zz", "x", "zz") == [] and X.scan_file("a.py", "", "python") == []


def test_search(spark, index):
    s = index["symbols"]
    assert {r["full_name"] for r in S.pattern_search(s, "method *a*e*").collect()} == {"Store.Save", "Square.area", "Shape.area"} - {"Square.area", "Shape.area"} | {n for n in ("Square.area", "Shape.area") if "e" in n.split(".")[1]}
    assert {r["full_name"] for r in S.pattern_search(s, "type S*").collect()} == {"Store", "Shape", "Square"}
    assert {r["full_name"] for r in S.pattern_search(s, "entry *").collect()} >= {"Handle"}
    q = spark.createDataFrame([(1, "save stores"), (2, "Made")], "query long, text string")
    got = S.ranked_search(s, q, index["files"]).collect()
    best = {r["query"]: r["full_name"] for r in got if r["rank"] == 1}
    assert best[1] == "Store.Save" and next(r["score"] for r in got if r["full_name"] == "Made") == 100 + 150 - 60
    refs = spark.createDataFrame([("Store.Save",), ("store.helper",), ("x/side",), ("nothing",)], "ref string")
    assert {(r["ref"], r["full_name"], r["how"]) for r in S.find(s, refs).collect()} == {("Store.Save", "Store.Save", "exact"), ("store.helper", "helper", "folder"), ("x/side", "side", "tail")}
    assert {r["repo"] for r in S.search_repositories(s.withColumn("repo", F.lit("r1")).unionByName(s.withColumn("repo", F.lit("r2"))), q).collect()} == {"r1", "r2"}
    c = {r["name"]: r["full_name"] for r in S.canonical(s).collect()}
    assert c["Save"] == "Store.Save" and "area" not in c and c["Square.area"] == "Square.area"


def test_graph_questions(spark, index):
    s, e = index["symbols"], index["callers"]
    assert {tuple(r) for r in S.callers_of(s, index["calls"], names(spark, "helper", "Println", "fmt.Println")).collect()} == {("helper", "Store.Save"), ("helper", "Handle"), ("Println", "Store.Save"), ("fmt.Println", "Store.Save")}
    assert rows(S.dispatch_hints(s, index["inherits"], names(spark, "Shape.area"))) == {("Shape.area", "Square.area")}
    assert rows(S.subtypes(index["inherits"], names(spark, "Shape"))) == {("Shape", "Square")} and rows(S.supertypes(index["inherits"], names(spark, "Square"))) == {("Square", "extends", "Shape")}
    refs = spark.createDataFrame([("yes", "keep/x.py"), ("Handle", "api/api.go")], "name string, file string")
    dead = {r["full_name"] for r in S.dead_code(s, e, refs).collect()}
    assert dead == {"unused", "Made", "load", "total", "go"}
    check = {r["name"]: (r["safe"], r["reason"]) for r in S.delete_check(s, e, refs, names(spark, "unused", "helper", "main", "yes", "Serve", "gone", "Made")).collect()}
    assert check["unused"] == (True, "no callers") and check["helper"] == (False, "called: Handle, Store.Save") and check["main"] == (False, "entry point")
    assert check["yes"][1].startswith("referenced") and check["gone"] == (False, "not found") and check["Made"] == (False, "public")
    cov = {r["full_name"]: (r["covered"], r["callers"]) for r in S.coverage(s, e).collect()}
    assert cov["Handle"][0] and cov["helper"] == (True, 2) and cov["unused"] == (False, 0)
    hubs = S.hubs(s, e, 3).collect()
    assert hubs[0]["symbol"] == "helper" and hubs[0]["callers"] == 2 and "TestHandle" not in {r["symbol"] for r in hubs}
    assert {r["symbol"]: r["packages"] for r in S.bridges(s, e).collect()} == {"helper": ["api", "store"], "side": ["py"]} or {r["symbol"] for r in S.bridges(s, e).collect()} == {"helper"}
    around = {(r["id"], r["depth"], r["parent"]) for r in S.near(e, "helper", 1).collect()}
    assert around == {("helper", 0, ""), ("Store.Save", 1, "helper"), ("Handle", 1, "helper")}
    assert {("caller", "Handle"), ("definition", "store/store.go:14"), ("file", "api/api.go")} <= rows(S.explore(s, e, "helper", 1))
    assert ("Store.Save", "helper", "EXTRACTED") in rows(S.neighbourhood_graph(s, e, "helper"))
    assert {r["root"] for r in S.flows(s, e).collect()} >= {"main", "total"}
    assert S.longest_path(e, "main").first()["path"].startswith("main>Serve")
    lines = spark.createDataFrame([(1, "at Store.Save (x)"), (2, "helper: helper"), (3, "no")], "line_no int, text string")
    assert {(r["full_name"], r["hits"]) for r in S.trace(s, e, lines).collect()} == {("Store.Save", 1), ("helper", 1)}
    assert S.why(s, e, "Store").first()["doc"] == "Store keeps things." and S.why(s, e, "helper").first()["dependents"] == "Handle, Store.Save"
    assert {("helper", "caller", "Handle"), ("Handle", "test", "TestHandle")} <= rows(S.probe(s, e, "why does helper fail in Handle"))
    assert rows(S.affected_files(s, names(spark, "helper", "side").withColumnRenamed("name", "full_name"))) == {("store/store.go",), ("py/shapes.py",)}
    large = [r["full_name"] for r in S.large_functions(s, 3).collect()]
    assert large[0] in ("Store.Save", "Handle") and "TestHandle" not in large
    labels = G.label_propagation(e)
    report = S.communities_report(s, e, labels).collect()
    assert report and all(r["size"] >= 2 and r["hub"] in r["members"] for r in report)
    assert G.criticality(e, names(spark, "helper").withColumnRenamed("name", "id")).first()["dependents"] == 3


def test_knowledge(spark, index):
    s, e = index["symbols"], index["callers"]
    n, x = K.promote(s, index["calls"], index["inherits"], index["imports"])
    assert {("store.Store.Save", "symbol", "store.Store.Save"), ("file:store/store.go", "file", "store/store.go"), ("store", "module", "store")} <= rows(n)
    assert {("Square", "Shape", "extends"), ("file:py/shapes.py", "py.side", "contains"), ("api", "store", "imports")} <= rows(x)
    assert K.graph_hash(n, x).first() == K.graph_hash(n.repartition(3), x.orderBy(F.rand())).first() != K.graph_hash(n.limit(3), x).first()
    got = {r["ref"]: r["id"] for r in K.resolve(n, spark.createDataFrame([("store.Store.Save",), ("helper",), ("area",)], "ref string")).collect()}
    assert got == {"store.Store.Save": "store.Store.Save", "helper": "store.helper", "area": None}
    who = names(spark, "helper", "unused")
    assert rows(K.affected_apis(s, e, who)) == {("helper", "Handle", "api/api.go")} and rows(K.affected_services(s, e, who)) == {("helper", "api")}
    assert rows(K.affected_tests(s, e, who)) == {("helper", "TestHandle")}
    inc = spark.createDataFrame([("i1", "t", "error", "api"), ("i2", "t", "error", "x")], "id string, title string, severity string, service string")
    assert {r["id"] for r in K.affected_incidents(K.affected_services(s, e, who), inc).collect()} == {"i1"}
    nodes = spark.createDataFrame([("Handle", "Handle"), ("publishOrder", "publishOrder")], "id string, label string")
    edges = spark.createDataFrame([("Handle", "publishOrder")], "caller string, callee string")
    assert rows(K.affected_events(nodes, edges, names(spark, "Handle"))) == {("Handle", "publishOrder")}
    changes = spark.createDataFrame([(1, "remove_symbol", "helper", ""), (2, "add_symbol", "unused", ""), (3, "add_dependency", "helper", "Handle"), (4, "rename_symbol", "side", ""), (5, "add_dependency", "main", "helper")], "id int, kind string, target string, new_target string")
    sim = {r["id"]: r.asDict() for r in K.simulate(s, e, changes).collect()}
    assert sim[1]["risk"] == "high" and sim[1]["services"] == 1 and sim[1]["tests"] == 1 and sim[3]["cycle"] and sim[3]["risk"] == "high" and not sim[5]["cycle"]
    assert sim[2]["affected"] == 1 and sim[2]["risk"] == "medium" and sim[2]["confidence"] == 0.8 and sim[4]["affected"] >= 2
    plan = K.contexts(G.label_propagation(e), e).collect()
    assert [r["phase"] for r in plan] == list(range(1, len(plan) + 1)) and all(0 <= r["cohesion"] <= 1 for r in plan)
    assert K.mermaid(K.typed_edges(spark.createDataFrame([("a", "b")], "src string, dst string"), "owns")) == 'graph LR\n  n0["a"]\n  n1["b"]\n  n0 --> n1'
    assert K.graphml(n, x).count() == n.count() + x.count() + 2
    commits = spark.createDataFrame([("c" * 40, "a.go")], "sha string, file string")
    assert rows(K.changed_by(commits)) == {("file:a.go", "commit:" + "c" * 40, "changed_by")}
    assert rows(K.fixed_by(spark.createDataFrame([("i", "7")], "incident string, fix string"))) == {("incident:i", "pr:7", "fixed_by")}
    assert K.related(spark.createDataFrame([("a", "b")], "a string, b string")).count() == 2
    both_n, both_e = K.merged((n, x), (n.limit(1).withColumn("label", F.lit("other")), x))
    assert both_n.count() == n.count() and both_e.count() == x.count() and both_n.where("label = 'other'").count() == 0


def test_twin(spark):
    files = [
        ("a/app.py", '@app.route("/x")\ndef x(): pass\nKafkaConsumer("orders")\n'), ("b.go", 'nats.Publish("n.x", d)\nr.GET("/y", h)\nTopics: []string{"t1", "t2"}\n'), ("s.sql", "create table if not exists Users (id int);"),
        ("m.py", "__tablename__ = 'items'"), ("docker-compose.yml", "version: '3'\nservices:\n  web:\n    image: x\n  db:\n    image: y\nvolumes:\n  data:\n"), ("k.yaml", "kind: Deployment\nmetadata:\n  name: api\nspec:\n  template:\n    name: inner\n"),
        ("main.tf", 'resource "aws_s3_bucket" "logs" {\n'), ("chart/Chart.yaml", 'name: "shop"\n'),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    assert {(r["id"], r["label"]) for r in K.api_graph(df)[0].collect()} == {("api:/x", "flask /x"), ("api:/y", "go /y")}
    assert {r["id"] for r in K.data_graph(df)[0].collect()} == {"table:users", "table:items"}
    n, e = K.topic_graph(df)
    assert {(r["id"], r["label"]) for r in n.collect()} == {("topic:orders", "kafka orders"), ("topic:n.x", "nats n.x"), ("topic:t1", "kafka t1"), ("topic:t2", "kafka t2")}
    assert ("file:b.go", "topic:n.x", "publishes_to") in rows(e) and e.count() == 4
    n, e = K.infra_graph(df)
    assert {r["label"] for r in n.collect()} == {"container web", "container db", "k8s-deployment api", "aws logs", "helm shop"} and e.count() == 5
    catalog = spark.createDataFrame([("flask", "code", "@app.route", "python"), ("compose", "path", "docker-compose", "")], "framework string, how string, mark string, lang string")
    assert {(r["framework"], r["files"]) for r in P.frameworks(df, catalog).collect()} == {("flask", 1), ("compose", 1)}
    findings = spark.createDataFrame([("a.go", 3, "r", "info", "m", "s")], "file string, line int, rule string, severity string, message string, snippet string")
    import json

    doc = json.loads(K.sarif(findings).first()["doc"])
    assert doc["runs"][0]["results"][0]["level"] == "note" and doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3


def test_saved_index(spark, index, tree, tmp_path):
    P.save_index(index, str(tmp_path / "ix"))
    back = P.load_index(spark, str(tmp_path / "ix"))
    assert rows(back["callers"]) == rows(index["callers"]) and P.load_index(spark, str(tmp_path / "ix"), 2) is None and P.load_index(spark, str(tmp_path / "none")) is None
    files = index["files"].select("path", "hash", F.col("modified").alias("mtime"))
    assert not G.stale(files, files) and G.stale(files, files.limit(3))
    docs = P.read_documents(tree).collect()
    assert [(d["file"], d["start"]) for d in docs] == [("docs/guide.md", 1)]
    assert P.project_map(index["symbols"]).where("file = 'py/shapes.py'").first()["n"] == 6


def test_asked(spark, index):
    from talus import api

    ranges = spark.createDataFrame([("store/store.go", 14, 14), ("py/shapes.py", None, None)], "file string, lo int, hi int")
    some = {
        "search": ("save",), "pattern": ("func *",), "find": ("Save",), "who_calls": ("helper",), "depends_on": ("helper",), "depends_of": ("main",), "supertypes": ("Square",), "subtypes": ("Shape",),
        "implementations": ("Shape.area",), "near": ("helper",), "explore": ("helper",), "path": ("main", "Serve"), "longest_path": ("main",), "why": ("helper",), "probe": ("helper",), "probe_report": ("helper",), "delete": ("helper",),
        "criticality": ("helper",), "apis": ("helper",), "services": ("helper",), "tests": ("helper",), "files": ("helper",), "graph": ("helper",), "changes": (ranges,), "large": (2,),
    }
    changes = spark.createDataFrame([(1, "remove_symbol", "helper", "")], "id int, kind string, target string, new_target string")
    for question in api.QUESTIONS:
        assert api.ask(index, question, *some.get(question, (changes,) if question == "what_if" else ())).count() > 0, question
    risk = {r["file"]: r.asDict() for r in api.ask(index, "changes", ranges).collect()}
    one = risk["store/store.go"]
    assert (one["symbols"], one["callers"], one["blast"], one["gaps"], one["packages"]) == (1, 2, 3, 0, 2) and one["risk"] == round(1 + 1.584962500721156 + 1 + 1 + 1.5, 1)
    assert api.sql(spark, index, "select count(*) from symbols s join files f on s.file = f.path").first()[0] == index["symbols"].count()
