"""The knowledge graph: nodes (id, kind, label) and edges (src, dst, kind) from symbols, from what
describes services, data and topics, and from operations; what changes to it would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators.symbols import folder

NODE, EDGE = ["id", "kind", "label"], ["src", "dst", "kind"]
# Words that mark a node as an event or topic.
EVENT_WORDS = "event|topic|queue|publish|subscribe"
# Routes by framework, tables, topics: (name, pattern with the groups used).
ROUTES = (
    ("go", r'\.(?:HandleFunc|Handle|GET|POST|PUT|DELETE|PATCH)\(\s*"([^"]+)"'), ("flask", r"""@\w+\.(?:route|get|post|put|delete|patch)\(\s*["']([^"']+)["']"""),
    ("express", r"""\b(?:app|router)\.(?:get|post|put|delete|patch|use)\(\s*["'`]([^"'`]+)["'`]"""), ("spring", r'@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?"([^"]+)"'),
    ("django", r"""\b(?:path|re_path)\(\s*r?["']([^"']+)["']"""), ("rails", r"""^\s*(?:get|post|put|patch|delete)\s+["']([^"']+)["']"""), ("laravel", r"""Route::(?:get|post|put|patch|delete)\(\s*["']([^"']+)["']"""),
)
TABLES = ((r'(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?["`\[]?([A-Za-z_][\w.]*)'), r"""__tablename__\s*=\s*["']([^"']+)["']""", r"""@Table\(\s*name\s*=\s*"([^"]+)\"""", r"""TableName\(\)\s+string\s*\{\s*return\s+"([^"]+)\"""")
TOPICS = (
    ("nats", "publishes_to", r'nats\.Publish\(\s*"([^"]+)"'), ("nats", "subscribes_to", r'nats\.Subscribe\(\s*"([^"]+)"'), ("kafka", "publishes_to", r'Topic:\s*"([^"]+)"'),
    ("kafka", "publishes_to", r"""KafkaProducer\(.*?topic\s*=\s*['"]([^'"]+)['"]"""), ("kafka", "subscribes_to", r"""KafkaConsumer\(\s*['"]([^'"]+)['"]"""),
    ("rabbitmq", "publishes_to", r'\.Publish\([^,]+,\s*"([^"]+)"'), ("rabbitmq", "subscribes_to", r'\.Consume\(\s*"([^"]+)"'), ("rabbitmq", "publishes_to", r"""queue_declare\(queue\s*=\s*['"]([^'"]+)['"]"""),
    ("redis", "publishes_to", r'\.Publish\(\s*"([^"]+)"'), ("redis", "subscribes_to", r'\.Subscribe\(\s*"([^"]+)"'),
)
TOPIC_LISTS = r"Topics:\s*\[\]string\{(.*?)\}"
RESOURCE = r'resource\s+"(\w+)"\s+"(\w+)"'
CLOUDS = (("aws_", "aws"), ("google_", "gcp"), ("azurerm_", "azure"))
# Kinds of change that take the dependents of the target, and those that name the target itself.
DEPENDENTS = ("remove_symbol", "change_dependency", "change_signature", "rename_symbol", "split_service", "move_module", "change_infra")
SELF = ("add_symbol", "change_signature", "remove_dependency", "rename_symbol", "split_service", "move_module", "change_infra")


def nodes(df: DataFrame, node: Column, kind: str, label: Column) -> DataFrame:
    return df.select(node.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))


def edges(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    """Edges of one fixed kind: changed_by, affects, caused, fixed_by, violates, documented_by, owns, related_to and others."""
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))


def changed_by(commits: DataFrame) -> DataFrame:
    """Files of commits (sha, file)."""
    return edges(commits, F.concat(F.lit("file:"), "file"), F.concat(F.lit("commit:"), "sha"), "changed_by")


def fixed_by(fixes: DataFrame) -> DataFrame:
    """Incidents and their fixes (incident, fix): a commit by its 40 digits, else a pull request."""
    to = F.when(F.length("fix") == 40, F.concat(F.lit("commit:"), "fix")).otherwise(F.concat(F.lit("pr:"), "fix"))
    return edges(fixes, F.concat(F.lit("incident:"), "incident"), to, "fixed_by")


def related(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) in both directions."""
    return edges(pairs, F.col("a"), F.col("b"), "related_to").unionByName(edges(pairs, F.col("b"), F.col("a"), "related_to"))


def typed_edges(rows: DataFrame, kind: str, src_prefix: str = "", dst_prefix: str = "") -> DataFrame:
    """Rows (src, dst) as edges of a kind, with the prefixes of the nodes' kinds."""
    return edges(rows, F.concat(F.lit(src_prefix), "src"), F.concat(F.lit(dst_prefix), "dst"), kind)


def symbol_id(file: Column, full_name: Column) -> Column:
    home = folder(file)
    return F.when(home == "", full_name).otherwise(F.concat_ws(".", home, full_name))


def promote(symbols: DataFrame, calls: DataFrame, inherits: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): symbols, files and modules; calls, inheritance, imports, contains and defines."""
    sid, file, module = symbol_id(F.col("file"), F.col("full_name")), F.concat(F.lit("file:"), "file"), folder(F.col("file"))
    n = nodes(symbols, sid, "symbol", sid).unionByName(nodes(symbols, file, "file", F.col("file"))).unionByName(nodes(symbols, module, "module", module))
    e = edges(calls, F.col("caller"), F.col("callee"), "calls").unionByName(inherits.select(F.col("subtype").alias("src"), F.col("base").alias("dst"), F.col("edge_kind").alias("kind")))
    e = e.unionByName(edges(imports, folder(F.col("file")), F.col("target"), "imports")).unionByName(edges(symbols, file, sid, "contains")).unionByName(edges(symbols, sid, file, "defines"))
    return first_nodes(n), e.distinct()


def first_nodes(rows: DataFrame) -> DataFrame:
    """One row a node id: the least by kind and label."""
    best = rows.groupBy("id").agg(F.min(F.struct("kind", "label")).alias("b"))
    return best.select("id", "b.kind", "b.label")


def merged(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of graphs; of nodes that several name the first graph's stands."""
    n, e = None, None
    for k, (nodes_, edges_) in enumerate(graphs):
        numbered = nodes_.select(*NODE).withColumn("ord", F.lit(k))
        n, e = (numbered, edges_.select(*EDGE)) if n is None else (n.unionByName(numbered), e.unionByName(edges_.select(*EDGE)))
    best = n.groupBy("id").agg(F.min(F.struct("ord", "kind", "label")).alias("b"))
    return best.select("id", "b.kind", "b.label"), e.distinct()


def graph_hash(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(hash): of sorted node ids and edges, whatever the order of rows; sums of hashes first, so rows are not collected."""
    mix = lambda df, *c: df.select(F.conv(F.left(F.sha2(F.concat_ws("\x00", *c), 256), F.lit(14)), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n"))
    both = mix(nodes_.distinct(), "id").crossJoin(mix(edges_.distinct(), *EDGE).select(F.col("s").alias("t"), F.col("n").alias("m")))  # one row each
    return both.select(F.sha2(F.concat_ws(":", "n", F.coalesce("s", F.lit(0)), "m", F.coalesce("t", F.lit(0))), 256).alias("hash"))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of files (path, content)."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def matches(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows with every match of a pattern's first group in their line as ``found``."""
    return rows.where(F.col("line").rlike(pattern)).withColumn("found", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))).where("found <> ''")


def api_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes as api nodes, defined in their files; the first framework whose pattern meets a line names it."""
    rows = lines_of(files)
    hits = None
    for k, (framework, p) in enumerate(ROUTES):
        one = matches(rows, p).select("path", "line_no", "found", F.lit(k).alias("ord"), F.lit(framework).alias("framework"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy("path", "line_no", "found").agg(F.min(F.struct("ord", "framework"))["framework"].alias("framework"))
    node = F.concat(F.lit("api:"), "found")
    return first_nodes(nodes(best, node, "api", F.concat_ws(" ", "framework", "found"))), edges(best, node, F.concat(F.lit("file:"), "path"), "defined_in").distinct()


def data_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of CREATE TABLE and of mapped classes, defined in their files."""
    hits = None
    for p in TABLES:
        one = files.where(F.col("content").rlike(p)).select("path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("found"))
        hits = one if hits is None else hits.unionByName(one)
    node = F.concat(F.lit("table:"), F.lower("found"))
    return first_nodes(nodes(hits, node, "table", F.col("found"))), edges(hits, node, F.concat(F.lit("file:"), "path"), "defined_in").distinct()


def topic_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics with the files that publish or subscribe to them; a line's topic goes to its most specific broker."""
    rows = lines_of(files)
    lists = rows.where(F.col("line").rlike(TOPIC_LISTS)).withColumn("found", F.explode(F.regexp_extract_all(F.regexp_extract("line", TOPIC_LISTS, 1), F.lit('"([^"]+)"'), F.lit(1))))
    hits = lists.select("path", "line_no", "found", F.lit(0).alias("ord"), F.lit("kafka").alias("broker"), F.lit("subscribes_to").alias("kind"))
    for k, (broker, kind, p) in enumerate(TOPICS, 1):
        hits = hits.unionByName(matches(rows, p).select("path", "line_no", "found", F.lit(k).alias("ord"), F.lit(broker).alias("broker"), F.lit(kind).alias("kind")))
    best = hits.groupBy("path", "line_no", "found").agg(F.min(F.struct("ord", "broker", "kind")).alias("b")).select("path", "found", "b.broker", "b.kind")
    node = F.concat(F.lit("topic:"), "found")
    return first_nodes(nodes(best, node, "topic", F.concat_ws(" ", "broker", "found"))), best.select(F.concat(F.lit("file:"), "path").alias("src"), node.alias("dst"), "kind").distinct()


def infra_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services of compose files, cluster manifests, cloud resources and charts, defined in their files.
    The state of a line (its section or the last kind) comes from a window over its file's lines."""
    base = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    rows = lines_of(files.where(base.rlike(r"\.(ya?ml|tf)$"))).withColumn("base", base)
    line, by = F.col("line"), Window.partitionBy("path").orderBy("line_no")
    compose = rows.where(F.col("base").rlike("^(docker-)?compose.*ya?ml$")).withColumn("top", F.when(line.rlike(r"^[^\s#]"), F.trim("line")))
    compose = compose.withColumn("section", F.last("top", ignorenulls=True).over(by)).where((F.col("section") == "services:") & line.rlike(r"^  [^\s#][^:]*:\s*$"))
    one = compose.select("path", F.regexp_extract("line", r"^\s+(.+?):\s*$", 1).alias("name"), F.lit("container").alias("type"))
    chart = rows.where((F.col("base") == "chart.yaml") & line.rlike("^name:")).select("path", F.regexp_replace(F.trim(F.regexp_extract("line", "^name:(.*)$", 1)), "[\"']", "").alias("name"), F.lit("helm").alias("type"))
    kube = rows.where(F.col("base").rlike(r"\.ya?ml$") & ~F.col("base").rlike("^(docker-)?compose|^chart.yaml$")).withColumn("named", F.regexp_extract("line", r"^\s+name:\s*(\S+)", 1)).withColumn("kind_", F.nullif(F.regexp_extract("line", r"^kind:\s*(\w+)", 1), F.lit("")))
    kube = kube.withColumn("section", F.sum(F.col("kind_").isNotNull().cast("int")).over(by)).withColumn("of", F.last("kind_", ignorenulls=True).over(by)).where("section > 0 and named <> ''")
    kube = kube.groupBy("path", "section", "of").agg(F.min(F.struct("line_no", "named"))["named"].alias("name")).select("path", F.regexp_replace("name", "[\"']", "").alias("name"), F.concat(F.lit("k8s-"), F.lower("of")).alias("type"))
    kind = F.lit("terraform")
    for prefix, cloud in CLOUDS:
        kind = F.when(F.regexp_extract("line", RESOURCE, 1).startswith(prefix), cloud).otherwise(kind)
    cloud = rows.where(F.col("base").endswith(".tf") & line.rlike(RESOURCE)).select("path", F.regexp_extract("line", RESOURCE, 2).alias("name"), kind.alias("type"))
    every = one.unionByName(chart).unionByName(kube).unionByName(cloud)
    node = F.concat(F.lit("service:"), "name")
    return first_nodes(nodes(every, node, "service", F.concat_ws(" ", "type", "name"))), edges(every, node, F.concat(F.lit("file:"), "path"), "defined_in").distinct()


def runtime_graph(events: DataFrame, deployments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deployments, services, errors and health of events (service, type, ts, attributes) and deployments (service, version)."""
    service = F.concat(F.lit("service:"), "service")
    dep = F.concat(F.lit("deployment:"), "service", F.lit(":"), F.coalesce("version", F.lit("")))
    names = events.select("service").unionByName(deployments.select("service")).where("service is not null").distinct()
    bad = events.where("type = 'error'")
    err = F.concat(F.lit("error:"), "service", F.lit(":"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    n = names.join(bad.groupBy("service").agg(F.count("*").alias("errors")), "service", "left")
    state = F.when(F.col("errors") > 10, "unhealthy").when(F.col("errors") > 0, "degraded").otherwise("healthy")
    health = F.concat(F.lit("health:"), "service")
    all_nodes = nodes(deployments, dep, "deployment", F.concat_ws(" ", "service", "version")).unionByName(nodes(names, service, "service", F.col("service"))).unionByName(nodes(bad, err, "error", F.concat_ws(" ", F.lit("error at"), F.col("ts").cast("string"))))
    all_nodes = all_nodes.unionByName(nodes(n, health, "service-health", F.concat("service", F.lit(" ("), state, F.lit(")"))))
    caused = bad.where("attributes['file'] <> ''")
    all_edges = edges(deployments, dep, service, "deploys").unionByName(edges(bad, err, service, "occurred_in")).unionByName(edges(caused, err, F.concat(F.lit("file:"), F.col("attributes")["file"]), "caused_by")).unionByName(edges(n, health, service, "monitors"))
    return first_nodes(all_nodes), all_edges.distinct()


def resolve(nodes_: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (ref) -> (ref, id): the id itself, else the one node whose last part it is, else none."""
    exact = refs.join(nodes_.select("id").distinct(), F.col("ref") == F.col("id"), "left")
    tails = nodes_.select("id", F.element_at(F.split("id", r"[./:]"), -1).alias("tail")).distinct().groupBy("tail").agg(F.min("id").alias("only"), F.count("*").alias("n")).where("n = 1")
    return exact.join(tails, F.col("ref") == F.col("tail"), "left").select("ref", F.coalesce("id", "only").alias("id"))


def affected_apis(symbols: DataFrame, edges_: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) -> (name, full_name, file): entry points among what depends on each, itself included."""
    got = G.reach(edges_, names.select(F.col("name").alias("root"), F.col("name").alias("id")), reverse=True)
    entry = symbols.where("entry or route <> '' or framework <> ''").select(F.col("full_name").alias("id"), "file").distinct()
    return got.join(entry, "id").select(F.col("root").alias("name"), F.col("id").alias("full_name"), "file")


def affected_services(symbols: DataFrame, edges_: DataFrame, names: DataFrame) -> DataFrame:
    """(name, service): folders of the affected entry points."""
    return affected_apis(symbols, edges_, names).select("name", folder(F.col("file")).alias("service")).distinct()


def affected_tests(symbols: DataFrame, edges_: DataFrame, names: DataFrame) -> DataFrame:
    """(name, full_name): tests among what depends on each."""
    got = G.reach(edges_, names.select(F.col("name").alias("root"), F.col("name").alias("id")), reverse=True).where("dist > 0")
    tests = symbols.where(F.col("name").startswith("Test") | F.contains(F.col("file"), F.lit("_test.go"))).select(F.col("full_name").alias("id")).distinct()
    return got.join(tests, "id", "left_semi").select(F.col("root").alias("name"), F.col("id").alias("full_name"))


def affected_events(nodes_: DataFrame, edges_: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): event-like nodes (id, label) among each one's direct neighbours and itself."""
    up = edges_.join(names, edges_.callee == names.name).select("name", F.col("caller").alias("id"))
    down = edges_.join(names, edges_.caller == names.name).select("name", F.col("callee").alias("id"))
    near = up.unionByName(down).unionByName(names.select("name", F.col("name").alias("id"))).distinct()
    return near.join(nodes_.where(F.lower("label").rlike(EVENT_WORDS)).select("id").distinct(), "id", "left_semi").select("name", "id")


def affected_incidents(services: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incidents (id, title, severity, service) of affected services (service)."""
    return incidents.join(services.select("service").distinct(), "service", "left_semi").select("id", "title", "severity", "service")


def simulate(symbols: DataFrame, edges_: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, kind, target, new_target) -> (id, affected, files, services, tests, cycle, risk,
    confidence): what a change of the graph would touch. The edges (caller, callee) are not changed."""
    ask = changes.where(F.col("kind").isin(*DEPENDENTS)).select(F.col("id").alias("root"), F.col("target").alias("id"))
    far = G.reach(edges_, ask, reverse=True).where("dist > 0").select(F.col("root").alias("id"), F.col("id").alias("symbol"))
    known = symbols.select(F.col("full_name").alias("symbol"), "file")
    own = changes.where(F.col("kind").isin(*SELF)).select("id", F.col("target").alias("symbol")).join(known.select("symbol").distinct(), "symbol", "left_semi").select("id", "symbol")
    touched = G.cut(far.unionByName(own).distinct())
    names = changes.select(F.col("target").alias("name")).distinct()
    per = lambda df, name: changes.select("id", "target").join(df, F.col("target") == F.col("name")).groupBy("id").agg(F.count("*").alias(name))
    services = per(affected_services(symbols, edges_, names), "services")
    tests = per(affected_tests(symbols, edges_, names), "tests")
    added = changes.where("kind = 'add_dependency' and new_target <> ''").select(F.col("id").alias("root"), F.col("new_target").alias("id"))
    back = G.reach(edges_, added).select(F.col("root").alias("id"), F.col("id").alias("target")).join(changes.select("id", "target"), ["id", "target"], "left_semi").select("id", F.lit(True).alias("cycle")).distinct()
    n = touched.groupBy("id").agg(F.count("*").alias("affected"))
    files = touched.join(known, "symbol").select("id", "file").distinct().groupBy("id").agg(F.count("*").alias("files"))
    out = changes.select("id").join(n, "id", "left").join(files, "id", "left").join(services, "id", "left").join(tests, "id", "left").join(back, "id", "left")
    out = out.fillna(0, ["affected", "files", "services", "tests"]).fillna(False, ["cycle"])
    a = F.col("affected")
    risk = F.when(F.col("cycle") | (F.col("services") > 0) | (a > 10), "high").when(a > 0, "medium").otherwise("low")
    confidence = F.when(a == 0, 0.95).when(a < 5, 0.8).when(a < 20, 0.6).otherwise(0.4)
    return out.select("id", "affected", "files", "services", "tests", "cycle", risk.alias("risk"), confidence.alias("confidence"))


def contexts(labels: DataFrame, edges_: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """(label, size, cohesion, outgoing, incoming, safety, phase) of communities (id, label): the share of
    inner edges among those that touch it, distinct symbols it depends on and that depend on it,
    and 2 * outgoing + incoming + churn, by which contexts are extracted, the safest first."""
    a, b = labels.select(F.col("id").alias("caller"), F.col("label").alias("la")), labels.select(F.col("id").alias("callee"), F.col("label").alias("lb"))
    e = G.cut(edges_.join(a, "caller", "left").join(b, "callee", "left"))
    inner = e.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("inner"))
    out = e.where("la is not null and not (la <=> lb)").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("out_edges"), F.countDistinct("callee").alias("outgoing"))
    into = e.where("lb is not null and not (la <=> lb)").groupBy(F.col("lb").alias("label")).agg(F.count("*").alias("in_edges"), F.countDistinct("caller").alias("incoming"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    rows = size.join(inner, "label", "left").join(out, "label", "left").join(into, "label", "left").fillna(0)
    rows = (rows.join(churn, "label", "left") if churn is not None else rows.withColumn("churn", F.lit(0.0))).fillna(0.0, ["churn"])
    touch = F.col("inner") + F.col("out_edges") + F.col("in_edges")
    rows = rows.withColumn("cohesion", F.round(F.when(touch > 0, F.col("inner") / touch).otherwise(0.0), 6)).withColumn("safety", 2 * F.col("outgoing") + F.col("incoming") + F.col("churn"))
    phase = F.row_number().over(Window.orderBy("safety", "label"))  # one row a context
    return rows.where("size >= 2").withColumn("phase", phase).select("label", "size", "cohesion", "outgoing", "incoming", "safety", "phase")


def mermaid(edges_: DataFrame, most: int = 200) -> str:
    """A flow chart's text of at most ``most`` edges, by name."""
    rows = edges_.select("src", "dst").orderBy("src", "dst").limit(most).collect()
    names = {n: f"n{k}" for k, n in enumerate(sorted({x for r in rows for x in r}))}
    return "\n".join(["graph LR", *(f'  {i}["{n}"]' for n, i in names.items()), *(f"  {names[r['src']]} --> {names[r['dst']]}" for r in rows)])


def graphml(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(ord, line): a GraphML document line by line, in order."""
    x = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes_.sparkSession
    frame = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, line string")
    n = nodes_.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), x("id"), F.lit('"><data key="kind">'), x("kind"), F.lit("</data></node>")).alias("line"))
    e = edges_.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), x("src"), F.lit('" target="'), x("dst"), F.lit('"/>')).alias("line"))
    return frame.unionByName(n).unionByName(e).orderBy("ord", "line")


def sarif(findings: DataFrame, tool: str = "talus") -> DataFrame:
    """(doc): one SARIF document of findings (file, line, rule, severity, message), which a report bounds."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    rows = findings.agg(F.sort_array(F.collect_list(F.struct("file", "line", "rule", result.alias("r")))).alias("all"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.transform("all", lambda x: x["r"]).alias("results"))
    return rows.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("doc"))
