"""Graph operators bound to the depends-on graph of the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import reachability as R
from talus.operators.paths import paths_between
from talus.tables import table

#: Node ids are numbers: the kind times STEP, plus the key. Names are made for results only.
KINDS = ("region", "nation", "customer", "supplier", "part", "order")
STEP = 10**15
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = (k * STEP for k in range(1, 7))


def depends_on(spark: SparkSession, sf: str) -> DataFrame:
    return G.cut(edges_of(spark, sf))


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    """order>customer, order>part, order>supplier, customer>nation, supplier>nation, nation>region."""
    edge = lambda t, a, x, b, y: table(spark, sf, t).select((F.col(x) + F.lit(a)).alias("caller"), (F.col(y) + F.lit(b)).alias("callee")).where("caller is not null and callee is not null")
    return G.union_edges(
        edge("orders", ORDER, "o_orderkey", CUSTOMER, "o_custkey"),
        edge("lineitem", ORDER, "l_orderkey", PART, "l_partkey"),
        edge("lineitem", ORDER, "l_orderkey", SUPPLIER, "l_suppkey"),
        edge("customer", CUSTOMER, "c_custkey", NATION, "c_nationkey"),
        edge("supplier", SUPPLIER, "s_suppkey", NATION, "s_nationkey"),
        edge("nation", NATION, "n_nationkey", REGION, "n_regionkey"),
    )


def kind(node: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), F.floor(node / F.lit(STEP)).cast("int"))


def name(node: Column) -> Column:
    return F.concat(kind(node), F.lit(":"), (node % F.lit(STEP)).cast("string"))


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Node numbers as 'kind:key'."""
    return df.withColumns({c: name(F.col(c)) for c in columns})


def ranked(node: Column, kinds: tuple[str, ...] = tuple(sorted(KINDS))) -> Column:
    """A number for a node number, in the order of names: by kind, then by the key's digits as text. Digits are filled
    up on the right, and their number comes last, so that 1 is before 10 and 10 before 2."""
    key = node % F.lit(STEP)
    size = F.length(key.cast("string"))
    place = F.array_position(F.array(*map(F.lit, kinds)), kind(node))
    fill = F.element_at(F.array(*(F.lit(10**k) for k in range(14, -1, -1))), size)
    return (place * F.lit(STEP) + key * fill) * F.lit(16) + size


def unranked(code: Column, kinds: tuple[str, ...] = tuple(sorted(KINDS))) -> Column:
    """The node number for that number."""
    size, rest = (code % F.lit(16)).cast("int"), F.shiftright(code, 4)
    fill = F.element_at(F.array(*(F.lit(10**k) for k in range(14, -1, -1))), size)
    place = F.call_function("div", rest, F.lit(STEP)).cast("int")
    base = F.element_at(F.array(*(F.lit((KINDS.index(k) + 1) * STEP) for k in kinds)), place)
    return base + F.call_function("div", rest % F.lit(STEP), fill)


EDGES = """
    edges AS (
        SELECT DISTINCT 'order:' || o_orderkey AS caller, 'customer:' || o_custkey AS callee FROM orders
        UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
        UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem
        UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
        UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
        UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
    nodes AS (SELECT id, split_part(id, ':', 1) AS dir FROM (SELECT caller AS id FROM edges UNION SELECT callee FROM edges))"""


def nodes_of(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.col("caller").alias("id")).union(edges.select("callee")).distinct()
    return ids.withColumn("dir", kind(F.col("id")))


def test_nodes(edges: DataFrame) -> DataFrame:
    """Orders whose key ends in 7 stand for test files; orders are callers only."""
    return edges.where((F.col("caller") > ORDER) & (F.col("caller") % 10 == 7)).select(F.col("caller").alias("id")).distinct()


def of_kind(edges: DataFrame, *bases: int) -> DataFrame:
    """(id) of the nodes of some kinds."""
    return nodes_of(edges).where(F.col("dir").isin(*(KINDS[b // STEP - 1] for b in bases))).select("id")


def hubs(spark, sf):
    """The top tenth of all symbols outside tests."""
    e = depends_on(spark, sf)
    return G.hubs(G.cut(named(G.hub_rows(e, test_nodes(e)), "id").withColumnRenamed("id", "symbol")))


def bridges(spark, sf):
    e = depends_on(spark, sf)
    return G.bridges(named(G.bridge_rows(e, nodes_of(e), test_nodes(e)), "id").withColumnRenamed("id", "symbol"))


def callers_prod(spark, sf):
    e = depends_on(spark, sf)
    return named(G.count_of(G.outside(e, test_nodes(e)), "callee", "callers"), "id").withColumnRenamed("id", "symbol")


def dead_nodes(spark, sf):
    e = depends_on(spark, sf)
    return named(G.dead(nodes_of(e), e, test_nodes(e)), "id")


def coverage_gaps(spark, sf):
    e = depends_on(spark, sf)
    return G.coverage(nodes_of(e), e, test_nodes(e))


def blast_radius(spark, sf):
    e = depends_on(spark, sf)
    return named(G.closure(e, of_kind(e, REGION).where(f"id = {REGION}"), reverse=True), "id")


def transitive_callees(spark, sf):
    """Within 50 hops, as that question is defined."""
    e = depends_on(spark, sf)
    return named(G.closure(e, of_kind(e, ORDER), depth=50).where("dist > 0"), "id")


def criticality(spark, sf):
    """Of regions, nations and suppliers, by all that depends on them."""
    e = depends_on(spark, sf)
    return named(G.criticality(e, of_kind(e, REGION, NATION, SUPPLIER)), "id").withColumnRenamed("id", "symbol")


def who_depends(spark, sf):
    """Direct callers, all dependents and all dependencies of nations."""
    e = depends_on(spark, sf)
    roots = G.cut(of_kind(e, NATION))
    n = lambda d, name: d.where("dist > 0").groupBy("root").agg(F.count("*").alias(name))
    direct = G.count_of(e, "callee", "direct").withColumnRenamed("id", "root").join(roots.withColumnRenamed("id", "root"), "root", "left_semi")
    out = direct.join(n(G.reach(e, roots, reverse=True), "dependents"), "root", "left").join(n(G.reach(e, roots), "dependencies"), "root", "left")
    return named(out.fillna(0), "root").withColumnRenamed("root", "symbol")


def arch_coupling(spark, sf):
    e = depends_on(spark, sf)
    return G.coupling(named(e, "caller", "callee"), named(nodes_of(e), "id").select("id", F.col("dir").alias("grp")))


def near_nation(spark, sf):
    """The undirected surroundings of a nation to two hops, regions, customers, suppliers and their orders: how many."""
    e = depends_on(spark, sf)
    both = e.unionByName(e.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
    hop = G.closure(both, e.select(F.lit(NATION).alias("id")).limit(1), depth=2)
    return hop.groupBy(kind(F.col("id")).alias("dir"), "dist").agg(F.count("*").alias("n"))


def whole_graph(spark, sf):
    from talus.operators.symbols import whole_graph as top

    return top(named(depends_on(spark, sf), "caller", "callee"), 400)


def flow_roots(spark, sf):
    """Nodes that nothing depends on, by kind, and how many nodes each of the first ten reaches."""
    e = depends_on(spark, sf)
    roots = e.select(F.col("caller").alias("id")).distinct().join(e.select(F.col("callee").alias("id")), "id", "left_anti")
    ten = named(roots, "id").orderBy("id").limit(10).select("id")
    return G.reach(named(e, "caller", "callee"), ten).where("dist > 0").groupBy("root").agg(F.count("*").alias("reached"))


def flows(spark, sf):
    """Every node that nothing depends on: how many nodes it reaches, and its longest path."""
    e = G.cut(edges_of(spark, sf).select(ranked(F.col("caller")).alias("caller"), ranked(F.col("callee")).alias("callee")))
    roots = e.select(F.col("caller").alias("id")).distinct().join(e.select(F.col("callee").alias("id")), "id", "left_anti")
    said = lambda c: name(unranked(c))
    return R.flows(e, roots).withColumns({"root": said(F.col("root")), "path": R.as_text(F.transform("path", said))})


def criticality_levels(spark, sf):
    """Of every node of the graph, counted up to 256."""
    return named(R.criticality_of_all(depends_on(spark, sf)), "id").withColumnRenamed("id", "symbol")


def layer_check(spark, sf):
    """Edges between layers of which no pair allows them."""
    e = depends_on(spark, sf)
    layers = spark.createDataFrame([(1, "sales", "order"), (2, "party", "customer"), (2, "party", "supplier"), (3, "place", "nation"), (3, "place", "region")], "ord int, layer string, pattern string")
    allowed = spark.createDataFrame([("sales", "party")], "src_layer string, dst_layer string")
    return G.layer_violations(named(e, "caller", "callee"), named(nodes_of(e), "id"), F.broadcast(layers), F.broadcast(allowed))  # a few rows


def churn(spark, sf):
    return G.churn(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")))


def cochange_partners(spark, sf):
    return G.cochange(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")))


def change_impact_risk(spark, sf):
    """The suppliers of each nation change together, and regions each on its own."""
    e = depends_on(spark, sf)
    by_nation = e.where(f"caller between {SUPPLIER} and {PART - 1}").select(name(F.col("callee")).alias("file"), F.col("caller").alias("id"))
    changes = by_nation.unionByName(of_kind(e, REGION).select(name(F.col("id")).alias("file"), "id"))
    tests = G.cut(test_nodes(e))
    ranked = G.hubs(G.cut(named(G.hub_rows(e, tests).withColumn("symbol", F.col("id")), "symbol")))
    n = ranked.count()
    top = G.cut(G.hubs(ranked, max(n // 10, min(n, 5))).select("id"))
    return G.change_risk(changes, e, nodes_of(e), tests, top)


def boundary_violations(spark, sf):
    e = depends_on(spark, sf)
    rules = spark.createDataFrame([(1, "order", "*", "forbid"), (2, "order", "customer", "allow"), (3, "customer", "nation", "forbid")], "ord int, src string, dst string, action string")
    return G.boundary_violations(e, nodes_of(e), F.broadcast(rules))  # three rows


OWNER_RULES = [("*", "all", 0), ("*.com", "com", 1), ("http://", "plain", 2), ("https://", "secure", 3)]


def ownership_lookup(spark, sf):
    rules = spark.createDataFrame(OWNER_RULES, "pattern string, owner string, ord int")
    return G.owners(table(spark, sf, "pages").select(F.col("url").alias("path")).where("path is not null").distinct(), F.broadcast(rules))


def canonical_names(spark, sf):
    """Part names are simple names; the brand and name are the full name. Every full name stands for itself."""
    from talus.operators.symbols import canonical

    p = table(spark, sf, "part").select(F.concat_ws(" ", F.lit("a"), "p_type").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("full_name")).distinct()
    return canonical(p)


def manifest_diff(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return G.manifest_diff(old, new)


def range_overlap_changes(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", F.floor("o_totalprice").alias("line"), F.floor(F.col("o_totalprice") + 500).alias("end"))
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"), F.floor(F.abs("c_acctbal") * 10).alias("lo"), F.floor(F.abs("c_acctbal") * 10 + 20000).alias("hi"))
    return G.overlapping(s, r)


def qualified_callee_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("caller"), F.col("c_nationkey").alias("pkg"), F.col("c_mktsegment").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("pkg"), F.col("s_name").alias("callee"), F.col("s_suppkey").alias("ord"))
    first = s.groupBy("pkg").agg(F.min_by("callee", "ord").alias("callee"))
    return c.join(first, "pkg").select("caller", "callee", "name")


def inheritance_subtypes(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("base")).agg(F.countDistinct("p_type").alias("subtypes"), F.count("*").alias("edges"))


def large_functions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(F.split("text", "\n")).alias("lines")).where("lines >= 20")


def languages(spark, sf):
    return table(spark, sf, "documents").select("lang").distinct()


def communities(spark, sf):
    """On the co-purchase graph: parts that two orders or more hold together."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("caller")).distinct()
    pairs = c.join(c.withColumnRenamed("caller", "callee"), "k").where("caller < callee")
    return G.label_propagation(pairs.groupBy("caller", "callee").agg(F.count("*").alias("n")).where("n >= 2"))


def shortest_path(spark, sf):
    path = G.shortest_path(depends_on(spark, sf), REGION, REGION + 1)
    return path.select(F.array_join(F.transform("path", name), ">").alias("path"), "hops")


def connecting_paths(spark, sf):
    """Between each customer whose key is divisible by 20 and the region after its own, all at once."""
    e = depends_on(spark, sf)
    c = table(spark, sf, "customer").where("c_custkey % 20 = 0").select((F.col("c_custkey") + F.lit(CUSTOMER)).alias("start"), F.col("c_nationkey").alias("n_nationkey"))
    home = table(spark, sf, "nation").select("n_nationkey", ((F.col("n_regionkey") + 1) % 5 + F.lit(REGION)).alias("goal"))
    pairs = c.join(home, "n_nationkey").select(F.col("start").alias("pair"), "start", "goal")
    return paths_between(e, pairs).select(name(F.col("pair")).alias("start"), F.array_join(F.transform("path", name), ">").alias("path"), "hops")


QUERIES = {f.__name__: f for f in (hubs, bridges, callers_prod, dead_nodes, coverage_gaps, blast_radius, transitive_callees, criticality, who_depends, arch_coupling, near_nation, whole_graph, flow_roots, flows, criticality_levels, layer_check, churn, cochange_partners, change_impact_risk, boundary_violations, ownership_lookup, canonical_names, manifest_diff, range_overlap_changes, qualified_callee_join, inheritance_subtypes, large_functions, languages, communities, shortest_path, connecting_paths)}

TESTS = "tests AS (SELECT id FROM nodes WHERE dir = 'order' AND id LIKE '%7')"
PROD = "prod AS (SELECT * FROM edges WHERE caller NOT IN (SELECT id FROM tests))"
HUBS = f"""{EDGES}, {TESTS}, {PROD}, c AS (SELECT callee AS symbol, count(*) AS callers FROM prod GROUP BY callee), d AS (SELECT caller AS symbol, count(*) AS calls FROM edges GROUP BY caller),
        h AS (SELECT coalesce(c.symbol, d.symbol) AS symbol, coalesce(callers, 0) AS callers, coalesce(calls, 0) AS calls, 2 * coalesce(callers, 0) + coalesce(calls, 0) AS score FROM c FULL JOIN d ON c.symbol = d.symbol
              WHERE coalesce(c.symbol, d.symbol) NOT IN (SELECT id FROM tests)),
        ranked AS (SELECT *, row_number() OVER (ORDER BY callers DESC, score DESC, symbol) AS k, count(*) OVER () AS n FROM h),
        top AS (SELECT * FROM ranked WHERE k <= greatest(n // 10, least(n, 8)))"""
REACH = """r AS (SELECT id AS root, id, 0 AS dist FROM roots UNION SELECT root, caller, dist + 1 FROM r JOIN edges ON callee = r.id)"""
#: The undirected graph by node numbers, and the least shortest paths of pairs (pair, start, goal) over it.
PATHS = f"""
        n AS (SELECT id, list_position([{", ".join(f"'{k}'" for k in KINDS)}], dir) * 1000000000000000 + CAST(split_part(id, ':', 2) AS BIGINT) AS k FROM nodes),
        u AS MATERIALIZED (SELECT a.k AS src, b.k AS dst FROM edges JOIN n a ON a.id = caller JOIN n b ON b.id = callee UNION SELECT b.k, a.k FROM edges JOIN n a ON a.id = caller JOIN n b ON b.id = callee),
        goals AS (SELECT DISTINCT goal FROM pairs),
        far AS (SELECT goal, goal AS id, 0 AS dist FROM goals UNION SELECT goal, dst, dist + 1 FROM far JOIN u ON src = far.id WHERE dist < 7),
        near AS MATERIALIZED (SELECT goal, id, min(dist) AS dist FROM far GROUP BY 1, 2),
        p AS (SELECT pair, goal, start AS id, [start] AS path FROM pairs
              UNION ALL SELECT pair, p.goal, min(dst), list_append(path, min(dst)) FROM p JOIN near x ON x.goal = p.goal AND x.id = p.id JOIN u ON src = p.id JOIN near y ON y.goal = p.goal AND y.id = dst AND y.dist = x.dist - 1 GROUP BY pair, p.goal, path)
        SELECT {{}}array_to_string(list_transform(path, lambda x: [{", ".join(f"'{k}'" for k in KINDS)}][CAST(x // 1000000000000000 AS INT)] || ':' || (x % 1000000000000000)), '>') AS path, len(path) - 1 AS hops FROM p WHERE id = goal"""
ORACLES = {
    "shortest_path": f"WITH RECURSIVE {EDGES}, pairs AS (SELECT 1 AS pair, 1000000000000000 AS start, 1000000000000001 AS goal), {PATHS.format('')}",
    "connecting_paths": f"""WITH RECURSIVE {EDGES}, pairs AS (SELECT c_custkey AS pair, 3000000000000000 + c_custkey AS start, 1000000000000000 + (n_regionkey + 1) % 5 AS goal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 = 0), {PATHS.format("'customer:' || pair AS start, ")}""",
    "hubs": f"WITH {HUBS} SELECT symbol, callers, calls, score FROM top",
    "bridges": f"""WITH {EDGES}, {TESTS}, {PROD} SELECT callee AS symbol, count(DISTINCT dir) AS dirs, count(*) AS callers FROM prod JOIN nodes ON caller = id
        WHERE callee NOT IN (SELECT id FROM tests) GROUP BY callee HAVING count(DISTINCT dir) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15""",
    "callers_prod": f"WITH {EDGES}, {TESTS} SELECT callee AS symbol, count(*) AS callers FROM edges WHERE caller NOT IN (SELECT id FROM tests) GROUP BY callee",
    "dead_nodes": f"WITH {EDGES}, {TESTS} SELECT id, dir FROM nodes WHERE id NOT IN (SELECT id FROM tests) AND id NOT IN (SELECT callee FROM edges WHERE caller NOT IN (SELECT id FROM tests))",
    "coverage_gaps": f"""WITH RECURSIVE {EDGES}, {TESTS}, r AS (SELECT id FROM tests UNION SELECT callee FROM r JOIN edges ON caller = r.id)
        SELECT n.dir, count(*) AS total, count(r.id) AS covered, round(100.0 * count(r.id) / count(*), 4) AS percent FROM nodes n LEFT JOIN r ON n.id = r.id WHERE n.id NOT IN (SELECT id FROM tests) GROUP BY n.dir""",
    "blast_radius": f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'region:0' AS id, 0 AS dist UNION SELECT caller, dist + 1 FROM r JOIN edges ON callee = r.id WHERE dist < 50)
        SELECT id, min(dist) AS dist FROM r GROUP BY id""",
    "transitive_callees": f"""WITH RECURSIVE {EDGES}, r AS (SELECT id, 0 AS dist FROM nodes WHERE dir = 'order' UNION SELECT callee, dist + 1 FROM r JOIN edges ON caller = r.id WHERE dist < 50)
        SELECT id, min(dist) AS dist FROM r GROUP BY id HAVING min(dist) > 0""",
    "criticality": f"""WITH RECURSIVE {EDGES}, roots AS (SELECT id FROM nodes WHERE dir IN ('region', 'nation', 'supplier')), {REACH},
        n AS (SELECT root AS symbol, count(DISTINCT id) - 1 AS dependents FROM r GROUP BY root)
        SELECT *, CASE WHEN dependents > 20 THEN 'critical' WHEN dependents >= 10 THEN 'high' WHEN dependents >= 3 THEN 'medium' ELSE 'low' END AS level FROM n""",
    "who_depends": f"""WITH RECURSIVE {EDGES}, roots AS (SELECT id FROM nodes WHERE dir = 'nation'), {REACH},
        n AS (SELECT root, count(DISTINCT id) - 1 AS dependents FROM r GROUP BY root),
        d AS (SELECT callee AS root, count(*) AS direct FROM edges GROUP BY callee)
        SELECT d.root AS symbol, direct, dependents, (SELECT count(*) FROM edges WHERE caller = d.root) AS dependencies FROM d JOIN n ON d.root = n.root""",
    "near_nation": f"""WITH RECURSIVE {EDGES}, pairs AS (SELECT caller AS a, callee AS b FROM edges UNION SELECT callee, caller FROM edges),
        r AS (SELECT 'nation:0' AS id, 0 AS dist UNION SELECT b, dist + 1 FROM r JOIN pairs ON a = r.id WHERE dist < 2), m AS (SELECT id, min(dist) AS dist FROM r GROUP BY id)
        SELECT split_part(id, ':', 1) AS dir, dist, count(*) AS n FROM m GROUP BY 1, 2""",
    "whole_graph": f"""WITH {EDGES}, d AS (SELECT id, count(*) AS n FROM (SELECT caller AS id FROM edges UNION ALL SELECT callee FROM edges) GROUP BY id ORDER BY n DESC, id LIMIT 400)
        SELECT caller, callee FROM edges WHERE caller IN (SELECT id FROM d) AND callee IN (SELECT id FROM d)""",
    "flow_roots": f"""WITH RECURSIVE {EDGES}, roots AS (SELECT id FROM nodes WHERE id IN (SELECT caller FROM edges) AND id NOT IN (SELECT callee FROM edges) ORDER BY id LIMIT 10),
        r AS (SELECT id AS root, id FROM roots UNION SELECT root, callee FROM r JOIN edges ON caller = r.id)
        SELECT root, count(*) - 1 AS reached FROM r GROUP BY root""",
    "flows": f"""WITH RECURSIVE {EDGES}, roots AS (SELECT DISTINCT caller AS id FROM edges WHERE caller NOT IN (SELECT callee FROM edges)),
        r AS (SELECT id AS root, id FROM roots UNION SELECT root, callee FROM r JOIN edges ON caller = r.id),
        n AS (SELECT root, count(*) - 1 AS reached FROM r GROUP BY root),
        few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY callee) AS nth FROM edges) WHERE nth <= 3),
        p AS (SELECT id AS root, id, [id] AS path FROM roots UNION ALL SELECT root, callee, list_append(path, callee) FROM p JOIN few ON caller = p.id WHERE len(path) < 12),
        b AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY len(path) DESC, path) AS k FROM p)
        SELECT b.root, len(path) AS depth, reached, array_to_string(path, '>') AS path FROM b JOIN n ON b.root = n.root WHERE k = 1""",
    "criticality_levels": f"""WITH RECURSIVE {EDGES}, roots AS (SELECT id FROM nodes), {REACH},
        n AS (SELECT root AS symbol, count(DISTINCT id) - 1 AS dependents FROM r GROUP BY root)
        SELECT symbol, least(dependents, 256) AS dependents,
               CASE WHEN dependents > 20 THEN 'critical' WHEN dependents >= 10 THEN 'high' WHEN dependents >= 3 THEN 'medium' ELSE 'low' END AS level FROM n""",
    "layer_check": f"""WITH {EDGES}, l AS (SELECT id, CASE dir WHEN 'order' THEN 'sales' WHEN 'customer' THEN 'party' WHEN 'supplier' THEN 'party' WHEN 'nation' THEN 'place' WHEN 'region' THEN 'place' END AS layer FROM nodes)
        SELECT a.layer AS src_layer, b.layer AS dst_layer, count(*) AS n, min(caller || '>' || callee) AS sample FROM edges JOIN l a ON caller = a.id JOIN l b ON callee = b.id
        WHERE a.layer <> b.layer AND NOT (a.layer = 'sales' AND b.layer = 'party') GROUP BY 1, 2""",
    "arch_coupling": f"""WITH {EDGES} SELECT least(a.dir, b.dir) AS "left", greatest(a.dir, b.dir) AS "right", count(*) AS edges, min(caller || '>' || callee) AS sample
        FROM edges JOIN nodes a ON caller = a.id JOIN nodes b ON callee = b.id WHERE a.dir <> b.dir GROUP BY 1, 2""",
    "churn": "SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY l_partkey",
    "cochange_partners": """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem),
        n AS (SELECT a.f AS file, b.f AS partner, count(*) AS n FROM c a JOIN c b ON a.k = b.k AND a.f <> b.f GROUP BY 1, 2 HAVING count(*) >= 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, partner) AS rank FROM n) SELECT * FROM r WHERE rank <= 3""",
    "change_impact_risk": f"""WITH RECURSIVE {HUBS}, n8 AS (SELECT count(*) AS n FROM top), hub AS (SELECT symbol AS id FROM top, n8 WHERE k <= greatest(n8.n // 10, least(n8.n, 5))),
        changed AS (SELECT callee AS file, caller AS id FROM edges WHERE caller LIKE 'supplier:%' UNION SELECT id, id FROM nodes WHERE dir = 'region'),
        calls_of AS (SELECT DISTINCT file, caller AS id FROM changed JOIN prod ON callee = id),
        r AS (SELECT file, id FROM changed UNION SELECT file, caller FROM r JOIN edges ON callee = r.id),
        rest AS (SELECT file, id FROM r EXCEPT SELECT file, id FROM calls_of EXCEPT SELECT file, id FROM changed),
        cov AS (SELECT id FROM tests UNION SELECT callee FROM cov JOIN edges ON caller = cov.id),
        near AS (SELECT DISTINCT file, dir FROM changed JOIN edges ON callee = changed.id JOIN nodes ON nodes.id = caller),
        loud AS (SELECT DISTINCT caller AS id FROM edges WHERE callee IN (SELECT id FROM hub)),
        each AS (SELECT file, count(*) AS symbols, count(*) FILTER (WHERE id NOT IN (SELECT id FROM cov)) AS gaps, count(*) FILTER (WHERE id IN (SELECT id FROM hub)) AS hubs,
                        count(*) FILTER (WHERE id IN (SELECT id FROM loud)) AS loud FROM changed GROUP BY file),
        f AS (SELECT e.*, (SELECT count(*) FROM calls_of c WHERE c.file = e.file) AS callers, (SELECT count(*) FROM rest c WHERE c.file = e.file) AS rest, (SELECT count(*) FROM near c WHERE c.file = e.file) AS packages FROM each e)
        SELECT file, symbols, callers, callers + rest AS blast, gaps, packages,
               round(1 + log2(1 + callers) + log2(1 + rest) + hubs + 0.5 * loud + CASE WHEN packages > 1 THEN 1.5 ELSE 0 END + CASE WHEN gaps > 0 THEN 2.0 ELSE 0 END, 1) AS risk FROM f""",
    "boundary_violations": f"""WITH {EDGES}, n AS (SELECT a.dir AS src_dir, b.dir AS dst_dir, count(*) AS n FROM edges JOIN nodes a ON caller = a.id JOIN nodes b ON callee = b.id GROUP BY 1, 2),
        rules AS (SELECT * FROM (VALUES (1, 'order', '*', 'forbid'), (2, 'order', 'customer', 'allow'), (3, 'customer', 'nation', 'forbid')) AS v(ord, src, dst, action)),
        p AS (SELECT src_dir, dst_dir, n, min(CASE WHEN action = 'forbid' THEN ord END) AS rule, max(CASE WHEN action = 'allow' THEN 1 ELSE 0 END) AS lifted
              FROM n JOIN rules ON (src = '*' OR src = src_dir) AND (dst = '*' OR dst = dst_dir) GROUP BY 1, 2, 3)
        SELECT src_dir, dst_dir, n, rule FROM p WHERE rule IS NOT NULL AND lifted = 0 AND src_dir <> dst_dir""",
    "ownership_lookup": """SELECT DISTINCT url AS path, CASE WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http://%' THEN 'plain' WHEN url LIKE '%.com' THEN 'com' ELSE 'all' END AS owner FROM pages WHERE url IS NOT NULL""",
    "canonical_names": """WITH s AS (SELECT DISTINCT 'a ' || p_type AS name, p_brand || '/' || p_type AS full_name FROM part)
        SELECT name, min(full_name) AS full_name FROM s GROUP BY name HAVING count(*) = 1 UNION SELECT full_name, full_name FROM s""",
    "manifest_diff": """SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'modified' END AS change FROM documents
        WHERE (doc_id % 7 = 0 AND doc_id % 5 <> 0) OR (doc_id % 7 <> 0 AND doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0)""",
    "range_overlap_changes": """SELECT o_custkey AS file, o_orderkey, floor(o_totalprice)::BIGINT AS line, floor(o_totalprice + 500)::BIGINT AS "end" FROM orders
        WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND floor(o_totalprice) <= floor(abs(c_acctbal) * 10 + 20000) AND floor(o_totalprice + 500) >= floor(abs(c_acctbal) * 10))""",
    "qualified_callee_join": """WITH s AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
        SELECT c_custkey AS caller, s_name AS callee, c_mktsegment AS name FROM customer JOIN s ON c_nationkey = s_nationkey AND k = 1""",
    "inheritance_subtypes": "SELECT p_brand AS base, count(DISTINCT p_type) AS subtypes, count(*) AS edges FROM part GROUP BY p_brand",
    "large_functions": "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents WHERE length(text) - length(replace(text, chr(10), '')) + 1 >= 20",
    "languages": "SELECT DISTINCT lang FROM documents",
}
