"""Symbol questions bound to a project that is read off the order tables.

Nodes of the depends-on graph are symbols: a region is an interface, a part a method, any other a function; names
are the kind's letter and the key, upper case for regions, nations and suppliers. Each kind is a folder of seven
files; orders whose key ends in 7 are tests. Calls are written with the folder in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import symbols as S
from talus.plans import graph as P
from talus.sources import stores as ST
from talus.tables import table

LETTERS = {"region": "R", "nation": "N", "customer": "c", "supplier": "S", "part": "p", "order": "o"}

#: The kinds in order of their letters.
BY_LETTER = tuple(sorted(LETTERS, key=LETTERS.get))


def short(node: Column) -> Column:
    letter = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))[P.kind(node)]
    return F.concat(letter, (node % F.lit(P.STEP)).cast("string"))


def numbered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """symbols and edges (caller, callee) with node numbers for names."""
    e = P.depends_on(spark, sf)
    key, folder = F.col("id") % F.lit(P.STEP), F.col("dir")
    test = (folder == "order") & (key % 10 == 7)
    file = F.when(test, F.concat(F.lit("tests/order"), (key % 50).cast("string"), F.lit("_test.go"))).otherwise(F.concat(F.lit("src/"), folder, F.lit("/"), folder, (key % 7).cast("string"), F.lit(".go")))
    line = (key % 1000 + 1).cast("int")
    name = F.col("id")
    kind = F.when(folder == "region", "interface").when(folder == "part", "method").otherwise("func")
    symbols = P.nodes_of(e).select(kind.alias("kind"), name.alias("name"), F.lit("").alias("receiver"), name.alias("full_name"), file.alias("file"), line.alias("line"), (line + key % 90).cast("int").alias("end"), folder.alias("home"))
    return G.cut(symbols), e


def project(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """symbols and edges (caller, callee) by name; names are made where rows are read."""
    s, e = numbered(spark, sf)
    return shortened(s, "name", "full_name"), shortened(e, "caller", "callee")


def shortened(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: short(F.col(c)) for c in columns})


def written(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The calls as written: folder.name."""
    home = symbols.select(F.col("name").alias("callee"), "home")
    return edges.join(home, "callee").select("caller", F.concat_ws(".", "home", "callee").alias("callee"))


def refs(spark: SparkSession, sf: str) -> DataFrame:
    """Every eleventh part and supplier is referred to from a page."""
    name = lambda t, c, letter: table(spark, sf, t).where(F.col(c) % 11 == 0).select(F.concat(F.lit(letter), F.col(c).cast("string")).alias("name"), F.lit("docs/use.md").alias("file"))
    return name("part", "p_partkey", "p").unionByName(name("supplier", "s_suppkey", "S"))


def symbol_calls(spark, sf):
    """Calls as written and, resolved by folder, of the symbol meant."""
    s, e = project(spark, sf)
    return S.callers(s, written(s, e))


def symbol_local_calls(spark, sf):
    s, e = project(spark, sf)
    return S.local_calls(s, written(s, e))


def symbol_coverage(spark, sf):
    return shortened(S.coverage(*numbered(spark, sf)), "full_name")


def symbol_hubs(spark, sf):
    return S.hubs(*project(spark, sf))


def symbol_bridges(spark, sf):
    out = S.bridges(*project(spark, sf))
    return out.withColumn("packages", F.array_join("packages", ","))


def dead_symbols(spark, sf):
    s, e = project(spark, sf)
    return S.dead_code(s, e, refs(spark, sf))


def delete_checks(spark, sf):
    """Of every part, supplier and nation, and of names that do not exist."""
    s, e = project(spark, sf)
    names = s.where("home in ('part', 'supplier', 'nation')").select("name").unionByName(table(spark, sf, "region").select(F.concat(F.lit("gone"), "r_regionkey").alias("name")))
    return S.delete_check(s, e, refs(spark, sf), names)


def large_symbols(spark, sf):
    s, _ = project(spark, sf)
    return S.large_functions(s, 80)


def symbol_near(spark, sf):
    """The fifty nearest symbols around a nation, with the way back."""
    _, e = project(spark, sf)
    return S.near(e, "N0")


def symbol_flows(spark, sf):
    """All functions outside tests that nothing calls."""
    s, e = numbered(spark, sf)
    order = lambda df, *columns: df.withColumns({c: P.ranked(F.col(c), BY_LETTER) for c in columns})
    return S.flows(order(s, "full_name"), G.cut(order(e, "caller", "callee")), None, said=lambda c: short(P.unranked(c, BY_LETTER)))


def symbol_files(spark, sf):
    """The files of all that depends on a region."""
    s, e = numbered(spark, sf)
    hit = G.closure(e, s.where(F.col("name") == P.REGION).select(F.col("name").alias("id")), reverse=True)
    return S.affected_files(s, hit.select(F.col("id").alias("full_name")))


def symbol_subtypes(spark, sf):
    """Types of parts extend their brands."""
    p = table(spark, sf, "part")
    inherits = p.select(F.col("p_type").alias("subtype"), F.lit("extends").alias("edge_kind"), F.col("p_brand").alias("base"))
    return S.subtypes(inherits, p.select(F.col("p_brand").alias("name")).distinct())


def symbol_edges(spark, sf):
    """The edges of a nation, each with how well its other end is known."""
    s, e = project(spark, sf)
    return S.neighbourhood_graph(s, e, "N0")


def savings_summary(spark, sf):
    """Events as records of savings: what the last ten days saved, in all and by operation."""
    e = table(spark, sf, "events").where("ts is not null and value is not null")
    before = F.round(F.col("value") * 100).cast("long")
    rows = e.select(
        F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("operation"), before.alias("before_tokens"),
        F.floor(before / 4).alias("after_tokens"), (before - F.floor(before / 4)).alias("saved_tokens"), F.lit(0.0).alias("cost_saved"),
    )
    rows = G.cut(rows)
    last = str(rows.agg(F.max("day")).first()[0])
    out = ST.summarize(rows, last, 10)
    said = F.array_join(F.transform(F.map_entries("by_operation"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return out.select("operations", "before_total", "after_total", "saved_total", F.round("saved_percent", 4).alias("saved_percent"), said.alias("by_operation"))


QUERIES = {f.__name__: f for f in (symbol_calls, symbol_local_calls, symbol_coverage, symbol_hubs, symbol_bridges, dead_symbols, delete_checks, large_symbols, symbol_near, symbol_flows, symbol_files, symbol_subtypes, symbol_edges, savings_summary)}

_NAME = lambda c: f"""(CASE split_part({c}, ':', 1) WHEN 'region' THEN 'R' WHEN 'nation' THEN 'N' WHEN 'customer' THEN 'c' WHEN 'supplier' THEN 'S' WHEN 'part' THEN 'p' ELSE 'o' END || split_part({c}, ':', 2))"""
PROJECT = f"""{P.EDGES.replace("edges AS", "named AS").replace("FROM edges", "FROM named")},
        edges AS (SELECT {_NAME("caller")} AS caller, {_NAME("callee")} AS callee FROM named),
        sym AS (SELECT CASE dir WHEN 'region' THEN 'interface' WHEN 'part' THEN 'method' ELSE 'func' END AS kind, {_NAME("id")} AS name, k % 1000 + 1 AS line, k % 1000 + 1 + k % 90 AS "end", dir AS home,
                       dir = 'order' AND k % 10 = 7 AS test, CASE WHEN dir = 'order' AND k % 10 = 7 THEN 'tests/order' || (k % 50) || '_test.go' ELSE 'src/' || dir || '/' || dir || (k % 7) || '.go' END AS file
                FROM (SELECT *, split_part(id, ':', 2)::BIGINT AS k FROM nodes)),
        f AS (SELECT * FROM sym WHERE kind IN ('func', 'method') AND NOT test),
        prod AS (SELECT * FROM edges WHERE caller NOT IN (SELECT name FROM sym WHERE test)),
        refs AS (SELECT 'p' || p_partkey AS name FROM part WHERE p_partkey % 11 = 0 UNION SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 11 = 0)"""
ORACLES = {
    "symbol_calls": f"WITH {PROJECT} SELECT caller, home || '.' || callee AS callee FROM edges JOIN sym ON name = callee UNION SELECT caller, callee FROM edges",
    "symbol_local_calls": f"WITH {PROJECT} SELECT caller, callee FROM edges",
    "symbol_coverage": f"""WITH RECURSIVE {PROJECT}, r AS (SELECT name AS id FROM sym WHERE test UNION SELECT callee FROM r JOIN edges ON caller = r.id)
        SELECT name AS full_name, file, name IN (SELECT id FROM r) AS covered, (SELECT count(*) FROM prod WHERE callee = name) AS callers FROM f""",
    "symbol_hubs": f"""WITH {PROJECT}, h AS (SELECT name AS symbol, file, line, (SELECT count(*) FROM prod WHERE callee = name) AS callers, (SELECT count(*) FROM edges WHERE caller = name) AS calls FROM f),
        g AS (SELECT *, 2 * callers + calls AS score FROM h WHERE callers > 0 OR calls > 0), k AS (SELECT *, row_number() OVER (ORDER BY callers DESC, score DESC, symbol) AS k, count(*) OVER () AS n FROM g)
        SELECT symbol, file, line, callers, calls, score FROM k WHERE k <= greatest(n // 10, least(n, 8))""",
    "symbol_bridges": f"""WITH {PROJECT}, c AS (SELECT callee, count(*) AS callers, list_sort(list(DISTINCT regexp_replace(sym.file, '/?[^/]*$', ''))) AS p FROM prod JOIN sym ON sym.name = caller GROUP BY callee)
        SELECT name AS symbol, file, callers, array_to_string(p, ',') AS packages FROM f JOIN c ON callee = name WHERE len(p) >= 2 ORDER BY len(p) DESC, callers DESC, symbol LIMIT 15""",
    "dead_symbols": f"""WITH {PROJECT} SELECT name AS full_name, file, line, "end" - line + 1 AS lines, regexp_matches(name, '^[A-Z]') AS public FROM f WHERE name NOT IN (SELECT callee FROM prod) AND name NOT IN (SELECT name FROM refs)""",
    "delete_checks": f"""WITH {PROJECT}, n AS (SELECT name FROM sym WHERE home IN ('part', 'supplier', 'nation') UNION ALL SELECT 'gone' || r_regionkey FROM region),
        p AS (SELECT callee, string_agg(caller, ', ' ORDER BY caller) AS prod FROM prod GROUP BY callee), a AS (SELECT callee, string_agg(caller, ', ' ORDER BY caller) AS every FROM edges GROUP BY callee),
        r AS (SELECT n.name, CASE WHEN n.name LIKE 'gone%' THEN 'not found' WHEN n.name IN (SELECT name FROM refs) THEN 'referenced: docs/use.md' WHEN prod IS NOT NULL THEN 'called: ' || prod WHEN regexp_matches(n.name, '^[A-Z]') THEN 'public'
                     WHEN every IS NOT NULL THEN 'only tests: ' || every ELSE 'no callers' END AS reason FROM n LEFT JOIN p ON p.callee = n.name LEFT JOIN a ON a.callee = n.name)
        SELECT name, reason, reason LIKE 'only tests%' OR reason = 'no callers' AS safe FROM r""",
    "large_symbols": f"""WITH {PROJECT} SELECT name AS full_name, file, line, "end" - line + 1 AS lines FROM f WHERE "end" - line + 1 >= 80""",
    "symbol_near": f"""WITH {PROJECT}, u AS (SELECT caller AS a, callee AS b, 'callee' AS direction FROM edges UNION ALL SELECT callee, caller, 'caller' FROM edges),
        one AS (SELECT b AS id, 1 AS depth, 'N0' AS parent, min(direction) AS direction FROM u WHERE a = 'N0' GROUP BY b),
        two AS (SELECT b AS id, 2 AS depth, min((a, u.direction)) AS m FROM u JOIN one ON one.id = a WHERE b <> 'N0' AND b NOT IN (SELECT id FROM one) GROUP BY b),
        x AS (SELECT 'N0' AS id, 0 AS depth, '' AS parent, '' AS direction UNION ALL SELECT * FROM one UNION ALL SELECT id, depth, m[1], m[2] FROM two)
        SELECT * FROM x ORDER BY depth, id LIMIT 50""",
    "symbol_flows": f"""WITH RECURSIVE {PROJECT}, roots AS (SELECT name AS id, file FROM f WHERE name IN (SELECT caller FROM edges) AND name NOT IN (SELECT callee FROM edges)),
        r AS (SELECT id AS root, id FROM roots UNION SELECT root, callee FROM r JOIN edges ON caller = r.id), n AS (SELECT root, count(*) - 1 AS reached FROM r GROUP BY root),
        few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY callee) AS nth FROM edges) WHERE nth <= 3),
        p AS (SELECT id AS root, id, [id] AS path FROM roots UNION ALL SELECT root, callee, list_append(path, callee) FROM p JOIN few ON caller = p.id WHERE len(path) < 12),
        b AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY len(path) DESC, path) AS k FROM p)
        SELECT b.root, file, len(path) AS depth, reached, array_to_string(path, '>') AS path FROM b JOIN n ON b.root = n.root JOIN roots ON roots.id = b.root WHERE k = 1""",
    "symbol_files": f"""WITH RECURSIVE {PROJECT}, r AS (SELECT 'R0' AS id UNION SELECT caller FROM r JOIN edges ON callee = r.id) SELECT DISTINCT file FROM sym WHERE name IN (SELECT id FROM r)""",
    "symbol_subtypes": "SELECT DISTINCT p_brand AS name, p_type AS subtype FROM part",
    "symbol_edges": f"WITH {PROJECT} SELECT caller AS src, callee AS dst, 'EXTRACTED' AS confidence FROM edges WHERE caller = 'N0' OR callee = 'N0'",
    "savings_summary": """WITH r AS (SELECT ts::DATE AS day, event_type, round(value * 100)::BIGINT AS b FROM events WHERE ts IS NOT NULL AND value IS NOT NULL), l AS (SELECT * FROM r WHERE day >= (SELECT max(day) FROM r) - 9),
        o AS (SELECT event_type, count(*) AS n FROM l GROUP BY 1)
        SELECT count(*) AS operations, sum(b)::BIGINT AS before_total, sum(b // 4)::BIGINT AS after_total, sum(b - b // 4)::BIGINT AS saved_total, round(100.0 * sum(b - b // 4) / sum(b)::DOUBLE, 4) AS saved_percent,
               (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM o) AS by_operation FROM l""",
}
