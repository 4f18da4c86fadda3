"""Questions about symbols: search, resolution, callers, dispatch, dead code, neighbourhoods.

Tables: symbols (kind, name, receiver, full_name, file, line, end, lang, entry, framework, route,
doc), calls (caller, callee), inherits (subtype, edge_kind, base), files (path, hash, generated,
tokens), refs (name, file): uses of a name outside calls. All are plain DataFrames; names
join names, and every order has a total tie-break.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.text import identifier_segments, plural_variants, query_words, strip_diacritics
from talus.operators import graph as G
from talus.operators import reachability as R

# File names and folders of tests.
TEST_ENDS = r"(_test\.(go|py|rb|js|ts)|_spec\.(rb|py)|\.test\.(ts|tsx|js|jsx|mjs|cjs|py|rb|go)|\.spec\.(ts|tsx|js|jsx|rb|py))$"
TEST_DIRS = r"(^|/)(test|tests|spec|__tests__)/"
# Last parts of names that start a program.
ENTRY_NAMES = ("main", "init", "run", "Run", "Main", "setup", "Setup", "start", "Start")
# Kinds that a search for types takes.
TYPE_KINDS = ("type", "class", "interface", "struct", "enum", "record", "trait", "union")
SEARCH_KINDS = ("func", "method", "struct", "interface", "type", "const", "var", "class", "enum", "trait", "module", "union", "impl", "prop", "heading", "entry")
# Scores of a word's best match, for all words, and of generated files.
TIERS = {"name": 100, "full": 95, "segment": 90, "full_prefix": 80, "name_prefix": 70, "folded": 66, "name_part": 60, "full_part": 45, "file": 20}
ALL_WORDS, GENERATED = 150, -60


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def folder(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def test_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(TEST_ENDS) | low.rlike(r"(^|/)test[_-][^/]*$") | low.rlike(TEST_DIRS)


def entry_point(full_name: Column) -> Column:
    return last_part(full_name).isin(*ENTRY_NAMES)


def public(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def functions(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("func", "method"))


def symbol_files(symbols: DataFrame) -> DataFrame:
    """(full_name, file): the last definition's file, by file and line."""
    return symbols.where("file <> ''").groupBy("full_name").agg(F.max(F.struct("file", "line"))["file"].alias("file"))


def pattern_search(symbols: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Symbols that '[kind ]glob' names by name, receiver.name or route; 'type' is every kind of
    type, 'entry' entry points. First by file and line."""
    kind, _, rest = pattern.partition(" ")
    kind, glob = (kind, rest) if rest and kind in SEARCH_KINDS else ("", pattern)
    p = "^" + ".*".join(map(re.escape, glob.split("*"))) + "$"
    hit = F.col("name").rlike(p) | ((F.col("receiver") != "") & F.col("full_name").rlike(p)) | ((F.col("route") != "") & F.col("route").rlike(p))
    if kind == "entry":
        hit = hit & F.col("entry")
    elif kind == "type":
        hit = hit & F.col("kind").isin(*TYPE_KINDS)
    elif kind:
        hit = hit & (F.col("kind") == kind)
    return symbols.where(hit).orderBy("file", "line", "full_name").limit(limit)


def search_scores(symbols: DataFrame, queries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(query, full_name, file, line, score) of symbols that match a word of a query (query, text);
    queries are few (a question's words), so they are sent to the symbols."""
    words = queries.select("query", F.explode(query_words(F.col("text"))).alias("word"))
    words = words.withColumn("words", F.count("*").over(Window.partitionBy("query")))
    s = symbols.select("full_name", "file", "line", F.lower("name").alias("n"), F.lower("full_name").alias("f"), F.lower("file").alias("p"), identifier_segments(F.col("name")).alias("segments"))
    w = F.col("word")
    folded = F.arrays_overlap(F.transform("segments", strip_diacritics), plural_variants(w))
    tiers = (
        (F.col("n") == w, "name"), (F.col("f") == w, "full"), (F.array_contains("segments", w), "segment"), (F.col("f").startswith(w), "full_prefix"),
        (F.col("n").startswith(w), "name_prefix"), (folded, "folded"), (F.contains("n", w), "name_part"), (F.contains("f", w), "full_part"), (F.contains("p", w), "file"),
    )
    score = F.coalesce(*(F.when(c, TIERS[t]) for c, t in tiers))
    hits = s.join(F.broadcast(words), score.isNotNull()).withColumn("tier", score)
    total = hits.groupBy("query", "full_name", "file", "line").agg((F.sum("tier") + F.when(F.count("*") == F.max("words"), ALL_WORDS).otherwise(0)).alias("score"))
    if files is not None:
        made = files.where("generated").select(F.col("path").alias("file"), F.lit(GENERATED).alias("less"))
        total = total.join(made, "file", "left").withColumn("score", F.col("score") + F.coalesce("less", F.lit(0)))
    return total.select("query", "full_name", "file", "line", F.col("score").cast("long").alias("score"))


def ranked_search(symbols: DataFrame, queries: DataFrame, files: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """The best symbols of each query with their rank: by score, then name, file and line."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "full_name", "file", "line")
    return search_scores(symbols, queries, files).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def search_repositories(symbols: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """``ranked_search`` over symbols of several repositories (repo): the best of each
    repository, then the best of those, by score and repository."""
    found = None
    keyed = symbols.withColumn("file", F.concat_ws(":", "repo", "file"))
    scores = search_scores(keyed, queries).withColumn("repo", F.split_part("file", F.lit(":"), F.lit(1)))
    per = Window.partitionBy("query", "repo").orderBy(F.desc("score"), "full_name", "file", "line")
    found = scores.withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= limit)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "repo", "full_name", "file", "line")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("nth")


def find(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """names (ref) -> (ref, full_name, file, line, how): an exact name or full name first, then the
    part behind the last dot or slash whose folder is the qualifier, then any with that part."""
    tail = F.regexp_extract("ref", r"([^./]*)$", 1)
    asked = names.select("ref", tail.alias("tail"), F.regexp_extract("ref", r"([^./]*)[./][^./]*$", 1).alias("qualifier")).distinct()
    s = symbols.select("name", "full_name", "file", "line", F.element_at(F.split(folder(F.col("file")), "/"), -1).alias("home"))
    keys = s.withColumn("key", F.explode(F.array_distinct(F.array("name", "full_name"))))
    # Of the symbols of a name in a folder only the first can be the answer: a name that very many have is a row a folder.
    keys = keys.groupBy("key", "home").agg(F.min(F.struct("file", "line", "full_name")).alias("s"))
    exact = asked.join(keys, asked["ref"] == keys["key"]).withColumn("how", F.lit(0))
    part = asked.join(keys, asked["tail"] == keys["key"]).withColumn("how", F.when(F.col("home") == F.col("qualifier"), 1).otherwise(2))
    out = exact.unionByName(part).groupBy("ref").agg(F.min(F.struct("how", "s")).alias("b"))
    out = out.select("ref", "b.s.full_name", "b.s.file", "b.s.line", F.col("b.how").alias("how"))
    return out.select("ref", "full_name", "file", "line", F.element_at(F.array(F.lit("exact"), F.lit("folder"), F.lit("tail")), F.col("how") + 1).alias("how"))


def canonical(symbols: DataFrame) -> DataFrame:
    """(name, full_name): every full name for itself, a simple name where only one symbol has it."""
    n = symbols.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.min("full_name").alias("full_name")).where("n = 1").drop("n")
    own = symbols.select(F.col("full_name").alias("name"), "full_name").distinct()
    return own.unionByName(n.join(own.select("name"), "name", "left_anti"))


def local_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller, callee): calls of project symbols, by the name as written or its last part; the
    symbol itself is none."""
    names = symbols.select(F.explode(F.array_distinct(F.array("full_name", "name"))).alias("known")).distinct()
    tried = calls.where("caller <> callee")
    written = tried.select("callee").distinct().withColumn("tail", last_part(F.col("callee")))  # each name is looked up once
    whole = names.select(F.col("known").alias("callee"), F.lit(True).alias("whole"))
    part = names.select(F.col("known").alias("tail"), F.lit(True).alias("part"))
    meant = written.join(whole, "callee", "left").join(part, "tail", "left").where("whole or part")
    out = tried.join(meant, "callee").where("whole or tail <> caller")
    return out.select("caller", F.when(F.col("whole"), F.col("callee")).otherwise(F.col("tail")).alias("callee")).distinct()


def qualified(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller, callee): calls of 'folder.Name' as calls of the first symbol so named in that folder."""
    s = symbols.select(F.explode(F.array_distinct(F.array("name", "full_name"))).alias("bare"), F.element_at(F.split(folder(F.col("file")), "/"), -1).alias("home"), "full_name", "file", "line")
    first = s.groupBy("bare", "home").agg(F.min(F.struct("file", "line", "full_name"))["full_name"].alias("target"))
    asked = calls.where("caller <> callee").select("caller", "callee", last_part(F.col("callee")).alias("bare"), F.regexp_extract("callee", r"^(.+)\.[^.]+$", 1).alias("home"))
    out = asked.where("home <> ''").join(first, ["bare", "home"]).where("target <> callee")
    return out.select("caller", F.col("target").alias("callee")).distinct()


def callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller, callee): calls as written and, for qualified ones, of the symbol meant."""
    return calls.where("caller <> callee").unionByName(qualified(symbols, calls)).distinct()


def alias_callers(calls: DataFrame) -> DataFrame:
    """(name, caller): callers of dotted names by their last part."""
    a = calls.where("caller <> callee").select(last_part(F.col("callee")).alias("name"), "caller", "callee")
    return a.where("name <> callee and name <> caller").select("name", "caller").distinct()


def callers_of(symbols: DataFrame, calls: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) -> (name, caller): exact callers; by the last part only for names of no symbol
    that nothing calls exactly."""
    known = symbols.select(F.explode(F.array("name", "full_name")).alias("name")).distinct()
    exact = names.join(callers(symbols, calls).withColumnRenamed("callee", "name"), "name")
    rest = names.join(known, "name", "left_anti").join(exact.select("name"), "name", "left_anti")
    return exact.select("name", "caller").unionByName(rest.join(alias_callers(calls), "name")).distinct()


def dispatch(symbols: DataFrame, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """(caller, callee): a call of Base.method also reaches the method of every direct subtype that has one."""
    via = calls.select("caller", F.regexp_extract("callee", r"^(.+)\.[^.]+$", 1).alias("base"), last_part(F.col("callee")).alias("method")).where("base <> ''")
    to = via.join(inherits.select("base", "subtype").distinct(), "base").select("caller", F.concat_ws(".", "subtype", "method").alias("callee"))
    return to.join(symbols.select(F.col("full_name").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee").distinct()


def call_edges(symbols: DataFrame, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """All call edges between symbols: resolved and dispatched."""
    return callers(symbols, calls).unionByName(dispatch(symbols, calls, inherits)).distinct()


def dispatch_hints(symbols: DataFrame, inherits: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) 'Base.method' -> (name, implementation) in its direct subtypes."""
    asked = names.select("name", F.regexp_extract("name", r"^(.+)\.[^.]+$", 1).alias("base"), last_part(F.col("name")).alias("method"))
    to = asked.join(inherits.select("base", "subtype").distinct(), "base").select("name", F.concat_ws(".", "subtype", "method").alias("implementation"))
    return to.join(symbols.select(F.col("full_name").alias("implementation")).distinct(), "implementation", "left_semi").select("name", "implementation")


def resolve_entries(symbols: DataFrame) -> DataFrame:
    """Symbols with ``entry`` and ``framework`` of the entry symbols that name them: by full name,
    else the first function of that simple name."""
    f = functions(symbols)
    first = lambda key: f.groupBy(F.col(key).alias("key")).agg(F.min(F.struct("file", "line", "full_name")).alias(key))
    e = symbols.where("kind = 'entry' and name <> ''").select(F.col("full_name").alias("key"), F.col("name").alias("bare"), F.col("framework").alias("by"))
    hit = e.join(first("full_name"), "key", "left").join(first("name").withColumnRenamed("key", "bare"), "bare", "left")
    target = F.coalesce("full_name", "name")
    marks = hit.where(target.isNotNull()).groupBy(target["full_name"].alias("_f"), target["file"].alias("_p"), target["line"].alias("_l")).agg(F.min("by").alias("_by"))
    out = symbols.join(marks, (F.col("full_name") == F.col("_f")) & (F.col("file") == F.col("_p")) & (F.col("line") == F.col("_l")), "left")
    entry = F.col("entry") | F.col("_f").isNotNull()
    framework = F.when((F.col("framework") == "") & F.col("_by").isNotNull(), F.col("_by")).otherwise(F.col("framework"))
    return out.withColumn("entry", entry).withColumn("framework", framework).drop("_f", "_p", "_l", "_by")


def supertypes(inherits: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) -> (name, edge_kind, base)."""
    return names.join(inherits.withColumnRenamed("subtype", "name"), "name").select("name", "edge_kind", "base").distinct()


def subtypes(inherits: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) -> (name, subtype)."""
    return names.join(inherits.withColumnRenamed("base", "name"), "name").select("name", "subtype").distinct()


def large_functions(symbols: DataFrame, least: int) -> DataFrame:
    """(full_name, file, line, lines) of functions outside tests, longest first."""
    lines = (F.col("end") - F.col("line") + 1).alias("lines")
    f = functions(symbols).where(~test_file(F.col("file"))).select("full_name", "file", "line", lines)
    return f.where(F.col("lines") >= least).orderBy(F.desc("lines"), "full_name", "file", "line")


def production_callers(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, callee) without callers in test files; callers of no known file stay."""
    tests = symbol_files(symbols).where(test_file(F.col("file"))).select(F.col("full_name").alias("caller"))
    return edges.join(tests, "caller", "left_anti").select("caller", "callee")


def hubs(symbols: DataFrame, edges: DataFrame, limit: int = 0) -> DataFrame:
    """(symbol, file, line, callers, calls, score) of functions outside tests that take part in the
    graph: by production callers, then 2 * callers + calls, then name. Without a limit the
    top tenth, eight at least."""
    prod = production_callers(symbols, edges).groupBy(F.col("callee").alias("full_name")).agg(F.count("*").alias("callers"))
    own = local_calls(symbols, edges).groupBy(F.col("caller").alias("full_name")).agg(F.count("*").alias("calls"))
    s = functions(symbols).where(~test_file(F.col("file"))).select("full_name", "file", "line")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = s.join(prod, "full_name", "left").join(own, "full_name", "left").select(F.col("full_name").alias("symbol"), "file", "line", zero("callers"), zero("calls"))
    rows = rows.where("callers > 0 or calls > 0").withColumn("score", 2 * F.col("callers") + F.col("calls"))
    if limit <= 0:
        n = rows.count()
        limit = max(n // 10, min(n, 8))
    return rows.orderBy(F.desc("callers"), F.desc("score"), "symbol", "file", "line").limit(limit)


def hub_set(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol): the top tenth of the hubs, five at least."""
    h = hubs(symbols, edges)
    n = h.count()
    return h.orderBy(F.desc("callers"), F.desc("score"), "symbol", "file", "line").limit(max(n // 10, min(n, 5))).select("symbol")


def bridges(symbols: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """(symbol, file, callers, packages): functions whose production callers live in two folders or
    more: by folders, callers and name."""
    homes = symbol_files(symbols).select(F.col("full_name").alias("caller"), folder(F.col("file")).alias("home"))
    prod = production_callers(symbols, edges).join(homes, "caller", "left")
    seen = prod.groupBy(F.col("callee").alias("symbol")).agg(F.count("*").alias("callers"), F.sort_array(F.collect_set(F.nullif("home", F.lit("")))).alias("packages"))
    s = functions(symbols).where(~test_file(F.col("file"))).select(F.col("full_name").alias("symbol"), "file", "line")
    out = s.join(seen, "symbol").where(F.size("packages") >= 2)
    return out.orderBy(F.desc(F.size("packages")), F.desc("callers"), "symbol", "file", "line").select("symbol", "file", "callers", "packages").limit(limit)


def dead_code(symbols: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(full_name, file, line, lines, public): functions outside tests that are no entry points by
    name, nothing refers to, and only tests call, if anything does. Longest first."""
    f = functions(symbols).where(~test_file(F.col("file")) & ~entry_point(F.col("full_name")))
    f = f.join(refs.select("name").distinct(), "name", "left_anti")
    live = production_callers(symbols, edges).select(F.col("callee").alias("full_name")).distinct()
    out = f.join(live, "full_name", "left_anti")
    return out.select("full_name", "file", "line", (F.col("end") - F.col("line") + 1).alias("lines"), public(F.col("name")).alias("public")).orderBy(F.desc("lines"), "full_name", "file", "line")


def delete_check(symbols: DataFrame, edges: DataFrame, refs: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) -> (name, safe, reason): the first that holds of reference, production callers,
    entry point, public, callers in tests only (safe), none (safe); unknown names are not safe."""
    known = symbols.select(F.explode(F.array("name", "full_name")).alias("key")).distinct().withColumn("known", F.lit(True))
    tests = symbol_files(symbols).where(test_file(F.col("file"))).select(F.col("full_name").alias("caller"), F.lit(True).alias("test"))
    asked = edges.join(names.select(F.col("name").alias("callee")), "callee", "left_semi").join(tests, "caller", "left")
    said = lambda of: F.array_join(F.nullif(F.sort_array(F.collect_set(F.when(of, F.col("caller")))), F.array().cast("array<string>")), ", ")
    ways = asked.groupBy(F.col("callee").alias("key")).agg(said(F.col("test").isNull()).alias("prod"), said(F.col("test")).alias("tested"))
    used = refs.where(~test_file(F.col("file"))).groupBy(F.col("name").alias("tail")).agg(F.array_join(F.sort_array(F.collect_set("file")), ", ").alias("used"))
    n = names.select("name", F.col("name").alias("key"), last_part(F.col("name")).alias("tail"))
    n = n.join(known, "key", "left").join(ways, "key", "left").join(used, "tail", "left")
    reason = (
        F.when(F.col("known").isNull(), "not found").when(F.col("used").isNotNull(), F.concat(F.lit("referenced: "), "used"))
        .when(F.col("prod").isNotNull(), F.concat(F.lit("called: "), "prod")).when(entry_point(F.col("name")), "entry point").when(public(F.col("tail")), "public")
        .when(F.col("tested").isNotNull(), F.concat(F.lit("only tests: "), "tested")).otherwise("no callers")
    )
    return n.select("name", reason.alias("reason")).withColumn("safe", F.col("reason").startswith("only tests") | (F.col("reason") == "no callers"))


def affected_files(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(file) of the symbols (full_name)."""
    return symbol_files(symbols).join(names, "full_name", "left_semi").select("file").distinct()


def coverage(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(full_name, file, covered, callers): functions outside tests, whether the functions of test
    files reach them, and their production callers."""
    tests = functions(symbols).where(test_file(F.col("file"))).select(F.col("full_name").alias("id")).distinct()
    hit = G.closure(edges, tests).select(F.col("id").alias("full_name")).withColumn("covered", F.lit(True))
    n = production_callers(symbols, edges).groupBy(F.col("callee").alias("full_name")).agg(F.count("*").alias("callers"))
    f = functions(symbols).where(~test_file(F.col("file"))).select("full_name", "file").distinct()
    return f.join(hit, "full_name", "left").join(n, "full_name", "left").select("full_name", "file", F.coalesce("covered", F.lit(False)).alias("covered"), F.coalesce("callers", F.lit(0)).alias("callers"))


def near(edges: DataFrame, root: str, depth: int = 2, most: int = 50) -> DataFrame:
    """(id, depth, parent, direction): the undirected surroundings of a symbol, nearest first; the
    parent is the least by name, and calls come before callers."""
    out = edges.select(F.col("caller").alias("a"), F.col("callee").alias("b"), F.lit("callee").alias("direction"))
    both = out.unionByName(edges.select(F.col("callee").alias("a"), F.col("caller").alias("b"), F.lit("caller").alias("direction")))
    start = edges.sparkSession.createDataFrame([(root, 0, "", "")], "id string, depth int, parent string, direction string")
    seen, front = start, start
    for k in range(1, depth + 1):
        step = front.select(F.col("id").alias("a")).join(both, "a").join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        front = G.cut(step.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "direction")).alias("m")).select("id", F.lit(k).alias("depth"), F.col("m.a").alias("parent"), F.col("m.direction").alias("direction")))
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "id").limit(most)


def explore(symbols: DataFrame, edges: DataFrame, name: str, depth: int = 2, most: int = 50) -> DataFrame:
    """(part, value): definition, callers, callees, surroundings and their files of one symbol."""
    defined = symbols.where((F.col("full_name") == name) | (F.col("name") == name)).select(F.lit("definition").alias("part"), F.concat_ws(":", "file", "line").alias("value"))
    up = edges.where(F.col("callee") == name).select(F.lit("caller").alias("part"), F.col("caller").alias("value"))
    down = edges.where(F.col("caller") == name).select(F.lit("callee").alias("part"), F.col("callee").alias("value"))
    around = near(edges, name, depth, most)
    files = affected_files(symbols, around.select(F.col("id").alias("full_name"))).select(F.lit("file").alias("part"), F.col("file").alias("value"))
    return defined.unionByName(up).unionByName(down).unionByName(around.where("depth > 0").select(F.lit("near").alias("part"), F.col("id").alias("value"))).unionByName(files).distinct()


def neighbourhood_graph(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(src, dst, confidence): a symbol's edges; EXTRACTED where the other end is one symbol,
    AMBIGUOUS where several share its name, INFERRED where none is known."""
    known = symbols.select(F.explode(F.array_distinct(F.array("name", "full_name"))).alias("key"), "file", "line").groupBy("key").agg(F.countDistinct("file", "line").alias("n"))
    mine = edges.where((F.col("caller") == name) | (F.col("callee") == name)).withColumn("key", F.when(F.col("caller") == name, F.col("callee")).otherwise(F.col("caller")))
    how = F.when(F.col("n") == 1, "EXTRACTED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("INFERRED")
    return mine.join(known, "key", "left").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), how.alias("confidence"))


def whole_graph(edges: DataFrame, limit: int = 500) -> DataFrame:
    """(caller, callee): the edges among the ``limit`` nodes of most edges, by degree and name."""
    ends = edges.select(F.col("caller").alias("id")).unionAll(edges.select("callee"))
    top = ends.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit).select("id")
    return edges.join(top.withColumnRenamed("id", "caller"), "caller", "left_semi").join(top.withColumnRenamed("id", "callee"), "callee", "left_semi").select("caller", "callee")


def flows(symbols: DataFrame, edges: DataFrame, limit: int | None = 10, depth: int = 12, said: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(root, file, depth, reached, path): functions outside tests that nothing calls and that call something, by
    the number of symbols they reach, then by the nodes of their longest path, then by name. Where names stand as
    something else of the same order, ``said`` makes them."""
    f = functions(symbols).where(~test_file(F.col("file"))).select(F.col("full_name").alias("id")).distinct()
    roots = f.join(edges.select(F.col("callee").alias("id")), "id", "left_anti").join(edges.where("caller <> callee").select(F.col("caller").alias("id")), "id", "left_semi")
    out = R.flows(edges, roots, limit, depth=depth).join(symbol_files(symbols).withColumnRenamed("full_name", "root"), "root", "left")
    out = out.orderBy(F.desc("reached"), F.desc("depth"), "root")
    return out.select(said(F.col("root")).alias("root"), "file", "depth", "reached", R.as_text(F.transform("path", said)).alias("path"))


def longest_path(edges: DataFrame, root: str, fan_out: int = 3, depth: int = 12) -> DataFrame:
    """(path, hops): the longest path from ``root``, as the flows print it."""
    start = edges.sparkSession.createDataFrame([(root,)], "id string")
    return R.longest_paths(edges, start, fan_out, depth).select(R.as_text(F.col("path")).alias("path"), (F.size("path") - 1).alias("hops"))


def trace(symbols: DataFrame, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """lines (line_no, text) of a trace -> (full_name, hits, callers, risk, tested): functions that
    its frames name, once a line, with 1 + log2(callers + 1)."""
    words = lines.select("line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][\w.]*)"), F.lit(1)))).alias("word"))
    keys = functions(symbols).select(F.explode(F.array_distinct(F.array("name", "full_name"))).alias("word"), "full_name").distinct()
    hits = words.join(keys, "word").select("line_no", "full_name").distinct().groupBy("full_name").agg(F.count("*").alias("hits"))
    cov = coverage(symbols, edges)
    out = hits.join(cov, "full_name", "left")
    return out.select("full_name", "hits", F.coalesce("callers", F.lit(0)).alias("callers"), F.round(1 + F.log2(1 + F.coalesce("callers", F.lit(0))), 6).alias("risk"), F.coalesce("covered", F.lit(False)).alias("tested"))


def why(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(full_name, file, line, doc, dependents): what a symbol's comment says and who calls it."""
    up = edges.where(F.col("callee") == name).agg(F.array_join(F.sort_array(F.collect_set("caller")), ", ").alias("dependents"))
    return symbols.where(F.col("full_name") == name).select("full_name", "file", "line", "doc").crossJoin(F.broadcast(up))  # one row


def probe(symbols: DataFrame, edges: DataFrame, task: str, anchors: int = 12) -> DataFrame:
    """(anchor, relation, symbol): the symbols that a task's identifiers name, their callers,
    callees and the tests among the callers."""
    words = sorted(set(re.findall(r"[A-Za-z_][\w.]{2,}", task)))
    asked = edges.sparkSession.createDataFrame([(w,) for w in words], "word string")
    keys = symbols.select(F.explode(F.array_distinct(F.array("name", "full_name"))).alias("word"), "full_name").distinct()
    top = keys.join(F.broadcast(asked), "word").select(F.col("full_name").alias("anchor")).distinct().orderBy("anchor").limit(anchors)
    tests = symbol_files(symbols).where(test_file(F.col("file"))).select(F.col("full_name").alias("symbol"), F.lit("test").alias("kind"))
    up = edges.join(top, edges.callee == top.anchor).select("anchor", F.col("caller").alias("symbol")).join(tests, "symbol", "left")
    down = edges.join(top, edges.caller == top.anchor).select("anchor", F.lit("callee").alias("relation"), F.col("callee").alias("symbol"))
    return up.select("anchor", F.coalesce("kind", F.lit("caller")).alias("relation"), "symbol").unionByName(down).distinct()


def communities_report(symbols: DataFrame, edges: DataFrame, labels: DataFrame, sample: int = 8) -> DataFrame:
    """(community, size, hub, packages, members): communities of two or more; named by their least
    member, the hub has most production callers, and members are a sample by name."""
    n = production_callers(symbols, edges).groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("n"))
    homes = symbol_files(symbols).select(F.col("full_name").alias("id"), folder(F.col("file")).alias("home"))
    rows = labels.join(n, "id", "left").join(homes, "id", "left")
    rank = Window.partitionBy("label").orderBy("id")
    rows = rows.withColumn("nth", F.row_number().over(rank)).withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.groupBy("label").agg(
        F.min("id").alias("community"), F.count("*").alias("size"), F.min(F.struct(-F.col("n"), "id"))["id"].alias("hub"),
        F.sort_array(F.collect_set(F.nullif("home", F.lit("")))).alias("packages"), F.sort_array(F.collect_set(F.when(F.col("nth") <= sample, F.col("id")))).alias("members"),
    )
    return out.where("size >= 2").drop("label")
