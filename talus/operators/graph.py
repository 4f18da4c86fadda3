"""Graph operators over an edge table (caller, callee) and node tables (id, ...). Ids may be of any type."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.shared import cut

#: Sequential label propagation is defined up to this many nodes.
GATE = 50_000
#: Files of a commit that meet in one cell when pairs are counted.
TILE = 2_000
#: Pairs of files that one task counts, about.
PAIRS = 1 << 20
#: Rounds after which what a closure has seen is written again as one table.
GATHER = 8


def count_of(edges: DataFrame, by: str, name: str) -> DataFrame:
    """(id, name): the number of edges by one end; edges are distinct."""
    return edges.groupBy(F.col(by).alias("id")).agg(F.count("*").alias(name))


def outside(edges: DataFrame, tests: DataFrame | None) -> DataFrame:
    """The edges whose caller is no test (id)."""
    return edges if tests is None else edges.join(tests.select(F.col("id").alias("caller")), "caller", "left_anti")


def hub_rows(edges: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(id, callers, calls, score) of every node outside tests that has an edge: production callers,
    calls, and 2 * callers + calls."""
    both = count_of(outside(edges, tests), "callee", "callers").join(count_of(edges, "caller", "calls"), "id", "full")
    if tests is not None:
        both = both.join(tests, "id", "left_anti")
    both = both.select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("calls", F.lit(0)).alias("calls"))
    return both.where("callers > 0 or calls > 0").withColumn("score", 2 * F.col("callers") + F.col("calls"))


def hubs(rows: DataFrame, limit: int = 0) -> DataFrame:
    """Of hub rows (symbol, callers, calls, score) the first by callers, score and symbol: ``limit``, or
    the top tenth, eight at least."""
    if limit <= 0:
        n = rows.count()
        limit = max(n // 10, min(n, 8))
    return rows.orderBy(F.desc("callers"), F.desc("score"), "symbol").limit(limit)


def bridge_rows(edges: DataFrame, homes: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(id, dirs, callers) of nodes whose production callers live in two directories or more."""
    near = outside(edges, tests).join(homes.select(F.col("id").alias("caller"), "dir"), "caller", "left")
    per = near.groupBy("callee", "dir").agg(F.count("*").alias("n"))  # few directories a node
    seen = per.groupBy(F.col("callee").alias("id")).agg(F.count("dir").alias("dirs"), F.sum("n").alias("callers"))
    if tests is not None:
        seen = seen.join(tests, "id", "left_anti")
    return seen.where("dirs >= 2")


def bridges(rows: DataFrame, limit: int = 15) -> DataFrame:
    """The first of bridge rows (symbol, dirs, callers) by directories, callers and symbol."""
    return rows.orderBy(F.desc("dirs"), F.desc("callers"), "symbol").limit(limit)


def dead(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Nodes, tests aside, that no caller outside tests reaches."""
    live = outside(edges, tests).select(F.col("callee").alias("id")).distinct()
    return nodes.join(tests, "id", "left_anti").join(live, "id", "left_anti")


def directed(edges: DataFrame, reverse: bool) -> DataFrame:
    a, b = ("callee", "caller") if reverse else ("caller", "callee")
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))


def closure(edges: DataFrame, roots: DataFrame, reverse: bool = False, depth: int | None = None) -> DataFrame:
    """(id, dist): nodes reachable from roots (id) with their distance, roots at 0; to the end, or
    to ``depth`` hops. One join a step, whose lineage is cut; edges are read at each step, so they should be a table."""
    step = directed(edges, reverse)
    seen = front = cut(roots.select("id").distinct().withColumn("dist", F.lit(0)))
    k = 0
    while depth is None or k < depth:
        k += 1
        new = front.join(step, front.id == step.src).select(F.col("dst").alias("id")).distinct()
        front = cut(new.join(seen.select("id"), "id", "left_anti").withColumn("dist", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front) if k % GATHER else cut(seen.unionByName(front))
    return seen


def reach(edges: DataFrame, roots: DataFrame, reverse: bool = False) -> DataFrame:
    """(root, id, dist): the closure of each root on its own; roots (id), or (root, id) where a root
    starts at several nodes. Grows with the roots asked for; edges are read at each step, so they should be a table."""
    step = directed(edges, reverse)
    start = roots if "root" in roots.columns else roots.withColumn("root", F.col("id"))
    seen = front = cut(start.select("root", "id").distinct().withColumn("dist", F.lit(0)))
    k = 0
    while True:
        k += 1
        new = front.join(step, front.id == step.src).select("root", F.col("dst").alias("id")).distinct()
        front = cut(new.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("dist", F.lit(k)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front) if k % GATHER else cut(seen.unionByName(front))


def level(callers: Column) -> Column:
    """Critical over 20, high from 10, medium from 3, else low."""
    return F.when(callers > 20, "critical").when(callers >= 10, "high").when(callers >= 3, "medium").otherwise("low")


def criticality(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, dependents, level) of the asked nodes (id) by all that depends on them, directly or not."""
    n = reach(edges, roots, reverse=True).groupBy(F.col("root").alias("id")).agg((F.count("*") - 1).alias("dependents"))
    return n.withColumn("level", level(F.col("dependents")))


def coverage(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """dir, total, covered, percent: nodes that tests reach, by directory."""
    reached = closure(edges, tests).where("dist > 0").select("id").withColumn("hit", F.lit(1))
    rest = nodes.join(tests, "id", "left_anti").join(reached, "id", "left")
    out = rest.groupBy("dir").agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
    return out.withColumn("percent", F.round(100.0 * F.col("covered") / F.col("total"), 4))


def coupling(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(left, right, edges, sample) of edges between groups (id, grp), bundled by unordered pair;
    the sample is the first edge by text."""
    a, b = groups.select(F.col("id").alias("caller"), F.col("grp").alias("ga")), groups.select(F.col("id").alias("callee"), F.col("grp").alias("gb"))
    cross = edges.join(a, "caller").join(b, "callee").where("ga <> gb")
    return cross.groupBy(F.least("ga", "gb").alias("left"), F.greatest("ga", "gb").alias("right")).agg(F.count("*").alias("edges"), F.min(F.concat_ws(">", "caller", "callee")).alias("sample"))


def cochange(commits: DataFrame, least: int = 2, top: int = 3, tile: int = TILE) -> DataFrame:
    """file, partner, n, rank: files that change in the same commits most often. A pair is made and counted once, for
    both its files. A commit of more than ``tile`` files is cut into tiles of files, and each pair of tiles is a cell of
    its own, so no commit is one task. Cells, and then pairs, are dealt to as many tasks as their number asks for:
    what one counts in memory does not grow with the table."""
    whole = commits.select("commit", "file").where("commit is not null and file is not null")
    c = cut(whole.repartition(max(1, -(-whole.count() // PAIRS)), "commit", "file").distinct())
    sizes = c.groupBy("commit").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // PAIRS))
    wide = sizes.where(F.col("n") > tile).select("commit", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    c = cut(c.join(wide, "commit", "left").select("commit", "file", tiles.alias("tiles"), F.pmod(F.xxhash64("file"), tiles).cast("int").alias("mine")))
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cell = ["commit", "row", "col"]
    left = c.select("commit", "file", F.col("mine").alias("row"), others.alias("col")).repartition(parts, *cell)
    right = c.select("commit", F.col("file").alias("partner"), others.alias("row"), F.col("mine").alias("col")).repartition(parts, *cell)
    pairs = left.join(right.hint("merge"), cell).where("file < partner").select("file", "partner")
    n = cut(pairs.repartition(parts, "file", "partner").groupBy("file", "partner").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    n = n.unionByName(n.select(F.col("partner").alias("file"), F.col("file").alias("partner"), "n"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "partner"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def churn(commits: DataFrame) -> DataFrame:
    """file, commits: distinct commits a file."""
    return commits.groupBy("file").agg(F.countDistinct("commit").alias("commits"))


def change_risk(changes: DataFrame, edges: DataFrame, homes: DataFrame, tests: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """(file, symbols, callers, blast, gaps, packages, risk) of changed symbols (file, id):
    1 + log2(1 + production callers) + log2(1 + what else depends on them) + 1 for each hub among
    them + 0.5 for each that calls a hub + 1.5 if callers live in several directories
    + 2 if tests reach not all of them. Each file has its own closure."""
    changed = cut(changes.select("file", "id").distinct())
    callers = changed.join(outside(edges, tests), F.col("id") == F.col("callee")).select("file", F.col("caller").alias("id")).distinct()
    blast = reach(edges, changed.withColumnRenamed("file", "root"), reverse=True).select(F.col("root").alias("file"), "id")
    rest = blast.join(callers, ["file", "id"], "left_anti").join(changed, ["file", "id"], "left_anti")
    near = changed.join(edges, F.col("id") == F.col("callee")).select("file", F.col("caller").alias("id")).join(homes, "id").select("file", "dir").where("dir <> ''").distinct()
    covered = closure(edges, tests).select("id").withColumn("covered", F.lit(1))
    hub = hub_ids.select("id").distinct().withColumn("hub", F.lit(1))
    loud = edges.join(hub_ids.select(F.col("id").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("id")).distinct().withColumn("loud", F.lit(1))
    each = changed.join(covered, "id", "left").join(hub, "id", "left").join(loud, "id", "left").groupBy("file")
    each = each.agg(F.count("*").alias("symbols"), (F.count("*") - F.count("covered")).alias("gaps"), F.count("hub").alias("hubs"), F.count("loud").alias("loud"))
    n = lambda d, name: d.groupBy("file").agg(F.count("*").alias(name))
    out = each.join(n(callers, "callers"), "file", "left").join(n(rest, "rest"), "file", "left").join(n(near, "packages"), "file", "left").fillna(0, ["callers", "rest", "packages"])
    risk = 1 + F.log2(1 + F.col("callers")) + F.log2(1 + F.col("rest")) + F.col("hubs") + 0.5 * F.col("loud") + F.when(F.col("packages") > 1, 1.5).otherwise(0.0) + F.when(F.col("gaps") > 0, 2.0).otherwise(0.0)
    return out.select("file", "symbols", "callers", (F.col("callers") + F.col("rest")).alias("blast"), "gaps", "packages", F.round(risk, 1).alias("risk"))


def boundary_violations(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """src_dir, dst_dir, n, rule of edges that a forbid rule meets and no allow rule lifts; rules
    (ord, src, dst, action) match a directory exactly, as '*', as 'prefix/' or as '/suffix'. Edges are
    counted by pair of directories first, so rules meet few rows."""
    a, b = nodes.select(F.col("id").alias("caller"), F.col("dir").alias("src_dir")), nodes.select(F.col("id").alias("callee"), F.col("dir").alias("dst_dir"))
    n = edges.join(a, "caller").join(b, "callee").groupBy("src_dir", "dst_dir").agg(F.count("*").alias("n"))
    hit = n.join(rules, rule_meets("src", "src_dir") & rule_meets("dst", "dst_dir"))
    per = hit.groupBy("src_dir", "dst_dir", "n").agg(F.min(F.when(F.col("action") == "forbid", F.col("ord"))).alias("rule"), F.max((F.col("action") == "allow").cast("int")).alias("lifted"))
    return per.where("rule is not null and lifted = 0 and src_dir <> dst_dir").drop("lifted")


def rule_meets(rule: str, folder: str) -> Column:
    r, d = F.col(rule), F.col(folder)
    return (r == "*") | (r == d) | (r.endswith("/") & F.concat(d, F.lit("/")).startswith(r)) | (r.startswith("/") & F.concat(F.lit("/"), d).endswith(r))


def import_violations(imports: DataFrame, dirs: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, dir, rule): imports (file, target) of directories (dir) that a forbid rule meets and no
    allow rule lifts. An import meets a directory by suffix or by the last part of its path."""
    home = F.regexp_replace("file", "/?[^/]*$", "")
    last = lambda c: F.element_at(F.split(c, "[/.]"), -1)
    keyed = imports.select("file", home.alias("src_dir"), "target", last("target").alias("tail"))
    to = dirs.select("dir", last("dir").alias("tail"))
    meets = (F.concat(F.lit("/"), "target").endswith(F.concat(F.lit("/"), F.col("dir")))) | (F.col("target") == F.col("tail"))
    met = keyed.join(to, "tail").where(meets & (F.col("src_dir") != F.col("dir"))).select("file", "src_dir", F.col("dir").alias("dst_dir")).distinct()
    hit = met.join(rules, rule_meets("src", "src_dir") & rule_meets("dst", "dst_dir"))
    per = hit.groupBy("file", "dst_dir").agg(F.min(F.when(F.col("action") == "forbid", F.col("ord"))).alias("rule"), F.max((F.col("action") == "allow").cast("int")).alias("lifted"))
    return per.where("rule is not null and lifted = 0").select("file", F.col("dst_dir").alias("dir"), "rule")


def boundary_check(by_symbol: DataFrame, by_import: DataFrame) -> DataFrame:
    """(file, dir, rule, evidence): violations of calls (file, dir, rule, symbol) and of imports
    (file, dir, rule), one a file and directory; a symbol is better evidence than an import."""
    both = by_symbol.select("file", "dir", "rule", "symbol").unionByName(by_import.select("file", "dir", "rule", F.lit(None).cast("string").alias("symbol")))
    best = both.groupBy("file", "dir").agg(F.min(F.struct(F.col("symbol").isNull().alias("imported"), "symbol", "rule")).alias("b"))
    return best.select("file", "dir", F.col("b.rule").alias("rule"), F.coalesce("b.symbol", F.lit("import")).alias("evidence"))


def layers_of(dirs: DataFrame, layers: DataFrame) -> DataFrame:
    """(dir, layer): the first layer (ord, layer, pattern) that a directory meets."""
    hit = dirs.join(layers, rule_meets("pattern", "dir"))
    return hit.groupBy("dir").agg(F.min(F.struct("ord", "layer"))["layer"].alias("layer"))


def layer_violations(edges: DataFrame, nodes: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(src_layer, dst_layer, n, sample) of edges between layers (ord, layer, pattern) that are not in
    allowed (src_layer, dst_layer); edges inside a layer or outside all are free."""
    dirs = nodes.select("id", "dir").join(layers_of(nodes.select("dir").distinct(), layers), "dir")
    a, b = dirs.select(F.col("id").alias("caller"), F.col("layer").alias("src_layer")), dirs.select(F.col("id").alias("callee"), F.col("layer").alias("dst_layer"))
    n = edges.join(a, "caller").join(b, "callee").where("src_layer <> dst_layer").groupBy("src_layer", "dst_layer")
    n = n.agg(F.count("*").alias("n"), F.min(F.concat_ws(">", "caller", "callee")).alias("sample"))
    return n.join(allowed, ["src_layer", "dst_layer"], "left_anti")


def owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, owner: of the matching rules (pattern, owner, ord) the most specific,
    '*' 1, '*.ext' 2, 'dir/' 3 + depth, an exact path 100; ties to the earlier rule. Rules meet paths by
    keys: the path, its extension, each of its folders, or '*'; so no rule meets all paths but '*'."""
    folders = F.transform(F.filter(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda k: k > 0), lambda k: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/")))
    ends = F.transform(F.filter(F.sequence(F.lit(0), F.size(F.split("path", r"\.")) - 1), lambda k: k > 0), lambda k: F.concat(F.lit("*."), F.call_function("substring_index", F.col("path"), F.lit("."), -k)))
    keys = paths.select("path", F.explode(F.array_distinct(F.concat(F.array("path", F.lit("*")), folders, ends))).alias("pattern"))
    score = F.when(F.col("pattern") == "*", 1).when(F.col("pattern").startswith("*."), 2).when(F.col("pattern").endswith("/"), 2 + F.size(F.split("pattern", "/"))).otherwise(100)
    hit = keys.join(rules, "pattern").groupBy("path").agg(F.min(F.struct((-score).alias("s"), "ord", "owner"))["owner"].alias("owner"))
    return hit


def teams(rules: DataFrame) -> DataFrame:
    """(team): the distinct owners of rules (pattern, owner, ord)."""
    return rules.select(F.explode(F.split("owner", " +")).alias("team")).distinct().orderBy("team")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, removed or modified by hash."""
    both = old.withColumnRenamed("hash", "h0").join(new.withColumnRenamed("hash", "h1"), "path", "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def stale(old: DataFrame, new: DataFrame) -> bool:
    """Whether files (path, hash, mtime) changed: first by number and latest time, which cost one
    aggregate, and only where those differ by hashes."""
    gate = lambda d: tuple(d.agg(F.count("*"), F.max("mtime")).first())
    return gate(old) != gate(new) and not manifest_diff(old.select("path", "hash"), new.select("path", "hash")).isEmpty()


def overlapping(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols (file, line, end) that a changed range (file, lo, hi) overlaps; a range without
    bounds is the whole file, an end of 0 the symbol's line."""
    r = ranges.select(F.col("file").alias("_f"), "lo", "hi")
    end = F.when(F.col("end") == 0, F.col("line")).otherwise(F.col("end"))
    whole = F.col("lo").isNull() & F.col("hi").isNull()
    return symbols.join(r, (F.col("file") == F.col("_f")) & (whole | ((F.col("line") <= F.col("hi")) & (end >= F.col("lo")))), "left_semi")


def shortest_path(edges: DataFrame, start, goal, depth: int | None = None) -> DataFrame:
    """One row (path, hops): the least path by length, then by its nodes, over undirected edges; none
    where the nodes are not connected (or not within ``depth`` hops, if given)."""
    from talus.operators.paths import paths_between

    kind = edges.schema["caller"].dataType.simpleString()
    pair = edges.sparkSession.createDataFrame([(0, start, goal)], f"pair int, start {kind}, goal {kind}")
    return paths_between(edges, pair, depth).select("path", "hops")


def label_propagation(edges: DataFrame, rounds: int = 30, gate: int = GATE) -> DataFrame:
    """(id, label). Up to ``gate`` nodes labels move one node at a time, in sorted order, which one task
    does: this is the defined result. Beyond it all nodes move at once in each round, distributed:
    a node takes the most frequent label among its neighbours and itself, ties to the least."""
    pairs = edges.where("caller <> callee").select("caller", "callee").distinct()
    both = directed(pairs, False).unionByName(directed(pairs, True)).distinct()
    if both.select("src").distinct().limit(gate + 1).count() > gate:
        return spread_labels(cut(both), rounds)
    kind = both.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict = {}
        for rows in batches:
            for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
                near.setdefault(a, set()).add(b)
        label = {n: n for n in near}
        for _ in range(rounds):
            moved = False
            for n in sorted(near):
                votes: dict = {}
                for m in near[n]:
                    votes[label[m]] = votes.get(label[m], 0) + 1
                best = min(votes, key=lambda k: (-votes[k], k))
                moved |= best != label[n]
                label[n] = best
            if not moved:
                break
        yield pd.DataFrame({"id": list(label), "label": list(label.values())})

    return both.repartition(1).mapInPandas(run, f"id {kind}, label {kind}")  # at most the gate's nodes


def spread_labels(both: DataFrame, rounds: int) -> DataFrame:
    """(id, label) by rounds over all nodes at once, from both directions of the edges (src, dst)."""
    now = cut(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        heard = both.join(now.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label").unionByName(now)
        votes = heard.groupBy("id", "label").agg(F.count("*").alias("n"))
        new = cut(votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label")))
        if new.join(now, ["id", "label"], "left_anti").isEmpty():
            return new
        now = new
    return now


def union_edges(*parts: DataFrame) -> DataFrame:
    """Distinct union of edge tables; equal edges meet by caller, so that a caller's edges lie together."""
    return reduce(lambda a, b: a.unionByName(b), parts).repartition("caller").distinct()
