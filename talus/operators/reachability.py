"""What each node of a graph reaches, for all nodes at once, without a table of all pairs.

Edges (caller, callee) are condensed first: nodes on common cycles become one. Over what is left, which
has no cycles, each node's sketch of what it reaches is the union of those of its callees, taken bottom up.
A sketch keeps the least hashes of a set, 2^lg of them: counts up to that number are exact, larger
ones are estimates, and exact closures are made only for the few roots that need them. Longest paths
come bottom up as well, by one pass over levels; only paths that enter a cycle are
followed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.shared import cut, passing

#: Rounds after which the rows gathered so far are written again as one table.
GATHER = 8
#: Sketches keep 2^LG hashes; the standard error of larger counts is one over the root of that.
LG = 8


def gathered(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collected(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """``parts`` and one more; every few rounds they become one table, so that plans stay short."""
    parts = [*parts, new]
    return [cut(gathered(parts, new))] if len(parts) >= GATHER else parts


def inner_nodes(edges: DataFrame) -> DataFrame:
    """(id): the nodes that call and are called."""
    return cut(edges.select(F.col("callee").alias("id")).distinct().join(edges.select(F.col("caller").alias("id")), "id", "left_semi"))


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that may lie on cycles: those into nodes without a way out and out of nodes without
    a way in go, again and again."""
    edges = edges.where("caller <> callee").select("caller", "callee")
    mid = inner_nodes(edges)
    edges = cut(edges.join(mid.withColumnRenamed("id", "caller"), "caller", "left_semi").join(mid.withColumnRenamed("id", "callee"), "callee", "left_semi").select("caller", "callee").distinct())
    n = edges.count()
    while n:
        heads, tails = edges.select(F.col("caller").alias("callee")).distinct(), edges.select(F.col("callee").alias("caller")).distinct()
        edges = cut(edges.join(heads, "callee", "left_semi").join(tails, "caller", "left_semi").select("caller", "callee"))
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(id, head): the nodes that share cycles with others, with the greatest of their component. Each pass
    colours nodes by the greatest node that reaches them; a colour's own node then finds, backwards within
    the colour, its component. What is found leaves the graph."""
    rest, parts = trimmed(edges), []
    empty = rest.select(F.col("caller").alias("id"), F.col("caller").alias("head")).limit(0)
    while not rest.isEmpty():
        nodes = rest.select(F.col("caller").alias("id")).union(rest.select("callee")).distinct()
        colour = moved = cut(nodes.withColumn("head", F.col("id")))
        while True:
            sent = rest.join(moved, rest.caller == moved.id).groupBy(F.col("callee").alias("id")).agg(F.max("head").alias("new"))
            both = cut(colour.join(sent, "id", "left").select("id", F.greatest("head", "new").alias("head"), (F.col("new") > F.col("head")).alias("moved")))
            colour, moved = both.select("id", "head"), both.where("moved").select("id", "head")
            if moved.isEmpty():
                break
        a, b = colour.select(F.col("id").alias("caller"), F.col("head").alias("ha")), colour.select(F.col("id").alias("callee"), F.col("head").alias("hb"))
        inside = cut(rest.join(a, "caller").join(b, "callee").where("ha = hb").select("caller", "callee"))
        members = G.closure(inside, colour.where("id = head").select("id"), reverse=True).select("id")
        found = cut(colour.join(members, "id", "left_semi"))
        parts = collected(parts, found)
        gone = found.select("id")
        rest = trimmed(rest.join(gone.withColumnRenamed("id", "caller"), "caller", "left_anti").join(gone.withColumnRenamed("id", "callee"), "callee", "left_anti"))
    all_found = gathered(parts, empty)
    return cut(all_found.withColumn("n", F.count("*").over(Window.partitionBy("head"))).where("n > 1").drop("n"))


def condensed(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """The edges between components, which make no cycle; nodes outside ``heads`` (id, head) are their own."""
    a, b = heads.select(F.col("id").alias("caller"), F.col("head").alias("ha")), heads.select(F.col("id").alias("callee"), F.col("head").alias("hb"))
    both = edges.join(a, "caller", "left").join(b, "callee", "left")
    return cut(both.select(F.coalesce("ha", "caller").alias("caller"), F.coalesce("hb", "callee").alias("callee")).where("caller <> callee").distinct())


def sketches(edges: DataFrame, own: DataFrame, lg: int = LG) -> DataFrame:
    """(id, sketch) of all that a node reaches, itself included, from sketches of its own (id, sketch); edges
    make no cycle. A node is done once all its callees are: each round touches only callers of what the last
    round finished."""
    ways = cut(edges.groupBy(F.col("caller").alias("id")).agg(F.count("*").alias("ways")))
    front = cut(own.join(ways.select("id"), "id", "left_anti"))
    done, waiting = collected([], front), None
    while not front.isEmpty():
        sent = edges.join(front, edges.callee == front.id).select(F.col("caller").alias("id"), "sketch", F.lit(1).cast("long").alias("got"))
        if waiting is not None:
            sent = sent.unionByName(waiting)
        state = sent.groupBy("id").agg(F.theta_union_agg("sketch", lg).alias("sketch"), F.sum("got").alias("got")).join(ways, "id")
        state = cut(state)
        waiting = state.where("got < ways").drop("ways")
        ready = state.where("got = ways").select("id", F.col("sketch").alias("below"))
        front = cut(ready.join(own, "id").select("id", F.theta_union("below", "sketch", lg).alias("sketch")))
        done = collected(done, front)
    return gathered(done, own)


def reach_counts(edges: DataFrame, reverse: bool = False, lg: int = LG, heads: DataFrame | None = None) -> DataFrame:
    """(id, reached, exact) of every node: how many other nodes it reaches (or, reversed, is reached
    from); exact up to 2^lg, beyond that an estimate. Edges are distinct, and a table that is read several times;
    ``heads`` are their ``cycles``, where known."""
    if reverse:
        edges = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    edges = edges.where("caller <> callee").select("caller", "callee")
    heads = cycles(edges) if heads is None else heads
    if heads.isEmpty():
        return counts_without_cycles(edges, lg)
    nodes = edges.select(F.col("caller").alias("id")).union(edges.select("callee")).distinct()
    named = cut(nodes.join(heads, "id", "left").select("id", F.coalesce("head", "id").alias("head")))
    own = cut(named.groupBy(F.col("head").alias("id")).agg(F.theta_sketch_agg("id", lg).alias("sketch")))
    n = sketches(condensed(edges, heads), own, lg).select(F.col("id").alias("head"), F.theta_sketch_estimate("sketch").alias("n"))
    return named.join(n, "head").select("id", (F.col("n") - 1).alias("reached"), (F.col("n") <= 2**lg).alias("exact"))


def counts_without_cycles(edges: DataFrame, lg: int) -> DataFrame:
    """``reach_counts`` of a graph without cycles. Only nodes that call and are called need sketches. What calls
    none of them reaches its callees and no more. Of the rest, nodes whose callees reach few nodes in all
    are counted exactly by (node, reached) pairs, at most 2^lg each, and the others by sketches."""
    most, kind = 2**lg, edges.schema["caller"].dataType.simpleString()
    mid = inner_nodes(edges)
    inner = cut(edges.join(mid.withColumnRenamed("id", "callee"), "callee", "left_semi").select("caller", "callee"))
    of_mid = lambda df, c: df.join(mid.withColumnRenamed("id", c), c, "left_semi")
    own = of_mid(edges, "caller").select(F.col("caller").alias("id"), F.col("callee").alias("x")).unionByName(mid.withColumn("x", F.col("id")))
    own = cut(own.groupBy("id").agg(F.theta_sketch_agg("x", lg).alias("sketch")))
    below = cut(sketches(cut(of_mid(inner, "caller").select("caller", "callee")), own, lg).withColumn("n", F.theta_sketch_estimate("sketch")))
    ways = edges.groupBy(F.col("caller").alias("id")).agg(F.count("*").alias("ways"))
    sums = inner.join(below.select(F.col("id").alias("callee"), "n"), "callee").groupBy(F.col("caller").alias("id")).agg(F.sum("n").alias("under"))
    tops = cut(ways.join(mid, "id", "left_anti").join(sums, "id", "left"))
    zero = edges.select(F.col("callee").alias("id")).distinct().join(edges.select(F.col("caller").alias("id")), "id", "left_anti").select("id", F.lit(0).cast("long").alias("reached"), F.lit(True).alias("exact"))
    flat = tops.where("under is null").select("id", F.col("ways").alias("reached"), F.lit(True).alias("exact"))
    inside = below.select("id", (F.col("n") - 1).alias("reached"), (F.col("n") <= most).alias("exact"))
    small, large = tops.where(F.col("ways") + F.col("under") <= most).select("id"), tops.where(F.col("ways") + F.col("under") > most).select("id")
    pairs = G.reach(edges, below.where(F.col("n") <= most).select("id")).where("dist > 0").select(F.col("root").alias("callee"), F.col("id").alias("x"))
    own_of = lambda df, ids: df.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi")
    # Callees are counted as they are; what callees reach is one list a callee, and only callees that are reached as well may be in both.
    far = own_of(inner, small).join(pairs.groupBy("callee").agg(F.collect_list("x").alias("far")), "callee").select(F.col("caller").alias("id"), "far", F.expr("array()").cast(f"array<{kind}>").alias("near"))
    twice = edges.join(pairs.select(F.col("x").alias("callee")).distinct(), "callee", "left_semi")
    near = own_of(twice, small).select(F.col("caller").alias("id"), F.expr("array()").cast(f"array<{kind}>").alias("far"), F.array("callee").alias("near"))
    lists = far.unionByName(near).groupBy("id").agg(F.flatten(F.collect_list("far")).alias("far"), F.flatten(F.collect_list("near")).alias("near"))
    exact = tops.join(lists, "id").select("id", (F.col("ways") + F.size(F.array_except("far", "near"))).alias("reached"), F.lit(True).alias("exact"))
    sent = own_of(inner, large).join(below.select(F.col("id").alias("callee"), "sketch"), "callee").groupBy(F.col("caller").alias("id")).agg(F.theta_union_agg("sketch", lg).alias("a"))
    direct = own_of(edges, large).groupBy(F.col("caller").alias("id")).agg(F.theta_sketch_agg("callee", lg).alias("b"))
    n = F.theta_sketch_estimate(F.theta_union("a", "b", lg))
    wide = sent.join(direct, "id").select("id", n.alias("reached"), (n < most).alias("exact"))
    return zero.unionByName(flat).unionByName(inside).unionByName(exact).unionByName(wide)


def criticality_of_all(edges: DataFrame, lg: int = LG) -> DataFrame:
    """(id, dependents, level) of every node, by all that depends on it, directly or not. Levels are exact, and
    dependents are counted up to 2^lg, which stands for more: `graph.criticality` has those of nodes asked for."""
    n = reach_counts(edges, reverse=True, lg=lg)
    return n.select("id", F.least(F.col("reached"), F.lit(2**lg)).alias("dependents"), G.level(F.col("reached")).alias("level"))


def widest(edges: DataFrame, roots: DataFrame, limit: int | None, lg: int = LG, heads: DataFrame | None = None) -> DataFrame:
    """(id, reached): the ``limit`` roots (id) that reach most, or all, with exact counts. Sketches rank
    them; roots whose estimate may belong to the top, by four standard errors, are counted by closures of
    their own, and so are no others."""
    with passing() as keep:
        n = keep(cut(reach_counts(edges, lg=lg, heads=heads).join(roots.select("id").distinct(), "id", "left_semi")))
    if limit is not None:
        low, high = 1 - 4 / 2 ** (lg / 2), 1 + 4 / 2 ** (lg / 2)
        n = n.withColumn("least", F.when(F.col("exact"), F.col("reached")).otherwise(F.col("reached") * low)).withColumn("most", F.when(F.col("exact"), F.col("reached")).otherwise(F.col("reached") * high))
        bar = n.orderBy(F.desc("least")).limit(limit).agg(F.min("least").alias("bar"))
        n = cut(n.join(F.broadcast(bar), F.col("most") >= F.col("bar")))  # one row
    rest = n.where("not exact").select("id")
    sure = n.where("exact").select("id", "reached")
    if not rest.isEmpty():
        sure = sure.unionByName(G.reach(edges, rest).where("dist > 0").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("reached")))
    return sure


def ranked_callees(edges: DataFrame, fan: int) -> DataFrame:
    """(caller, callee): the first ``fan`` callees of each node by name; edges are distinct."""
    nth = F.row_number().over(Window.partitionBy("caller").orderBy("callee"))
    return edges.select("caller", "callee").withColumn("nth", nth).where(F.col("nth") <= fan).drop("nth")


def heights(few: DataFrame, depth: int) -> DataFrame:
    """(id, height): the nodes on the longest path from a node along ``few``, ``depth`` at most; for nodes that
    reach no cycle. The callers of what has a path of k nodes have one of k + 1."""
    front = cut(few.select(F.col("callee").alias("id")).distinct())
    parts, k = [], 1
    while k < depth and not front.isEmpty():
        k += 1
        front = cut(few.join(front, few.callee == front.id, "left_semi").select(F.col("caller").alias("id")).distinct())
        parts = collected(parts, front.withColumn("height", F.lit(k)))
    return cut(gathered(parts, front.withColumn("height", F.lit(1))).groupBy("id").agg(F.max("height").alias("height")))


def descended(starts: DataFrame, ways: DataFrame) -> DataFrame:
    """(root, path): paths so far (root, id, path, want), a table, each led on to ``want`` more nodes: at each step to the
    first callee by name from which a path of the length still wanted leads down, by ``ways`` (caller, callee, height), a
    table. How a path goes on depends on where it stands and what it wants, so that is found once for all paths that meet."""
    steps, state = [], starts.where("want > 0").select("id", "want").distinct()
    while True:
        step = state.join(ways, (state.id == ways.caller) & (ways.height >= state.want)).groupBy("id", "want").agg(F.min("callee").alias("callee"))
        steps.append(cut(step))
        state = steps[-1].where("want > 1").select(F.col("callee").alias("id"), (F.col("want") - 1).alias("want")).distinct()
        if state.isEmpty():
            break
    tails = None
    for step in reversed(steps):
        if tails is None:
            tails = step.select("id", "want", F.array("callee").alias("tail"))
            continue
        below = tails.select(F.col("id").alias("callee"), (F.col("want") + 1).alias("want"), "tail")
        tails = step.join(below, ["callee", "want"], "left").select("id", "want", F.when(F.col("tail").isNull(), F.array("callee")).otherwise(F.concat(F.array("callee"), "tail")).alias("tail"))
    return starts.join(tails, ["id", "want"], "left").select("root", F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", "tail")).alias("path"))


def longest_paths(edges: DataFrame, roots: DataFrame, fan: int = 3, depth: int = 12, heads: DataFrame | None = None) -> DataFrame:
    """(root, path): of each root (id) the longest path without repeated nodes that follows the first
    ``fan`` callees by name which are not on it, ``depth`` nodes at most; the first in order of names
    among the longest. Where a path has left all cycles, its longest continuation is known by levels; before that
    it is followed node by node, for the roots asked for only."""
    with passing() as keep:
        best, ways = map(keep, ends_of_paths(edges, roots, fan, depth, heads))
    return descended(best, ways)


def ends_of_paths(edges: DataFrame, roots: DataFrame, fan: int, depth: int, heads: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of each root the best path as far as it is followed node by node, with what it still wants (root, id, path, want), and
    the ways on from there (caller, callee, height); both are tables."""
    if heads is None:
        edges = cut(edges.where("caller <> callee").select("caller", "callee").distinct())
        heads = cycles(edges)
    edges, knot = edges.where("caller <> callee").select("caller", "callee"), heads.select("id")
    free = knot.isEmpty()
    bound = knot if free else cut(G.closure(edges, knot, reverse=True).select("id"))
    few = cut(ranked_callees(edges if free else edges.join(bound.withColumnRenamed("id", "caller"), "caller", "left_anti"), fan))
    tall = heights(few, depth)
    height = F.coalesce("height", F.lit(1))
    kind = edges.schema["caller"].dataType.simpleString()
    start = cut(roots.select(F.col("id").alias("root"), "id", F.array("id").alias("path")).distinct())
    free = start.join(bound, "id", "left_anti").join(tall, "id", "left").select("root", "id", "path", (height - 1).alias("want"))
    front = cut(start.join(bound, "id", "left_semi"))
    parts = [cut(free)]
    while not front.isEmpty():
        step = front.join(edges, front.id == edges.caller, "left").select("root", "path", F.when(~F.array_contains("path", F.col("callee")), F.col("callee")).alias("callee"))
        nth = F.row_number().over(Window.partitionBy("root", "path").orderBy(F.col("callee").asc_nulls_last()))
        step = cut(step.withColumn("nth", nth).where((F.col("nth") <= fan) & (F.col("callee").isNotNull() | (F.col("nth") == 1))))
        longer = step.where("callee is not null").select("root", F.col("callee").alias("id"), F.concat("path", F.array("callee")).alias("path"))
        full = longer.where(F.size("path") >= depth)
        parts = collected(parts, cut(step.where("callee is null").select("root", F.element_at("path", -1).alias("id"), "path", F.lit(0).alias("want")).unionByName(full.select("root", "id", "path", F.lit(0).alias("want")))))
        longer = cut(longer.where(F.size("path") < depth))
        out = longer.join(bound, "id", "left_anti").join(tall, "id", "left")
        parts = collected(parts, cut(out.select("root", "id", "path", F.least(height - 1, F.lit(depth) - F.size("path")).alias("want"))))
        front = cut(longer.join(bound, "id", "left_semi"))
    ends = gathered(parts, free).groupBy("root").agg(F.min(F.struct((-F.size("path") - F.col("want")).alias("n"), "path", "id", "want")).alias("m"))
    best = ends.select(F.col("root").cast(kind).alias("root"), "m.id", "m.path", "m.want")
    ways = few.join(tall.withColumnRenamed("id", "callee"), "callee", "left").select("caller", "callee", F.coalesce("height", F.lit(1)).alias("height"))
    return cut(best), cut(ways)


def flows(edges: DataFrame, roots: DataFrame, limit: int | None = None, fan: int = 3, depth: int = 12, lg: int = LG) -> DataFrame:
    """(root, depth, reached, path): of the roots (id) that reach anything the ``limit`` that reach most, then with
    the longest path, then by name, or all of them: nodes on the longest path, nodes reached, and that path. Edges are
    distinct, and a table that is read several times."""
    edges = edges.where("caller <> callee").select("caller", "callee")
    with passing() as keep:
        heads = keep(cycles(edges))
    with passing() as keep:
        n = keep(cut(widest(edges, roots, limit, lg, heads).where("reached > 0")))
        if limit is not None:  # roots tied with the last by what they reach may have the longer path
            bar = n.orderBy(F.desc("reached")).limit(limit).agg(F.min("reached").alias("bar"))
            n = keep(cut(n.join(F.broadcast(bar), F.col("reached") >= F.col("bar")).drop("bar")))  # one row
    out = longest_paths(edges, n.select("id"), fan, depth, heads).join(n.withColumnRenamed("id", "root"), "root")
    out = out.select("root", F.size("path").alias("depth"), "reached", "path")
    return out if limit is None else out.orderBy(F.desc("reached"), F.desc("depth"), "root").limit(limit)


def as_text(path: Column) -> Column:
    return F.array_join(path, ">")
