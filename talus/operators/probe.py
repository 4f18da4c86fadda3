"""The probe: what a task in plain words touches in a project, in a budget of tokens.

Identifiers of the task name the anchors, or else keywords that parts of names hold. Spark finds
anchors, their neighbours and the paths between consecutive anchors over the whole index; what is left, at
most twelve anchors with bounded lists, is cut to the budget as one small report.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.text import identifier_segments
from talus.operators import symbols as S
from talus.operators.paths import paths_between
from talus.shared import cut

ANCHORS, LISTED, PATHS, FUZZY, BUDGET = 12, 12, 5, 5, 4000
# Words of a task that name nothing.
STOP = frozenset("""the a an is are was were be been being have has had do does did will would could should may might must shall can need
of in on at to for with by from as into about than then so if but or and not no this that these those it its their there here where when how why what which who whom whose
i you he she we they me him her us them my your his our fix bug issue problem error task todo feature change add remove update create delete get set new old""".split())


def keywords(task: str) -> list[str]:
    """The words of a task, lower-cased, three letters at least, without common ones, each once."""
    bare = [w.strip(".,;:!?\"'()[]{}<>") for w in task.lower().split()]
    return list(dict.fromkeys(w for w in bare if len(w) >= 3 and w not in STOP))


def anchors(symbols: DataFrame, task: str, most: int = ANCHORS) -> DataFrame:
    """(anchor): the symbols that identifiers of the task name in full or by their last part, the first by
    name; if none, those whose names hold a keyword, the first few of each."""
    spark = symbols.sparkSession
    said = sorted(set(re.findall(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", task)))
    asked = spark.createDataFrame([(w,) for w in said], "word string")
    keys = symbols.select(F.explode(F.array_distinct(F.array("name", "full_name"))).alias("word"), F.col("full_name").alias("anchor")).distinct()
    exact = cut(keys.join(F.broadcast(asked), "word").select("anchor").distinct())  # the words of the task
    if exact.isEmpty():
        wanted = spark.createDataFrame([(k, w) for k, w in enumerate(keywords(task))], "nth int, word string")
        names = symbols.select(F.col("full_name").alias("anchor")).distinct()
        holds = F.lower(F.col("anchor")).contains(F.col("word")) | F.exists(identifier_segments(F.col("anchor")), lambda s: s.contains(F.col("word")))
        rank = F.row_number().over(Window.partitionBy("nth").orderBy("anchor"))
        exact = names.join(F.broadcast(wanted), holds).withColumn("rank", rank).where(F.col("rank") <= FUZZY).select("anchor").distinct()
    return exact.orderBy("anchor").limit(most)


def estimate(text: str) -> int:
    """The token estimate of one small text, as ``functions.text.token_estimate`` has it for columns."""
    fields = text.split()
    return 0 if not text else max(1, int((sum(len(f.encode()) for f in fields) + len(fields)) * 0.25))


def rendered(task: str, found: list[dict], paths: list[list[str]]) -> str:
    out = [f"probe: {task}", ""]
    if not found:
        return "\n".join([*out, "  (no symbol of the task is in the index: try to name a function or type)"])
    out.append(f"anchors: {len(found)}")
    for a in found:
        out += ["", f"{a['name']}  ({a['kind']})  {a['file']}:{a['line']}"]
        out += [f"  {label}: {', '.join(a[part])}" for label, part in (("callers", "callers"), ("callees", "callees"), ("tests  ", "tests")) if a[part]]
    if paths:
        out += ["", "connecting paths:", *(f"  {' → '.join(p)}" for p in paths)]
    return "\n".join(out)


def fitted(task: str, found: list[dict], paths: list[list[str]], budget: int) -> tuple[str, int, bool]:
    """(text, tokens, truncated): while the report is over the budget, the longest list is halved, then
    the last anchor goes, the first one never."""
    text = rendered(task, found, paths)
    cut_short = estimate(text) > budget and bool(found)
    while found and estimate(text) > budget:
        long = [(len(a[part]), -k, part) for k, a in enumerate(found) for part in ("tests", "callees", "callers") if len(a[part]) > 1]
        if long:
            n, k, part = max(long, key=lambda x: (x[0], x[1], ("tests", "callees", "callers").index(x[2])))
            found[-k][part] = found[-k][part][: (n + 1) // 2]
        elif len(found) > 1:
            found.pop()
        else:
            break
        text = rendered(task, found, paths)
    return text, estimate(text), cut_short


def report(symbols: DataFrame, edges: DataFrame, task: str, budget: int = BUDGET) -> DataFrame:
    """One row (text, tokens, truncated, anchors, paths) for a task over symbols and edges (caller, callee)."""
    spark = symbols.sparkSession
    top = cut(anchors(symbols, task))
    names = [r["anchor"] for r in top.orderBy("anchor").collect()]  # at most ANCHORS
    tests = S.symbol_files(symbols).where(S.test_file(F.col("file"))).select(F.col("full_name").alias("other"), F.lit("tests").alias("part"))
    clean = edges.where("caller <> callee").select("caller", "callee").distinct()
    known = symbols.select(F.col("full_name").alias("other")).distinct()
    up = clean.join(F.broadcast(top), clean.callee == top.anchor).select("anchor", F.col("caller").alias("other"))  # at most ANCHORS
    down = clean.join(F.broadcast(top), clean.caller == top.anchor).select("anchor", F.col("callee").alias("other")).join(known, "other", "left_semi")
    rows = up.withColumn("part", F.lit("callers")).unionByName(down.withColumn("part", F.lit("callees"))).unionByName(up.join(tests, "other"))
    rank = F.row_number().over(Window.partitionBy("anchor", "part").orderBy("other"))
    # Of tests no more than the budget can hold: each name is a token at least.
    most = F.when(F.col("part") == "tests", budget + 1).otherwise(LISTED)
    lists = rows.withColumn("nth", rank).where(F.col("nth") <= most).groupBy("anchor", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "other"))), lambda x: x["other"]).alias("others"))
    held = {(r["anchor"], r["part"]): list(r["others"]) for r in lists.collect()}
    first = symbols.join(F.broadcast(top), symbols.full_name == top.anchor).groupBy("anchor").agg(F.min(F.struct("file", "line", "name", "kind")).alias("m"))
    meta = {r["anchor"]: r["m"] for r in first.collect()}
    found = [{"name": meta[a]["name"], "kind": meta[a]["kind"], "file": meta[a]["file"], "line": meta[a]["line"], **{p: held.get((a, p), []) for p in ("callers", "callees", "tests")}} for a in names]
    steps = [(k, a, b) for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    ways = paths_between(clean, spark.createDataFrame(steps, "pair int, start string, goal string")) if steps else None
    paths = [r["path"] for r in ways.orderBy("pair").limit(PATHS).collect()] if steps else []
    text, tokens, truncated = fitted(task, found, paths, budget)
    return spark.createDataFrame([(text, tokens, truncated, names[: len(found)], paths)], "text string, tokens int, truncated boolean, anchors array<string>, paths array<array<string>>")
