"""One way to ask an index: named questions with parameters, and its tables as views for SQL.

``index`` is what ``talus.sources.project.build_index`` or ``load_index`` returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import knowledge as K
from talus.operators import symbols as S
from talus.operators.probe import report as probe_report

Index = dict[str, DataFrame]


def views(index: Index, prefix: str = "") -> list[str]:
    """Registers the tables as temporary views and returns their names."""
    for name, table in index.items():
        table.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in index]


def _names(index: Index, *values: str, column: str = "name") -> DataFrame:
    return index["symbols"].sparkSession.createDataFrame([(v,) for v in values], f"{column} string")


def _refs(index: Index, refs: DataFrame | None) -> DataFrame:
    return refs if refs is not None else index["symbols"].sparkSession.createDataFrame([], "name string, file string")


def _query(index: Index, text: str) -> DataFrame:
    return index["symbols"].sparkSession.createDataFrame([(0, text)], "query long, text string")


QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    "search": lambda ix, text, limit=50: S.ranked_search(ix["symbols"], _query(ix, text), ix["files"], limit),
    "pattern": lambda ix, pattern, limit=50: S.pattern_search(ix["symbols"], pattern, limit),
    "find": lambda ix, *names: S.find(ix["symbols"], _names(ix, *names, column="ref")),
    "who_calls": lambda ix, *names: S.callers_of(ix["symbols"], ix["calls"], _names(ix, *names)),
    "depends_on": lambda ix, *names: G.reach(ix["callers"], _names(ix, *names, column="id"), reverse=True),
    "depends_of": lambda ix, *names: G.reach(ix["callers"], _names(ix, *names, column="id")),
    "supertypes": lambda ix, *names: S.supertypes(ix["inherits"], _names(ix, *names)),
    "subtypes": lambda ix, *names: S.subtypes(ix["inherits"], _names(ix, *names)),
    "implementations": lambda ix, *names: S.dispatch_hints(ix["symbols"], ix["inherits"], _names(ix, *names)),
    "near": lambda ix, name, depth=2, most=50: S.near(ix["callers"], name, depth, most),
    "explore": lambda ix, name, depth=2, most=50: S.explore(ix["symbols"], ix["callers"], name, depth, most),
    "path": lambda ix, start, goal: G.shortest_path(ix["callers"], start, goal),
    "longest_path": lambda ix, root: S.longest_path(ix["callers"], root),
    "flows": lambda ix, limit=10: S.flows(ix["symbols"], ix["callers"], limit),
    "why": lambda ix, name: S.why(ix["symbols"], ix["callers"], name),
    "probe": lambda ix, task: S.probe(ix["symbols"], ix["callers"], task),
    "probe_report": lambda ix, task, budget=4000: probe_report(ix["symbols"], ix["callers"], task, budget),
    "hubs": lambda ix, limit=0: S.hubs(ix["symbols"], ix["callers"], limit),
    "bridges": lambda ix, limit=15: S.bridges(ix["symbols"], ix["callers"], limit),
    "dead": lambda ix, refs=None: S.dead_code(ix["symbols"], ix["callers"], _refs(ix, refs)),
    "delete": lambda ix, *names, refs=None: S.delete_check(ix["symbols"], ix["callers"], _refs(ix, refs), _names(ix, *names)),
    "coverage": lambda ix: S.coverage(ix["symbols"], ix["callers"]),
    "large": lambda ix, least=50: S.large_functions(ix["symbols"], least),
    "languages": lambda ix: ix["files"].select("lang").distinct().orderBy("lang"),
    "outline": lambda ix, most=200: _outline(ix, most),
    "communities": lambda ix: S.communities_report(ix["symbols"], ix["callers"], G.label_propagation(ix["callers"])),
    "contexts": lambda ix: K.contexts(G.label_propagation(ix["callers"]), ix["callers"]),
    "criticality": lambda ix, *names: G.criticality(ix["callers"], _names(ix, *names, column="id")),
    "apis": lambda ix, *names: K.affected_apis(ix["symbols"], ix["callers"], _names(ix, *names)),
    "services": lambda ix, *names: K.affected_services(ix["symbols"], ix["callers"], _names(ix, *names)),
    "tests": lambda ix, *names: K.affected_tests(ix["symbols"], ix["callers"], _names(ix, *names)),
    "files": lambda ix, *names: S.affected_files(ix["symbols"], _names(ix, *names, column="full_name")),
    "graph": lambda ix, name: S.neighbourhood_graph(ix["symbols"], ix["callers"], name),
    "whole_graph": lambda ix, limit=500: S.whole_graph(ix["callers"], limit),
    "changes": lambda ix, ranges: _changes(ix, ranges),
    "what_if": lambda ix, changes: K.simulate(ix["symbols"], ix["callers"], changes),
}


def _outline(index: Index, most: int) -> DataFrame:
    from talus.sources.project import project_map

    return project_map(index["symbols"], most)


def _changes(index: Index, ranges: DataFrame) -> DataFrame:
    """The review of changed ranges (file, lo, hi): risk by file."""
    s, e = index["symbols"], index["callers"]
    touched = G.overlapping(s.where(~S.test_file(s["file"])), ranges).selectExpr("file", "full_name as id")
    homes = S.symbol_files(s).select(F.col("full_name").alias("id"), "file", S.folder(F.col("file")).alias("dir"))
    tests = homes.where(S.test_file(F.col("file"))).select("id")
    return G.change_risk(touched, e, homes.select("id", "dir"), tests, S.hub_set(s, e).withColumnRenamed("symbol", "id"))


def ask(index: Index, question: str, *values, **options) -> DataFrame:
    """The answer to one of QUESTIONS."""
    return QUESTIONS[question](index, *values, **options)


def sql(spark: SparkSession, index: Index, text: str) -> DataFrame:
    """SQL over the index's tables."""
    views(index)
    return spark.sql(text)
