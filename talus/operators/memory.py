"""Memories (id, type, content, source, scope, tags, subject, provenance, related, created_at):
filters, scores, recall, caps, and patterns that recur among them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.retrieval import lesson_words

# Scopes that a question may name, and points of a match.
SCOPES = ("service", "incident", "task", "repository", "architecture", "organization", "module", "file", "agent")
WORD, TYPE, TAG, ENTITY, SCOPE, SUBJECT, PROVENANCE, RELATED = 2, 4, 5, 6, 6, 6, 5, 5


def scope_kind(scope: Column) -> Column:
    """The part before the colon; 'global' for none, empty without a colon."""
    s = F.trim(F.coalesce(scope, F.lit("")))
    return F.when(s == "", "global").when(F.contains(s, F.lit(":")), F.substring_index(s, ":", 1)).otherwise("")


def scope_id(scope: Column) -> Column:
    s = F.trim(F.coalesce(scope, F.lit("")))
    return F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, "^[^:]*:", "")).otherwise(s)


def in_scope(scope: Column, kind: str, name: str) -> Column:
    """kind:name itself, or a part of it behind a slash or colon; in either case of letters."""
    s, want = F.lower(F.coalesce(scope, F.lit(""))), f"{kind}:{name}".lower()
    return (s == want) | s.startswith(want + "/") | s.startswith(want + ":")


def is_global(scope: Column) -> Column:
    return F.lower(F.coalesce(scope, F.lit(""))).isin("", "global")


def lowered(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v.lower()) for v in values))


def overlaps(column: str, values: Iterable[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(column, F.lower), lowered(values)), F.lit(False))


def recall(memories: DataFrame, text: str = "", limit: int = 0, **wanted) -> DataFrame:
    """The memories that meet every given filter (type, service ... agent, glob=True, tags, subject,
    provenance, related, since, until), with their score: 2 a word of the text, 4 for the type, 5
    a tag, 6 for the entity, a scope or the subject, 5 for provenance and related entities. Best
    first, then newest, then by id."""
    get = wanted.get
    keep, score = F.lit(True), F.lit(0)
    if text:
        q = lesson_words(F.lit(text))
        have = lesson_words(F.col("content"))
        score += WORD * F.size(F.filter(q, lambda w: F.array_contains(have, w)))
    for kind in SCOPES:
        if get(kind):
            keep &= in_scope(F.col("scope"), kind, get(kind))
            score += SCOPE
    if get("glob"):
        keep &= is_global(F.col("scope"))
        score += SCOPE
    if get("type"):
        keep &= F.col("type") == get("type")
        score += TYPE
    if get("tags"):
        keep &= overlaps("tags", get("tags"))
        score += TAG * F.aggregate(F.transform("tags", F.lower), F.lit(0), lambda n, t: n + sum((F.when(t == v.lower(), 1).otherwise(0) for v in get("tags")), F.lit(0)))
    for name, points in (("subject", SUBJECT), ("provenance", PROVENANCE)):
        if get(name):
            keep &= F.lower(name) == get(name).lower()
            score += points
    if get("related"):
        keep &= overlaps("related", get("related"))
        score += RELATED
    if get("entity"):
        needle = get("entity").lower()
        part = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle))
        score += F.when(part(F.col("scope")) | part(F.col("content")) | F.coalesce(F.exists("tags", part), F.lit(False)), ENTITY).otherwise(0)
    if get("since"):
        keep &= F.col("created_at") >= F.lit(get("since")).cast("timestamp")
    if get("until"):
        keep &= F.col("created_at") <= F.lit(get("until")).cast("timestamp")
    out = memories.where(keep).withColumn("score", score.cast("long"))
    ordered = out.orderBy(F.desc("score"), F.desc("created_at"), "id")
    return ordered.limit(limit) if limit else ordered


def listed(memories: DataFrame, kind: str = "") -> DataFrame:
    """Memories of a type, or all, newest first."""
    return (memories.where(F.col("type") == kind) if kind else memories).orderBy(F.desc("created_at"), "id")


def newest(rows: DataFrame, most: int, by: str | None = None, at: str = "created_at", key: str = "id") -> DataFrame:
    """The newest ``most`` rows, of each ``by`` where one is given: a first-in-first-out cap."""
    if by is None:
        return rows.orderBy(F.desc(at), key).limit(most)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), key))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def patterns(memories: DataFrame, least: int = 1, samples: int = 3) -> DataFrame:
    """(key, n, scopes, samples, latest): memories that share a scope, or else their text; by number
    and key. The samples are the newest, then by text."""
    scope = F.trim(F.coalesce("scope", F.lit("")))
    key = F.when(scope != "", F.concat(F.lit("scope:"), scope)).otherwise(F.concat(F.lit("sig:"), F.left(F.sha2(F.trim("content"), 256), F.lit(12))))
    rows = memories.select(key.alias("key"), F.nullif(scope, F.lit("")).alias("scope"), "content", "created_at")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("created_at"), "content"))
    rows = rows.withColumn("nth", nth)
    some = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= samples, F.struct("nth", "content")))), lambda s: s["content"])
    n = rows.groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("scope")).alias("scopes"), some.alias("samples"), F.max("created_at").alias("latest"))
    return n.where(F.col("n") >= least).orderBy(F.desc("n"), "key")
