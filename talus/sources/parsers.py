"""Parsers of operational text sources into event and commit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = ("type", "service", "severity", "message", "ts")


def prometheus(lines: DataFrame) -> DataFrame:
    """Metric events from exposition text (value): one a line, '#' lines ignored;
    the service is the label of that name; the time stays null where it is missing."""
    p = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+(\S+)(?:\s+(\d+))?\s*$'
    get = lambda k: F.regexp_extract("value", p, k)
    rows = lines.where(~F.col("value").startswith("#") & F.col("value").rlike(p))
    ms = F.when(get(4) != "", F.timestamp_millis(get(4).cast("long")))
    return rows.select(F.lit("metric").alias("type"), F.nullif(F.regexp_extract(get(2), 'service="([^"]*)"', 1), F.lit("")).alias("service"), F.lit("info").alias("severity"), get(1).alias("message"), ms.alias("ts"), get(3).cast("double").alias("value"))


OTEL = """struct<
    logs: array<struct<service: string, severity: string, body: string, time: string>>,
    traces: array<struct<service: string, name: string, time: string>>,
    metrics: array<struct<service: string, name: string, time: string>>>"""


def otel(documents: DataFrame) -> DataFrame:
    """Events from telemetry documents (value JSON): logs, traces and metrics. Error and
    critical logs become errors; rows without service or time go."""
    d = documents.select(F.from_json("value", OTEL).alias("d"))
    part = lambda name: d.select(F.explode(f"d.{name}").alias("x"))
    bad = F.lower("x.severity").isin("error", "critical", "fatal")
    logs = part("logs").select(F.when(bad, "error").otherwise("log").alias("type"), "x.service", F.lower("x.severity").alias("severity"), F.col("x.body").alias("message"), F.try_to_timestamp("x.time").alias("ts"))
    rest = [part(n).select(F.lit(t).alias("type"), "x.service", F.lit("info").alias("severity"), F.col("x.name").alias("message"), F.try_to_timestamp("x.time").alias("ts")) for n, t in (("traces", "trace"), ("metrics", "metric"))]
    return logs.unionByName(rest[0]).unionByName(rest[1]).where("service is not null and service <> '' and ts is not null")


KUBE = "struct<events: array<struct<type: string, reason: string, message: string, object: string, time: string>>, deployments: array<struct<name: string, image: string, time: string>>>"


def kubernetes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, deployments) from cluster documents; warnings and failure-like
    reasons are errors."""
    d = documents.select(F.from_json("value", KUBE).alias("d"))
    e = d.select(F.explode("d.events").alias("x"))
    bad = (F.col("x.type") == "Warning") | F.lower("x.reason").rlike("fail|error|crash|oom|unhealthy|backoff")
    events = e.select(F.when(bad, "error").otherwise("event").alias("type"), F.col("x.object").alias("service"), F.when(bad, "error").otherwise("info").alias("severity"), "x.message", F.try_to_timestamp("x.time").alias("ts"))
    p = d.select(F.explode("d.deployments").alias("x")).select(F.col("x.name").alias("service"), "x.image", F.try_to_timestamp("x.time").alias("ts"))
    return events, p


def git_log(text: DataFrame) -> DataFrame:
    """(commit, file) from logs (value): blocks split at blank lines, a block's first
    line is the commit, the others its files."""
    block = text.select(F.posexplode(F.split("value", r"\n{2,}")).alias("at", "block"))
    x = block.select(F.split(F.trim("block"), "\n").alias("x")).where("size(x) > 1")
    return x.select(F.element_at("x", 1).alias("commit"), F.explode(F.slice("x", 2, 1 << 30)).alias("file")).distinct()


def codeowners(lines: DataFrame) -> DataFrame:
    """(pattern, owner) rows of an owners file (value); comments and blank lines go."""
    x = F.split(F.trim("value"), r"\s+")
    rows = lines.where("trim(value) <> '' and not startswith(trim(value), '#')").select(x.alias("x")).where("size(x) > 1")
    return rows.select(F.element_at("x", 1).alias("pattern"), F.explode(F.slice("x", 2, 1 << 30)).alias("owner"))


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """(file, lo, hi) of added lines from unified diffs without context (value);
    binary files and deletions give one row with null bounds."""
    f = diffs.select(F.explode(F.filter(F.split("value", r"(?m)^diff --git "), lambda x: x != "")).alias("d"))
    f = f.select(F.regexp_extract("d", r"^a/(\S+) b/(\S+)", 2).alias("file"), F.regexp_extract_all("d", F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), F.lit(1)).alias("h"))
    one = f.select("file", F.explode_outer("h").alias("h"))
    lo, n = F.split_part("h", F.lit(","), F.lit(1)).cast("int"), F.coalesce(F.nullif(F.split_part("h", F.lit(","), F.lit(2)), F.lit("")).cast("int"), F.lit(1))
    return one.select("file", F.when(n > 0, lo).alias("lo"), F.when(n > 0, lo + n - 1).alias("hi"))


API_LIST = """struct<items: array<struct<
    metadata: struct<name: string, creationTimestamp: string>,
    involvedObject: struct<name: string>, type: string, reason: string, message: string, lastTimestamp: string,
    spec: struct<template: struct<spec: struct<containers: array<struct<image: string>>>>>>>>"""


def kube_api(deployments: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, deployments) from the API's lists of deployments and events (value JSON)."""
    item = lambda d: d.select(F.explode(F.from_json("value", API_LIST)["items"]).alias("x"))
    e = item(events).select(F.struct("x.type", "x.reason", "x.message", F.col("x.involvedObject.name").alias("object"), F.coalesce("x.lastTimestamp", "x.metadata.creationTimestamp").alias("time")).alias("x"))
    p = item(deployments).select(F.struct(F.col("x.metadata.name").alias("name"), F.try_element_at("x.spec.template.spec.containers", F.lit(1))["image"].alias("image"), F.col("x.metadata.creationTimestamp").alias("time")).alias("x"))
    document = lambda d, name, other: d.select(F.to_json(F.struct(F.array("x").alias(name))).alias("value"))
    return kubernetes(document(e, "events", "deployments"))[0], kubernetes(document(p, "deployments", "events"))[1]


SNAPSHOT = """struct<
    events: array<struct<id: string, type: string, service: string, severity: string, message: string, ts: string, attributes: map<string, string>>>,
    deployments: array<struct<service: string, version: string, commit: string, ts: string>>,
    commits: array<struct<sha: string, message: string, author: string, files: array<string>, ts: string>>>"""


def snapshot(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, deployments, commits) of local snapshot documents (value JSON)."""
    d = documents.select(F.from_json("value", SNAPSHOT).alias("d"))
    part = lambda name: d.select(F.explode(f"d.{name}").alias("x")).select("x.*").withColumn("ts", F.try_to_timestamp("ts"))
    return part("events"), part("deployments"), part("commits")


def of_service(events: DataFrame, service: str = "", since: str = "", until: str = "") -> DataFrame:
    """Events or deployments (service, ts, ...) of a service and time, in order of time."""
    if service:
        events = events.where(F.col("service") == service)
    if since:
        events = events.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        events = events.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    return events.orderBy("ts", *(c for c in ("id", "service", "version") if c in events.columns))


def git_status(lines: DataFrame) -> DataFrame:
    """(file, state) of porcelain status lines (value); of renames the new name."""
    rows = lines.where(F.length("value") > 3)
    name = F.regexp_replace(F.element_at(F.split(F.substr("value", F.lit(4)), " -> "), -1), '^"|"$', "")
    return rows.select(name.alias("file"), F.trim(F.left("value", F.lit(2))).alias("state")).distinct()
