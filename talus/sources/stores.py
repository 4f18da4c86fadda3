"""Stores as tables: usage statistics by day, CSV export, keyed JSON, repositories, rules, polled folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = "ts timestamp, session string, operation string, source string, model string, before_tokens long, after_tokens long"
# Dollars a million tokens read, by model; others cost nothing.
PRICES = {
    "gpt-4o": 2.50, "gpt-4o-mini": 0.15, "gpt-4.1": 2.00, "gpt-4.1-mini": 0.40, "gpt-4.1-nano": 0.10, "claude-sonnet-4": 3.00, "claude-3-5-sonnet": 3.00, "claude-haiku-4-5": 1.00,
    "gemini-2.5-pro": 1.25, "gemini-2.5-flash": 0.30, "llama-3.3-70b": 0.00, "local": 0.00,
}


def record_stats(entries: DataFrame, root: str, prices: dict[str, float] = PRICES) -> None:
    """Appends entries (STATS) as JSON lines, a folder a day, with what they saved."""
    price = F.lit(0.0)
    for model, dollars in prices.items():
        price = F.when(F.col("model") == model, dollars).otherwise(price)
    saved = F.col("before_tokens") - F.col("after_tokens")
    percent = F.when(F.col("before_tokens") > 0, 100.0 * saved / F.col("before_tokens")).otherwise(0.0)
    rows = entries.withColumn("saved_tokens", saved).withColumn("saved_percent", percent).withColumn("cost_saved", saved / 1e6 * price)
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(root)


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STATS + ", saved_tokens long, saved_percent double, cost_saved double, day date").json(root)


def newest_stats(stats: DataFrame, n: int = 20) -> DataFrame:
    return stats.orderBy(F.desc("ts"), "session", "operation").limit(n)


def summarize(stats: DataFrame, today: str, days: int, session: str = "") -> DataFrame:
    """(operations, before_total, after_total, saved_total, saved_percent, cost_saved, by_operation) of
    the last days up to ``today``; none or fewer mean today only. The day prunes folders."""
    rows = stats.where(F.col("day") >= F.date_sub(F.lit(today).cast("date"), max(days, 1) - 1))
    rows = rows.where(F.col("session") == session) if session else rows
    per = rows.groupBy("operation").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("before_tokens", "after_tokens", "saved_tokens", "cost_saved")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    percent = F.when(total("before_tokens") > 0, 100.0 * total("saved_tokens") / total("before_tokens")).otherwise(0.0)
    by = F.map_from_entries(F.sort_array(F.collect_list(F.struct("operation", "n"))))
    return per.agg(total("n").alias("operations"), total("before_tokens").alias("before_total"), total("after_tokens").alias("after_total"), total("saved_tokens").alias("saved_total"), percent.alias("saved_percent"), total("cost_saved").alias("cost_saved"), by.alias("by_operation"))


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def put(store: DataFrame | None, entries: DataFrame) -> DataFrame:
    """A keyed store (key, value JSON) with entries put in place of those of their keys; values that are no JSON are refused."""
    good = entries.where(F.try_parse_json("value").isNotNull()).groupBy("key").agg(F.max("value").alias("value"))
    return good if store is None else store.join(good, "key", "left_anti").unionByName(good)


def get(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys, "key", "left_semi")


def listed(store: DataFrame, prefix: str = "") -> DataFrame:
    return store.where(F.col("key").startswith(prefix)).select("key").orderBy("key")


def repositories(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo, root) of a registry; the column repo keys the tables of several repositories."""
    return spark.createDataFrame(sorted(roots.items()), "repo string, root string")


def in_repository(table: DataFrame, repo: str) -> DataFrame:
    return table.withColumn("repo", F.lit(repo))


def boundary_rules(spark: SparkSession, text: str) -> DataFrame:
    """(ord, src, dst, action) of a JSON document {"rules": [{"from", "to", "action"}]}, in order."""
    rules = json.loads(text).get("rules", [])
    return spark.createDataFrame([(k, r["from"], r["to"], r.get("action", "forbid")) for k, r in enumerate(rules, 1)], "ord int, src string, dst string, action string")


def layer_rules(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(layers (ord, layer, pattern), allowed (src_layer, dst_layer)) of a JSON document {"layers":
    [{"name", "paths", "depends"}]}."""
    layers = json.loads(text).get("layers", [])
    rows = [(k, x["name"], p) for k, x in enumerate(layers, 1) for p in x.get("paths", [])]
    allowed = [(x["name"], d) for x in layers for d in x.get("depends", [])]
    return spark.createDataFrame(rows, "ord int, layer string, pattern string"), spark.createDataFrame(allowed, "src_layer string, dst_layer string")


def polled(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of JSON documents that pollers land in a folder, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(folder)
