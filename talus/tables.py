"""Readers for the parquet tables that the queries are bound to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder; reading goes through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
