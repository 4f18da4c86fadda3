"""Event operators over (event_id, ts, user_id, event_type, value): a user stands for
a service, an error event for an alert, a signup for a deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.shared import cut


def correlate(alerts: DataFrame, events: DataFrame, minutes: int = 30) -> DataFrame:
    """alert, events, deployments, total: what the alert's service did in the closed
    window before it. Equal services join first, and time bins of the window's length keep
    a hot service from meeting all of its events."""
    span = minutes * 60
    bin_of = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(span * 1_000_000))
    a = alerts.select(F.col("event_id").alias("alert"), "user_id", F.col("ts").alias("at")).withColumn("bin", F.explode(F.array(bin_of(F.col("at")) - 1, bin_of(F.col("at")))))
    e = events.select("event_id", "user_id", "ts", "event_type", "value", bin_of(F.col("ts")).alias("bin"))
    hit = a.join(e, ["user_id", "bin"]).where((F.col("event_id") != F.col("alert")) & (F.col("ts") <= F.col("at")) & (F.col("ts") >= F.col("at") - F.expr(f"INTERVAL {minutes} MINUTES")))
    return hit.groupBy("alert").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "signup").alias("deployments"), F.round(F.sum("value"), 4).alias("total"))


def as_of(asks: DataFrame, facts: DataFrame) -> DataFrame:
    """(event_id, ts, found) of each ask (event_id, ts): the latest fact (event_id, ts, ...) at or before it that
    is another event, as a struct of its columns; of facts at one time the larger event. Two passes over ranges
    of time: within a range a running maximum carries the last fact along, and each range's last two facts go to
    the ranges after it, so neither a crowded minute nor a crowded instant is one task. event_id is a key."""
    kept = [c for c in facts.columns if c not in ("ts", "event_id")]
    fact = F.struct("ts", "event_id", *kept)
    rows = facts.where("ts is not null").select("event_id", "ts", F.lit(0).alias("kind"), fact.alias("fact"))
    rows = rows.unionByName(asks.where("ts is not null").select("event_id", "ts", F.lit(1).alias("kind")), allowMissingColumns=True)
    order = ("ts", "kind", "event_id")
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    in_range = Window.partitionBy("part").orderBy(*order)
    # Facts of a range stand in order, so the one before a fact is the last of those before.
    last = F.max("fact").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    before = F.when(F.col("kind") == 0, F.max("fact").over(in_range.rowsBetween(Window.unboundedPreceding, -1)))
    scan = dealt.withColumn("before", before).withColumn("last", last)
    scan = scan.withColumn("second", F.max(F.when(F.col("kind") == 0, F.struct("fact", "before"))).over(in_range.rowsBetween(Window.unboundedPreceding, 0))["before"])
    ends = dealt.where("kind = 0").groupBy("part").agg(F.max("fact").alias("last")).join(
        scan.where("kind = 0").groupBy("part").agg(F.max(F.struct("fact", "before"))["before"].alias("second")), "part")
    kind = ends.schema["last"].dataType.simpleString()
    held, top, carried = {r["part"]: r for r in ends.collect()}, [], []  # one row a range
    for p in range(parts):
        carried.append((p, *(top + [None, None])[:2]))
        if p in held:
            top = [f for f in (held[p]["last"], held[p]["second"], *top) if f is not None][:2]
    carry = asks.sparkSession.createDataFrame(carried, f"part int, c1 {kind}, c2 {kind}")
    both = scan.where("kind = 1").join(F.broadcast(carry), "part", "left")  # one row a range
    other = lambda c: F.when(F.col(f"{c}.event_id") != F.col("event_id"), F.col(c))
    return both.select("event_id", "ts", F.coalesce(other("last"), other("second"), other("c1"), other("c2")).alias("found"))


def infer_service(alerts: DataFrame, events: DataFrame, minutes: int = 30) -> DataFrame:
    """alert, service: the service of the latest error at or before an alert that
    names none, within the window; ties to the larger event."""
    errors = events.where("event_type = 'error'").select("event_id", "ts", "user_id")
    hit = as_of(alerts.select("event_id", "ts"), errors).where(F.col("found.ts") >= F.col("ts") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return hit.select(F.col("event_id").alias("alert"), F.col("found.user_id").alias("service"))


def health(events: DataFrame) -> DataFrame:
    """service, errors, events, state: unhealthy over 10 errors, degraded over 0."""
    n = events.groupBy(F.col("user_id").alias("service")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("events"))
    return n.withColumn("state", F.when(F.col("errors") > 10, "unhealthy").when(F.col("errors") > 0, "degraded").otherwise("healthy"))


def hypotheses(correlated: DataFrame) -> DataFrame:
    """alert, cause, confidence: a deployment in the window 0.5 and 0.1 for each more, at
    most 0.9; other activity 0.3."""
    cause = F.when(F.col("deployments") > 0, "deployment").otherwise("activity")
    confidence = F.when(F.col("deployments") > 0, F.least(F.lit(0.9), 0.4 + 0.1 * F.col("deployments"))).otherwise(0.3)
    return correlated.select("alert", cause.alias("cause"), F.round(confidence, 4).alias("confidence"))


def calibrate(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, recall, flagged over rows (risk, truth)."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return rows.select("risk", "truth", t).groupBy("threshold").agg(
        F.round(F.count_if((F.col("risk") >= F.col("threshold")) & (F.col("truth") == 1)) / F.count_if(F.col("truth") == 1), 6).alias("recall"),
        F.count_if(F.col("risk") >= F.col("threshold")).alias("flagged"),
    )
