"""Incidents: sanitised alerts, hypotheses, evidence chains and the states of incidents and tasks.

Tables: alerts (id, severity, message, service, at), events (id, service, type, ts, attributes),
deployments (service, version, commit, ts), commits (sha, message, files, ts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities, points of hypotheses, references to pull requests.
SEVERITIES = ("critical", "error", "warning", "info")
DEPLOY, FILE, MEMORY, CODE = 0.5, 0.4, 0.6, 0.5
PULL = r"(?:#|[Pp][Rr][ -]?#?|pull request #?)(\d+)"
SERVICE_LENGTH, FUTURE_HOURS = 200, 24
# States of an incident in order; states of a task and those that may follow.
INCIDENT_STATES = ("OPEN", "INVESTIGATING", "ROOT_CAUSE_FOUND", "FIX_PROPOSED", "FIX_APPROVED", "FIX_VERIFIED", "PR_CREATED", "CLOSED")
TASK_STEPS = {
    "CREATED": "ANALYZING VERIFYING FAILED BLOCKED CANCELLED", "ANALYZING": "PLANNING COMPLETED FAILED BLOCKED CANCELLED",
    "PLANNING": "WAITING_FOR_APPROVAL COMPLETED FAILED BLOCKED CANCELLED", "WAITING_FOR_APPROVAL": "APPROVED REJECTED FAILED BLOCKED CANCELLED",
    "APPROVED": "EXECUTING FAILED BLOCKED CANCELLED REJECTED", "EXECUTING": "VERIFYING FAILED BLOCKED CANCELLED",
    "VERIFYING": "READY_FOR_PR PR_CREATED COMPLETED FAILED BLOCKED CANCELLED", "READY_FOR_PR": "PR_CREATED FAILED CANCELLED",
    "PR_CREATED": "DEPLOYING COMPLETED FAILED ROLLED_BACK", "DEPLOYING": "OBSERVING FAILED BLOCKED ROLLED_BACK", "OBSERVING": "COMPLETED FAILED BLOCKED ROLLED_BACK",
    "FAILED": "ANALYZING", "BLOCKED": "ANALYZING PLANNING EXECUTING VERIFYING COMPLETED FAILED CANCELLED",
}


def sanitised(alerts: DataFrame, now: str) -> DataFrame:
    """Alerts of known severity (else info), of a time not over a day ahead (else now), with services of bounded length."""
    late = F.lit(now).cast("timestamp")
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("info")
    at = F.when(F.col("at").isNull() | (F.col("at") > late + F.expr(f"INTERVAL {FUTURE_HOURS} HOURS")), late).otherwise(F.col("at"))
    return alerts.withColumns({"severity": severity, "at": at, "service": F.left("service", F.lit(SERVICE_LENGTH))})


def within(at: Column, ts: Column, minutes: int) -> Column:
    return (ts <= at) & (ts >= at - F.expr(f"INTERVAL {minutes} MINUTES"))


def window_before(alerts: DataFrame, rows: DataFrame, minutes: int) -> DataFrame:
    """Alerts (id, service, at) with the rows (service, ts, ...) of their service in the window before them. Time bins
    of the window's length are part of the key, so an alert of a busy service meets two bins of its rows, not all."""
    span = minutes * 60 * 1_000_000
    bin_of = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(span))
    a = alerts.withColumn("bin", F.explode(F.array(bin_of(F.col("at")) - 1, bin_of(F.col("at")))))
    return a.join(rows.withColumn("bin", bin_of(F.col("ts"))), ["service", "bin"]).where(within(F.col("at"), F.col("ts"), minutes)).drop("bin")


def hypotheses(alerts: DataFrame, events: DataFrame, deployments: DataFrame, commits: DataFrame, memories: DataFrame, minutes: int = 30) -> DataFrame:
    """(id, source, statement, confidence, score, rank) of alerts: deployments in the window before
    them, stronger for each changed file that error events name; remembered incidents of the
    service (service, content); else the files that errors name."""
    a = alerts.select("id", "service", "at")
    errors = events.where("type = 'error'").select("service", "ts", F.col("attributes")["file"].alias("file")).where(F.contains("file", F.lit("/")))
    named = window_before(a, errors, minutes).select("id", "file").distinct()
    deploys = window_before(a, deployments, minutes).select("id", "version", F.col("commit").alias("sha"))
    touched = deploys.join(commits.select("sha", "message", "files"), "sha")
    hit = touched.withColumn("file", F.explode_outer(F.array_distinct("files"))).join(named.withColumn("hit", F.lit(1)), ["id", "file"], "left")
    per = hit.groupBy("id", "sha", "message", "version").agg(F.count("hit").alias("n"), F.sort_array(F.collect_set(F.when(F.col("hit") == 1, F.col("file")))).alias("named"))
    said = F.concat(F.lit("Regression likely introduced by commit "), F.left("sha", F.lit(7)), F.lit(" ("), F.coalesce("message", F.lit("")), F.lit(") deployed as "), F.coalesce("version", F.lit("")))
    said = F.when(F.col("n") > 0, F.concat(said, F.lit(": errors name "), F.array_join("named", ", "))).otherwise(said)
    one = per.select("id", F.lit("deploy").alias("source"), said.alias("statement"), F.when(F.col("n") > 0, "INFERENCE").otherwise("HYPOTHESIS").alias("confidence"), F.round(DEPLOY + FILE * F.col("n"), 6).alias("score"))
    two = a.join(memories.select("service", "content"), "service").select("id", F.lit("memory").alias("source"), F.concat(F.lit("Historical incident matches: "), "content").alias("statement"), F.lit("INFERENCE").alias("confidence"), F.lit(MEMORY).alias("score"))
    found = one.unionByName(two)
    rest = named.join(found.select("id").distinct(), "id", "left_anti").select("id", F.lit("code").alias("source"), F.concat(F.lit("Errors concentrate in "), "file").alias("statement"), F.lit("INFERENCE").alias("confidence"), F.lit(CODE).alias("score"))
    by = Window.partitionBy("id").orderBy(F.desc("score"), "source", "statement")
    return found.unionByName(rest).withColumn("rank", F.row_number().over(by))


def root_causes(found: DataFrame) -> DataFrame:
    """(id, statement): of each alert the best hypothesis that is more than a guess."""
    best = found.where("confidence <> 'HYPOTHESIS'").groupBy("id").agg(F.min(F.struct("rank", "statement")).alias("b"))
    return best.select("id", F.col("b.statement").alias("statement"))


def evidence_chain(alerts: DataFrame, events: DataFrame, deployments: DataFrame, commits: DataFrame, minutes: int = 30) -> DataFrame:
    """(id, ord, stage, ref) of alerts: the service, its deployments, commits since the window began with
    the pull requests they name, and what its errors name; each once, where first seen."""
    a = alerts.select("id", "service", "at")
    stage = lambda df, name, ref, ord_, ts: df.select("id", F.lit(ord_).alias("ord"), ts.alias("ts"), F.lit(name).alias("stage"), ref.alias("ref"))
    near = window_before(a, events.where("type = 'error'").select("service", "ts", "attributes"), minutes)
    deploys = window_before(a, deployments, minutes)
    # Commits have no service: each alert meets those since its window began, by day so that the join has a key.
    day = lambda c: F.to_date(c)
    span = commits.agg(F.max("ts").alias("last"))
    days = a.crossJoin(F.broadcast(span)).where("last is not null").withColumn("day", F.explode(F.sequence(day(F.col("at") - F.expr(f"INTERVAL {minutes} MINUTES")), F.greatest(day("last"), day("at")))))  # one row
    since = days.join(commits.withColumn("day", day("ts")), "day").where(F.col("ts") >= F.col("at") - F.expr(f"INTERVAL {minutes} MINUTES"))
    pulls = since.withColumn("pr", F.explode(F.regexp_extract_all("message", F.lit(PULL), F.lit(1))))
    rows = stage(a, "service", F.col("service"), 1, F.col("at"))
    for part in (
        stage(deploys, "deployment", F.coalesce(F.nullif("version", F.lit("")), "commit"), 2, F.col("ts")), stage(since, "commit", F.left("sha", F.lit(8)), 3, F.col("ts")),
        stage(pulls, "pr", F.col("pr"), 4, F.col("ts")), stage(near, "symbol", F.col("attributes")["symbol"], 5, F.col("ts")), stage(near, "symbol", F.col("attributes")["file"], 5, F.col("ts")),
        stage(near, "task", F.col("attributes")["task"], 6, F.col("ts")), stage(near, "agent", F.col("attributes")["agent"], 7, F.col("ts")),
    ):
        rows = rows.unionByName(part)
    first = rows.where("ref <> ''").groupBy("id", "stage", "ref").agg(F.min(F.struct("ord", "ts")).alias("m"))
    by = Window.partitionBy("id").orderBy("m.ord", "m.ts", "ref")
    return first.withColumn("ord", F.row_number().over(by)).select("id", "ord", "stage", "ref")


def may_follow(state: Column, following: Column) -> Column:
    """Whether a task may go from one state to another."""
    ok = F.lit(False)
    for now, then in TASK_STEPS.items():
        ok = ok | ((state == now) & following.isin(*then.split()))
    return ok


def illegal_steps(history: DataFrame) -> DataFrame:
    """(task_id, seq, state, following) of recorded steps (task_id, seq, state) that the table of states forbids."""
    w = Window.partitionBy("task_id").orderBy("seq")
    pairs = history.withColumn("following", F.lead("state").over(w)).where("following is not null")
    return pairs.where(~may_follow(F.col("state"), F.col("following"))).select("task_id", "seq", "state", "following")
