"""Policies, firewall decisions, audit chain, flight records, tasks and agents, as tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels of risk in order, with their scores.
LEVELS = {"LOW": 0.25, "MEDIUM": 0.5, "HIGH": 0.75, "CRITICAL": 1.0}
# Policies: name, rule, description.
POLICIES = (
    ("source_write", "MEDIUM source.write", "Changes to source code."),
    ("documentation_write", "LOW documentation.write", "Changes to documentation."),
    ("security_sensitive_write", "HIGH security.write", "Changes to security-sensitive files (approval required)."),
    ("production_deploy", "CRITICAL production.deploy", "Deploying to production (approval required)."),
    ("database_drop", "CRITICAL database.drop", "Dropping a database (always blocked)."),
    ("test_write", "LOW tests.write", "Changes to test files."),
    ("config_write", "MEDIUM config.write", "Changes to configuration."),
)
# Questions to flight records and the actions that answer them (none: all).
QUESTIONS = {
    "why_decision": ("decision_made",), "what_context_used": ("context_retrieved", "memory_retrieved"), "which_tools_called": ("tool_called",),
    "who_approved": ("approval_requested", "change_accepted"), "what_changed": ("file_modified",), "what_tested": ("test_executed",), "what_happened": (),
}
# Weights of an agent's score.
SUCCESS, COST, TOKENS, SECONDS, DEFECTS, RETRIES, HUMAN = 100.0, 10.0, 0.001, 0.1, 20.0, 5.0, 30.0
FRESH_HOURS = 24


def policies(spark, rows=POLICIES) -> DataFrame:
    """(name, level, resource, action, description, enabled) of rules '<LEVEL> <resource>.<action>'."""
    split = [(n, *r.split()[0:1], *r.split()[1].split(".", 1), d, True) for n, r, d in rows if len(r.split()) == 2 and "." in r.split()[1]]
    return spark.createDataFrame(split, "name string, level string, resource string, action string, description string, enabled boolean")


def rank(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in chain(*((k, i) for i, k in enumerate(LEVELS, 1))))), level), F.lit(1))


def assess(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (id, resource, action) with level, score, factors and approval_required: the highest
    level of the enabled policies (at most hundreds) that match, LOW where none does."""
    r = F.broadcast(rules.where("enabled").select("resource", "action", "name", "level"))
    hit = requests.select("id", "resource", "action").join(r, ["resource", "action"], "left")
    out = hit.groupBy("id", "resource", "action").agg(F.max(rank(F.col("level"))).alias("r"), F.sort_array(F.collect_list(F.concat_ws(": ", "name", "level"))).alias("found"), F.count("level").alias("n"))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("r"))
    none = F.array(F.concat("resource", F.lit(":"), "action", F.lit(" not covered by policy")))
    score = F.element_at(F.array(*map(F.lit, LEVELS.values())), F.col("r"))
    return out.select("id", "resource", "action", level.alias("level"), score.alias("score"), F.when(F.col("n") > 0, F.col("found")).otherwise(none).alias("factors"), (F.col("r") >= 3).alias("approval_required"))


def decide(requests: DataFrame, rules: DataFrame, agents: DataFrame, permissions: DataFrame, approvals: DataFrame) -> DataFrame:
    """requests (id, at, agent, resource, action) -> (id, decision, level): an unknown agent or one
    without permission (agent, resource, action) is denied, dropping what is CRITICAL blocked,
    HIGH and CRITICAL pending; a granted approval (agent, resource, action, granted_at) lets the
    first request after it pass, once."""
    risk = assess(requests, rules).select("id", "level", "approval_required")
    known = agents.select("agent").distinct().withColumn("known", F.lit(True))
    may = permissions.select("agent", "resource", "action").distinct().withColumn("may", F.lit(True))
    rows = requests.join(risk, "id").join(known, "agent", "left").join(may, ["agent", "resource", "action"], "left")
    blocked = (F.col("level") == "CRITICAL") & (F.col("action") == "drop")
    gate = F.col("known") & F.col("may") & F.col("approval_required") & ~blocked
    asks = rows.where(gate).select("agent", "resource", "action", F.col("at"), "id")
    grants = approvals.select("agent", "resource", "action", F.col("granted_at").alias("at"), F.lit(None).cast(asks.schema["id"].dataType).alias("id"))
    by = Window.partitionBy("agent", "resource", "action").orderBy("at", F.col("id").isNotNull(), "id")
    line = asks.unionByName(grants).withColumn("prior", F.lag(F.col("id").isNull()).over(by))
    passed = line.where("id is not null and prior").select("id", F.lit(True).alias("granted"))
    decision = (
        F.when(F.col("known").isNull() | F.col("may").isNull(), "denied").when(blocked, "blocked").when(~F.col("approval_required") | F.col("granted"), "allowed").otherwise("pending")
    )
    return rows.join(passed, "id", "left").select("id", decision.alias("decision"), F.when(F.col("known").isNull(), "CRITICAL").otherwise(F.col("level")).alias("level"))


def chained(entries: DataFrame, fields: list[str]) -> Column:
    """The content of an audit entry as one text; its hash is that of the hash before and this."""
    return F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))


def chain_break(audit: DataFrame, fields: list[str], buckets: str = "day") -> DataFrame:
    """(seq, fault) of an audit chain (seq, prev, hash, <bucket>, fields ...) whose link or hash fails.
    The predecessor comes from a window over one bucket; the last row of each bucket is carried
    to the next by a window over one row a bucket, so no task sees the whole chain."""
    w = Window.partitionBy(buckets).orderBy("seq")
    ends = audit.groupBy(buckets).agg(F.max_by("hash", "seq").alias("end"), F.max("seq").alias("last"))
    before = ends.withColumn("before", F.lag("end").over(Window.orderBy("last"))).select(buckets, "before")
    seen = audit.join(before, buckets).withColumn("was", F.coalesce(F.lag("hash").over(w), F.col("before"), F.lit("")))
    link, content = F.col("prev") == F.col("was"), F.col("hash") == F.sha2(F.concat_ws("|", "prev", chained(audit, fields)), 256)
    fault = F.when(~link & ~content, "both").when(~link, "link").when(~content, "hash")
    return seen.select("seq", fault.alias("fault")).where("fault is not null")


def filtered(records: DataFrame, newest_first: bool = True, **values: str) -> DataFrame:
    """Records (id, ts, ...) whose columns have the given values, empty ones aside, in order of time."""
    for column, value in values.items():
        if value:
            records = records.where(F.col(column) == value)
    return records.orderBy(F.desc("ts") if newest_first else F.col("ts"), "id")


def asked(records: DataFrame, question: str, task: str) -> DataFrame:
    """Flight records (id, ts, task_id, action, ...) of a task that answer one of QUESTIONS, oldest first."""
    actions = QUESTIONS[question]
    out = records.where(F.col("task_id") == task)
    return (out.where(F.col("action").isin(*actions)) if actions else out).orderBy("ts", "id")


def task_states(snapshots: DataFrame) -> DataFrame:
    """(task_id, state, at): the latest of snapshots (task_id, state, at, seq)."""
    best = snapshots.groupBy("task_id").agg(F.max(F.struct("at", "seq", "state")).alias("m"))
    return best.select("task_id", F.col("m.state").alias("state"), F.col("m.at").alias("at"))


def tasks_in_state(snapshots: DataFrame, state: str) -> DataFrame:
    return task_states(snapshots).where(F.col("state") == state).select("task_id").orderBy("task_id")


def tasks_since(snapshots: DataFrame, at: str) -> DataFrame:
    return task_states(snapshots).where(F.col("at") >= F.lit(at).cast("timestamp")).orderBy("at", "task_id")


def task_history(snapshots: DataFrame, task: str) -> DataFrame:
    return snapshots.where(F.col("task_id") == task).orderBy("at", "seq")


def inside_boundary(path: Column, allowed: list[str], denied: list[str]) -> Column:
    """Whether a path lies under an allowed prefix (any, where none is named) and under no denied one."""
    under = lambda p: (path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/")
    ok = F.lit(not allowed)
    for p in allowed:
        ok = ok | under(p)
    for p in denied:
        ok = ok & ~under(p)
    return ok


def agent_score() -> Column:
    """From success, cost, tokens, seconds, defects, retries and human (intervention)."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    return SUCCESS * c("success") - COST * c("cost") - TOKENS * c("tokens") - SECONDS * c("seconds") - DEFECTS * c("defects") - RETRIES * c("retries") - HUMAN * c("human")


def compare_agents(evaluations: DataFrame) -> DataFrame:
    """(task_id, winner, best, agents): the agent of the highest score on each task, 'tie' where several have it."""
    rows = evaluations.withColumn("score", F.round(agent_score(), 6))
    best = rows.groupBy("task_id").agg(F.max("score").alias("best"), F.count("*").alias("agents"))
    at = rows.join(best, "task_id").where("score = best").groupBy("task_id", "best", "agents").agg(F.count("*").alias("k"), F.min("agent").alias("agent"))
    return at.select("task_id", F.when(F.col("k") > 1, "tie").otherwise(F.col("agent")).alias("winner"), "best", "agents")


def task_kind(intent: Column, kind: Column) -> Column:
    """The named kind or words of the intent: incident, modernization, documentation, else code."""
    t, i = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.coalesce(intent, F.lit("")))
    return (
        F.when((t == "incident") | i.rlike("incident|correlate|root-cause|alert"), "incident")
        .when((t == "modernize") | i.rlike("modernize|refactor|extract|split-monolith"), "modernization")
        .when((t == "documentation") | i.rlike("document|docs|readme"), "documentation").otherwise("code")
    )


def model_tier(risk: Column, complexity: Column) -> Column:
    """large, medium or small by risk and complexity."""
    return F.when(risk.isin("CRITICAL", "HIGH") | (complexity == "high"), "large").when((risk == "MEDIUM") | (complexity == "medium"), "medium").otherwise("small")


def freshness(observed: Column, now: Column, hours: int = FRESH_HOURS) -> Column:
    return F.when(observed.isNull(), "UNKNOWN").when(observed >= now - F.expr(f"INTERVAL {hours} HOURS"), "FRESH").otherwise("STALE")
