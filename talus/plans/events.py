"""Event operators bound to events, documents and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from talus.functions.schema import canonical_json, validate
from talus.functions.text import token_estimate
from talus.operators import context as C
from talus.operators import events as E
from talus.operators import governance as V
from talus.operators import incidents as I
from talus.operators import knowledge as K
from talus.operators import memory as M
from talus.shared import cut
from talus.tables import table


def events(spark, sf):
    return table(spark, sf, "events")


def alert_correlation(spark, sf):
    e = events(spark, sf)
    return E.correlate(e.where("event_type = 'error'"), e)


def service_inference(spark, sf):
    """Every view event names no service; the latest error before it does."""
    e = events(spark, sf)
    return E.infer_service(e.where("event_type = 'view'"), e)


def hypotheses(spark, sf):
    return E.hypotheses(alert_correlation(spark, sf))


def service_health(spark, sf):
    return E.health(events(spark, sf))


def memories(spark, sf):
    """Events as memories: the payload is the content, the kind the type, the user the scope of all but errors."""
    scope = F.when(F.col("event_type") != "error", F.concat(F.lit("service:"), F.col("user_id").cast("string"))).otherwise("")
    tags = F.array("event_type", F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")))
    return events(spark, sf).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("props").alias("content"), F.lit("bus").alias("source"), scope.alias("scope"), tags.alias("tags"),
        F.lit("").alias("subject"), F.lit("").alias("provenance"), tags.alias("related"), F.col("ts").alias("created_at"),
    )


def pattern_mining(spark, sf):
    out = M.patterns(memories(spark, sf), 2)
    return out.select("key", "n", F.array_join("scopes", ",").alias("scopes"), F.array_join("samples", ",").alias("samples"), "latest")


def memory_recall(spark, sf):
    """Purchases that mention a number, of users tagged with their last digit; the best 50."""
    out = M.recall(memories(spark, sf), text="k value 100", limit=50, type="purchase", tags=["D3", "purchase"], entity="service:13")
    return out.select("id", "score")


def memory_caps(spark, sf):
    """The newest two memories of each scope."""
    return M.newest(memories(spark, sf), 2, by="scope").select("id", "scope")


def stats_summary(spark, sf):
    e = events(spark, sf)
    return e.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def metrics_snapshot(spark, sf):
    e = events(spark, sf)
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("hit_rate"), F.countDistinct("user_id").alias("services"))


def claim_conflicts(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("source"), F.col("props").alias("statement"), (F.col("value") / 1000).alias("confidence"))
    return C.conflicts(rows)


FIELDS = ["event_id", "event_type", "user_id"]


def audit_log(spark, sf):
    """A chained log of the events: every hash rests on the row before. Then every 50th row's link
    is broken, and every 70th row's content is changed after it was sealed."""
    e = events(spark, sf).select(F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), *FIELDS)
    content = V.chained(e, FIELDS)

    def seal(batches):
        import hashlib

        prev = ""
        for part in batches:
            out = []
            for seq, day, text in zip(part["seq"], part["day"], part["content"], strict=True):
                own = hashlib.sha256(f"{prev}|{text}".encode()).hexdigest()
                out.append((seq, prev, own))
                prev = own
            yield pd.DataFrame(out, columns=["seq", "prev", "hash"])

    sealed = e.select("seq", "day", content.alias("content")).repartition(1).sortWithinPartitions("seq").mapInPandas(seal, "seq long, prev string, hash string")  # written one after the other, as a log is
    rows = e.join(sealed, "seq")
    rows = rows.withColumn("prev", F.when(F.col("seq") % 50 == 49, F.reverse("prev")).otherwise(F.col("prev")))
    return rows.withColumn("user_id", F.when(F.col("seq") % 70 == 9, F.col("user_id") + 1).otherwise(F.col("user_id")))


def audit_chain_verify(spark, sf):
    return V.chain_break(audit_log(spark, sf), FIELDS)


def policy_assessment(spark, sf):
    """Events as requests: users act on resources by their number, kinds of events are actions."""
    return V.assess(requests(spark, sf), V.policies(spark)).select("id", "level", "score", "approval_required", F.array_join("factors", ",").alias("factors"))


RESOURCES = ("source", "documentation", "security", "production", "database", "tests", "config", "other")
ACTIONS = ("write", "deploy", "drop")


def requests(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    return events(spark, sf).select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("agent"), pick(RESOURCES, F.col("user_id")).alias("resource"), pick(ACTIONS, F.col("event_id")).alias("action"))


def firewall_decisions(spark, sf):
    """Users of even number are agents; those divisible by 4 lack permission to drop; a purchase of a
    user is a granted approval to deploy in production."""
    r = requests(spark, sf)
    agents = r.where("agent % 2 = 0").select("agent").distinct()
    permissions = r.where("not (agent % 4 = 0 and action = 'drop')").select("agent", "resource", "action").distinct()
    grants = events(spark, sf).where("event_type = 'purchase'").select(F.col("user_id").alias("agent"), F.lit("production").alias("resource"), F.lit("deploy").alias("action"), F.col("ts").alias("granted_at"))
    return V.decide(r, V.policies(spark), agents, permissions, grants)


def flight_questions(spark, sf):
    """What one user's record shows: errors and clicks, oldest first, and all records by kind."""
    rec = events(spark, sf).select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("task_id"), F.when(F.col("event_type") == "click", "tool_called").otherwise("decision_made").alias("action"))
    both = V.asked(rec, "which_tools_called", "13").select("id", F.lit("tools").alias("question")).unionByName(V.asked(rec, "why_decision", "13").select("id", F.lit("why").alias("question")))
    return both.unionByName(V.filtered(rec, task_id="12").select("id", F.lit("filter").alias("question")))


def task_snapshots(spark, sf):
    snaps = events(spark, sf).select(F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return V.task_states(snaps)


def task_steps(spark, sf):
    """Kinds of events as states of a user's task: which steps the table of states forbids."""
    state = F.create_map(*(F.lit(x) for pair in {"signup": "CREATED", "view": "ANALYZING", "click": "PLANNING", "purchase": "COMPLETED", "error": "FAILED"}.items() for x in pair))[F.col("event_type")]
    return I.illegal_steps(events(spark, sf).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), state.alias("state")))


def agent_comparison(spark, sf):
    """Kinds of events as agents, days as tasks."""
    by = events(spark, sf).groupBy(F.to_date("ts").cast("string").alias("task_id"), F.col("event_type").alias("agent"))
    rows = by.agg(F.lit(True).alias("success"), F.round(F.avg("value") / 100, 4).alias("cost"), F.count("*").alias("tokens"), F.lit(0).alias("seconds"), F.count_if(F.col("value") > 400).alias("defects"), F.lit(0).alias("retries"), F.lit(False).alias("human"))
    return V.compare_agents(rows)


def runtime_graph(spark, sf):
    """Kinds of nodes and edges of the operations graph: users are services, signups deployments."""
    e = events(spark, sf).select(F.col("user_id").cast("string").alias("service"), F.col("event_type").alias("type"), "ts", F.create_map(F.lit("file"), F.when(F.col("value") > 300, F.concat(F.lit("src/"), F.col("user_id").cast("string"))).otherwise("")).alias("attributes"))
    d = events(spark, sf).where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("service"), F.col("event_id").cast("string").alias("version"))
    n, x = K.runtime_graph(e, d)
    return n.groupBy("kind").agg(F.count("*").alias("n")).unionByName(x.groupBy("kind").agg(F.count("*").alias("n")))


def incident_hypotheses(spark, sf):
    """Errors as alerts, signups as deployments of the commit of their number, whose files follow from it;
    errors name files by their value. How many alerts have which best source."""
    h = I.hypotheses(*incident_tables(spark, sf), spark.createDataFrame([("13", "disk full")], "service string, content string"))
    return h.select("id", "source", "score", "confidence", "rank")


def incident_tables(spark, sf):
    e = events(spark, sf)
    service = F.col("user_id").cast("string").alias("service")
    alerts = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("error").alias("severity"), F.lit("").alias("message"), service, F.col("ts").alias("at"))
    file = F.concat(F.lit("src/"), F.floor(F.col("value") / 50).cast("string"))
    telemetry = e.select(F.col("event_id").alias("id"), service, F.col("event_type").alias("type"), "ts", F.create_map(F.lit("file"), file).alias("attributes"))
    deployments = e.where("event_type = 'signup'").select(service, F.col("event_id").cast("string").alias("version"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commit"), "ts")
    commits = e.where("event_type = 'signup'").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("sha"), F.lit("change").alias("message"), F.array(file, F.lit("README")).alias("files"), "ts")
    return alerts, telemetry, deployments, commits


def threshold_calibration(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return E.calibrate(d.select((F.col("n_chars") / 1000.0).alias("risk"), F.col("quality").alias("truth")), [0.5, 1.0, 2.0, 4.0, 8.0])


def context_gc_actions(spark, sf):
    d = table(spark, sf, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("plan", "fact", "memory", "history"))), (F.col("doc_id") % 4 + 1).cast("int"))
    items = d.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("text").alias("content"), kind.alias("class"), F.when(F.col("lang") == "en", "graph").otherwise("tool").alias("source"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 48 as int))").alias("fresh"))
    return C.item_actions(items, "license from that", "thing", "2024-01-02 12:00:00", 100)


def context_packets(spark, sf):
    d = table(spark, sf, "documents")
    return C.packet_metrics(d.select(F.col("source").alias("packet"), F.col("lang").alias("class"), (F.col("doc_id") % 3).alias("source"), token_estimate(F.col("text")).alias("tokens")))


def greedy_pack(spark, sf):
    """Documents by number into a budget of 20,000 tokens."""
    d = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return C.pack(d, 20_000)


def change_intents(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(C.intent_verbs(F.col("text")), ",").alias("verbs"), F.array_join(C.intent_categories(F.col("text")), ",").alias("categories"))


def task_routing(spark, sf):
    c = table(spark, sf, "conversations")
    kind = V.task_kind(F.col("text"), F.lit(""))
    risk = F.when(F.col("turn") % 3 == 0, "HIGH").when(F.col("turn") % 3 == 1, "MEDIUM").otherwise("LOW")
    return c.select("conv_id", "turn", kind.alias("kind"), V.model_tier(risk, F.lit("low")).alias("tier"))


def freshness_states(spark, sf):
    e = events(spark, sf)
    return e.groupBy(V.freshness(F.col("ts"), F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'")).alias("state")).agg(F.count("*").alias("n"))


def session_windows(spark, sf):
    e = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


SCHEMA = '{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "max": 50}}, "additionalProperties": false}'


def schema_validation(spark, sf):
    """Violations of a schema of props: k an integer of at most 50, and nothing else."""
    return events(spark, sf).select("event_id", F.array_join(validate("props", SCHEMA), ";").alias("violation")).where("violation <> ''")


def json_equality(spark, sf):
    """Events whose props equal those of the event before, however they are spelled. Each is read once, before the
    join: within a merge join the expression is too long for the compiler."""
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))  # reading JSON costs far more than its bytes tell
    rows = events(spark, sf).select("event_id", "props").where("event_id is not null and props is not null").repartition(wide)
    e = cut(rows.select("event_id", canonical_json(F.col("props")).alias("said")))
    return e.join(e.select((F.col("event_id") + 1).alias("event_id"), "said"), ["event_id", "said"]).select("event_id")


QUERIES = {f.__name__: f for f in (alert_correlation, service_inference, hypotheses, service_health, pattern_mining, memory_recall, memory_caps, stats_summary, metrics_snapshot, claim_conflicts, audit_chain_verify, policy_assessment, firewall_decisions, flight_questions, task_snapshots, task_steps, agent_comparison, runtime_graph, incident_hypotheses, threshold_calibration, context_gc_actions, context_packets, greedy_pack, change_intents, task_routing, freshness_states, session_windows, schema_validation, json_equality)}

CORR = """c AS (SELECT a.event_id AS alert, count(*) AS events, count(*) FILTER (WHERE e.event_type = 'signup') AS deployments, round(sum(e.value), 4) AS total
    FROM events a JOIN events e ON a.user_id = e.user_id AND e.event_id <> a.event_id AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL 30 MINUTE WHERE a.event_type = 'error' GROUP BY 1)"""
REQUESTS = """q AS (SELECT event_id AS id, ts AS seen, user_id AS agent, ['source', 'documentation', 'security', 'production', 'database', 'tests', 'config', 'other'][user_id % 8 + 1] AS resource, ['write', 'deploy', 'drop'][event_id % 3 + 1] AS action FROM events)"""
LEVEL = "CASE resource || '.' || action WHEN 'source.write' THEN 'MEDIUM' WHEN 'documentation.write' THEN 'LOW' WHEN 'security.write' THEN 'HIGH' WHEN 'production.deploy' THEN 'CRITICAL' WHEN 'database.drop' THEN 'CRITICAL' WHEN 'tests.write' THEN 'LOW' WHEN 'config.write' THEN 'MEDIUM' END"
POLICY = "CASE resource || '.' || action WHEN 'source.write' THEN 'source_write' WHEN 'documentation.write' THEN 'documentation_write' WHEN 'security.write' THEN 'security_sensitive_write' WHEN 'production.deploy' THEN 'production_deploy' WHEN 'database.drop' THEN 'database_drop' WHEN 'tests.write' THEN 'test_write' WHEN 'config.write' THEN 'config_write' END"
SPACE = r"[\t\n\x0B\f\r ]+"
TOKENS = f"CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(trunc((octet_length(encode(regexp_replace(text, '{SPACE}', '', 'g'))) + len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda w: w <> ''))) * 0.25)::BIGINT, 1) END"
ORACLES = {
    "alert_correlation": f"WITH {CORR} SELECT * FROM c",
    "hypotheses": f"WITH {CORR} SELECT alert, CASE WHEN deployments > 0 THEN 'deployment' ELSE 'activity' END AS cause, round(CASE WHEN deployments > 0 THEN least(0.9, 0.4 + 0.1 * deployments)::DOUBLE ELSE 0.3::DOUBLE END, 4) AS confidence FROM c",
    "service_inference": """WITH h AS (SELECT a.event_id AS alert, e.user_id, row_number() OVER (PARTITION BY a.event_id ORDER BY e.ts DESC, e.event_id DESC) AS k
        FROM events a JOIN events e ON e.event_type = 'error' AND e.event_id <> a.event_id AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL 30 MINUTE WHERE a.event_type = 'view')
        SELECT alert, user_id AS service FROM h WHERE k = 1""",
    "service_health": """WITH n AS (SELECT user_id AS service, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY 1)
        SELECT *, CASE WHEN errors > 10 THEN 'unhealthy' WHEN errors > 0 THEN 'degraded' ELSE 'healthy' END AS state FROM n""",
    "pattern_mining": """WITH m AS (SELECT CASE WHEN event_type <> 'error' THEN 'service:' || user_id ELSE '' END AS scope, props AS content, ts FROM events),
        k AS (SELECT *, CASE WHEN scope <> '' THEN 'scope:' || scope ELSE 'sig:' || substr(sha256(trim(content)), 1, 12) END AS key FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, content) AS k FROM k)
        SELECT key, count(*) AS n, coalesce(string_agg(DISTINCT nullif(scope, ''), ','), '') AS scopes, string_agg(content, ',' ORDER BY k) FILTER (WHERE k <= 3) AS samples, max(ts) AS latest FROM r GROUP BY key HAVING count(*) >= 2""",
    "memory_recall": """WITH m AS (SELECT event_id AS id, ts, 4 + CASE WHEN list_contains(regexp_extract_all(lower(props), '[a-z0-9_]+'), '100') THEN 2 ELSE 0 END + CASE WHEN list_contains(regexp_extract_all(lower(props), '[a-z0-9_]+'), 'value') THEN 2 ELSE 0 END
        + 5 + CASE WHEN user_id % 10 = 3 THEN 5 ELSE 0 END + CASE WHEN contains('service:' || user_id, 'service:13') THEN 6 ELSE 0 END AS score FROM events WHERE event_type = 'purchase')
        SELECT id, score FROM m ORDER BY score DESC, ts DESC, id LIMIT 50""",
    "memory_caps": """WITH m AS (SELECT event_id AS id, ts, CASE WHEN event_type <> 'error' THEN 'service:' || user_id ELSE '' END AS scope FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, id) AS k FROM m) SELECT id, scope FROM r WHERE k <= 2""",
    "stats_summary": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "metrics_snapshot": "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE, 6) AS hit_rate, count(DISTINCT user_id) AS services FROM events",
    "claim_conflicts": """SELECT CAST(a.user_id AS VARCHAR) AS scope, count(*) AS conflicts, round(min(least(a.value, b.value)) / 1000 * 0.5, 6) AS confidence
        FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type AND lower(trim(a.props)) <> lower(trim(b.props)) GROUP BY 1""",
    "audit_chain_verify": """SELECT event_id AS seq, CASE WHEN event_id % 50 = 49 THEN 'both' ELSE 'hash' END AS fault FROM events WHERE event_id % 50 = 49 OR event_id % 70 = 9""",
    "policy_assessment": f"""WITH {REQUESTS}, a AS (SELECT id, resource, action, {LEVEL} AS level, {POLICY} AS policy FROM q)
        SELECT id, coalesce(level, 'LOW') AS level, CASE level WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.75::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS score, coalesce(level IN ('HIGH', 'CRITICAL'), false) AS approval_required,
               coalesce(policy || ': ' || level, resource || ':' || action || ' not covered by policy') AS factors FROM a""",
    "firewall_decisions": f"""WITH {REQUESTS}, a AS (SELECT q.*, coalesce({LEVEL}, 'LOW') AS level, agent % 2 = 0 AS known FROM q),
        m AS (SELECT *, known AND EXISTS (SELECT 1 FROM q p WHERE p.agent = a.agent AND p.resource = a.resource AND p.action = a.action AND NOT (p.agent % 4 = 0 AND p.action = 'drop')) AS may FROM a),
        g AS (SELECT id, agent, seen, 0 AS grant_ FROM m WHERE may AND level IN ('HIGH', 'CRITICAL') AND action <> 'drop' AND resource = 'production' AND action = 'deploy' UNION ALL SELECT NULL, user_id, ts, 1 FROM events WHERE event_type = 'purchase'),
        l AS (SELECT id, lag(grant_) OVER (PARTITION BY agent ORDER BY seen, grant_ DESC, id) AS before FROM g)
        SELECT m.id, CASE WHEN NOT known OR NOT may THEN 'denied' WHEN level = 'CRITICAL' AND action = 'drop' THEN 'blocked' WHEN level NOT IN ('HIGH', 'CRITICAL') OR before = 1 THEN 'allowed' ELSE 'pending' END AS decision,
               CASE WHEN NOT known THEN 'CRITICAL' ELSE level END AS level FROM m LEFT JOIN l ON l.id = m.id""",
    "flight_questions": """SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'tools' ELSE 'why' END AS question FROM events WHERE user_id = 13
        UNION ALL SELECT event_id, 'filter' FROM events WHERE user_id = 12""",
    "task_snapshots": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS task_id, event_type AS state, ts AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT task_id, state, "at" FROM r WHERE k = 1""",
    "task_steps": """WITH s AS (SELECT user_id AS task_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'ANALYZING' WHEN 'click' THEN 'PLANNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS state FROM events),
        p AS (SELECT *, lead(state) OVER (PARTITION BY task_id ORDER BY seq) AS following FROM s)
        SELECT task_id, seq, state, following FROM p WHERE following IS NOT NULL AND NOT ((state = 'CREATED' AND following IN ('ANALYZING', 'FAILED')) OR (state = 'ANALYZING' AND following IN ('PLANNING', 'COMPLETED', 'FAILED'))
            OR (state = 'PLANNING' AND following IN ('COMPLETED', 'FAILED')) OR (state = 'FAILED' AND following = 'ANALYZING'))""",
    "agent_comparison": """WITH a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS task_id, event_type AS agent, round(100 - 10 * round(avg(value) / 100, 4) - 0.001 * count(*) - 20.0 * count(*) FILTER (WHERE value > 400), 6) AS score FROM events GROUP BY 1, 2),
        b AS (SELECT task_id, max(score) AS best, count(*) AS agents FROM a GROUP BY 1)
        SELECT b.task_id, CASE WHEN count(*) > 1 THEN 'tie' ELSE min(agent) END AS winner, best, agents FROM b JOIN a ON a.task_id = b.task_id AND score = best GROUP BY b.task_id, best, agents""",
    "runtime_graph": """SELECT * FROM (SELECT 'service' AS kind, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'service-health', count(DISTINCT user_id) FROM events UNION ALL SELECT 'monitors', count(DISTINCT user_id) FROM events
        UNION ALL SELECT 'deployment', count(*) FROM events WHERE event_type = 'signup' UNION ALL SELECT 'deploys', count(*) FROM events WHERE event_type = 'signup'
        UNION ALL SELECT 'error', count(DISTINCT (user_id, ts)) FROM events WHERE event_type = 'error' UNION ALL SELECT 'occurred_in', count(DISTINCT (user_id, ts)) FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'caused_by', count(DISTINCT (user_id, ts)) FROM events WHERE event_type = 'error' AND value > 300) WHERE n > 0""",
    "incident_hypotheses": """WITH a AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'error'), e AS (SELECT user_id, ts, 'src/' || CAST(floor(value / 50) AS BIGINT) AS file FROM events WHERE event_type = 'error'),
        named AS (SELECT DISTINCT id, file FROM a JOIN e ON a.user_id = e.user_id AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL 30 MINUTE),
        dep AS (SELECT a.id, s.event_id AS sha, 'src/' || CAST(floor(s.value / 50) AS BIGINT) AS file FROM a JOIN events s ON s.event_type = 'signup' AND a.user_id = s.user_id AND s.ts <= a.ts AND s.ts >= a.ts - INTERVAL 30 MINUTE),
        one AS (SELECT dep.id, 'deploy' AS source, dep.sha, CASE WHEN named.file IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS score, CASE WHEN named.file IS NULL THEN 'HYPOTHESIS' ELSE 'INFERENCE' END AS confidence FROM dep LEFT JOIN named ON dep.id = named.id AND dep.file = named.file),
        two AS (SELECT id, 'memory' AS source, 0 AS sha, 0.6::DOUBLE AS score, 'INFERENCE' AS confidence FROM a WHERE user_id = 13),
        f AS (SELECT * FROM one UNION ALL SELECT * FROM two), c AS (SELECT id, 'code' AS source, 0 AS sha, 0.5::DOUBLE AS score, 'INFERENCE' AS confidence FROM named WHERE id NOT IN (SELECT id FROM f)),
        u AS (SELECT * FROM f UNION ALL SELECT * FROM c) SELECT id, source, score, confidence, row_number() OVER (PARTITION BY id ORDER BY score DESC, source) AS rank FROM u""",
    "threshold_calibration": """WITH d AS (SELECT n_chars / 1000.0 AS risk, quality AS truth FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
        t AS (SELECT unnest([0.5, 1.0, 2.0, 4.0, 8.0]::DOUBLE[]) AS threshold)
        SELECT threshold, round(count(*) FILTER (WHERE risk >= threshold AND truth = 1) / (count(*) FILTER (WHERE truth = 1))::DOUBLE, 6) AS recall, count(*) FILTER (WHERE risk >= threshold) AS flagged FROM d, t GROUP BY threshold""",
    "context_gc_actions": """WITH i AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS digest, least(1.0::DOUBLE, CASE WHEN contains(lower(text), 'thing') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 0.05::DOUBLE ELSE 0 END
            + CASE WHEN contains(lower(text), 'from') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'that') THEN 0.05::DOUBLE ELSE 0 END + CASE doc_id % 4 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE 0 END
            + CASE WHEN 36 - doc_id % 48 < 1 THEN 0.1::DOUBLE WHEN 36 - doc_id % 48 < 24 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN lang = 'en' THEN 0.1::DOUBLE ELSE 0 END) AS s FROM documents),
        f AS (SELECT digest, min(id) AS first FROM i GROUP BY digest),
        g AS (SELECT i.id, round(CASE WHEN i.id = f.first THEN s ELSE s * 0.3::DOUBLE END, 6) AS score FROM i JOIN f ON i.digest = f.digest), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM g)
        SELECT id, score, CASE WHEN k <= 100 THEN CASE WHEN score < 0.2 THEN 'COMPRESS' ELSE 'KEEP' END WHEN score < 0.1 THEN 'DROP' WHEN score < 0.3 THEN 'ARCHIVE' ELSE 'DEMOTE' END AS action FROM r""",
    "context_packets": f"SELECT source AS packet, count(*) AS items, sum({TOKENS}) AS tokens, count(DISTINCT lang) AS classes, count(DISTINCT doc_id % 3) AS sources FROM documents GROUP BY 1",
    "greedy_pack": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, {TOKENS} AS tokens, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
        r AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS path, 0::BIGINT AS tokens, false AS taken, 0::BIGINT AS before, 0::BIGINT AS used
              UNION ALL SELECT d.k, d.path, d.tokens, r.used + d.tokens <= 19800, r.used, r.used + CASE WHEN r.used + d.tokens <= 19800 THEN d.tokens ELSE 0 END FROM r JOIN d ON d.k = r.k + 1)
        SELECT path, tokens, taken, before FROM r WHERE k > 0""",
    "change_intents": """WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, array_to_string(list_filter(['add', 'remove', 'delete', 'refactor', 'fix', 'update', 'test', 'implement', 'migrate', 'optimize', 'rename'], lambda v: contains(t, v)), ',') AS verbs,
               array_to_string(list_filter([CASE WHEN regexp_matches(t, 'add|implement') THEN 'feature' END, CASE WHEN regexp_matches(t, 'fix') THEN 'bugfix' END, CASE WHEN regexp_matches(t, 'refactor|rename|migrate') THEN 'refactor' END,
                   CASE WHEN regexp_matches(t, 'test') THEN 'test' END, CASE WHEN regexp_matches(t, 'doc|readme') THEN 'docs' END, CASE WHEN regexp_matches(t, 'config|yaml|json') THEN 'config' END], lambda x: x IS NOT NULL), ',') AS categories FROM c""",
    "task_routing": """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'incident|correlate|root-cause|alert') THEN 'incident' WHEN regexp_matches(lower(text), 'modernize|refactor|extract|split-monolith') THEN 'modernization'
        WHEN regexp_matches(lower(text), 'document|docs|readme') THEN 'documentation' ELSE 'code' END AS kind, CASE turn % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE 'small' END AS tier FROM conversations""",
    "freshness_states": "SELECT CASE WHEN ts IS NULL THEN 'UNKNOWN' WHEN ts >= TIMESTAMP '2024-01-05' - INTERVAL 24 HOUR THEN 'FRESH' ELSE 'STALE' END AS state, count(*) AS n FROM events GROUP BY 1",
    "session_windows": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
        s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
        n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
    "schema_validation": """WITH v AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, CASE WHEN k IS NULL THEN '$.k: missing required field' ELSE '$.k: over max 50' END AS violation FROM v WHERE k IS NULL OR k > 50""",
    "json_equality": "SELECT a.event_id FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k')",
}
