"""Streaming forms against the batch results, over a file stream."""

from pyspark.sql import functions as F

from talus.streaming import events as S
from talus.streaming import state as ST

SF = "/root/testdata/sf0.001"


def drained(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def test_health(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = drained(spark, S.windowed_health(stream), "health", "complete")
    assert got.agg(F.sum("events")).first()[0] == batch.count()
    assert got.agg(F.sum("errors")).first()[0] == batch.where("event_type = 'error'").count()


def test_first_seen(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = drained(spark, S.first_seen(stream, ["event_type"], "60 days"), "first_seen")
    assert got.count() == batch.select("event_type").distinct().count()


def run(spark, tmp_path, rows, schema, make, mode="append"):
    """Feeds each list of rows as one batch and returns what the stream made."""
    source, out = str(tmp_path / "in"), []
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/b{k}")
        stream = make(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source))
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return out


def test_task_machine(spark, tmp_path):
    rows = [[("a", 1, "ANALYZING"), ("b", 1, "EXECUTING")], [("a", 2, "PLANNING"), ("a", 3, "COMPLETED"), ("b", 2, "VERIFYING")]]
    got = run(spark, tmp_path, rows, "key string, seq long, state string", ST.tasks)
    assert {(r["key"], r["seq"], r["before"], r["state"], r["legal"]) for r in got} == {
        ("a", 1, "CREATED", "ANALYZING", True), ("b", 1, "CREATED", "CREATED", False), ("a", 2, "ANALYZING", "PLANNING", True), ("a", 3, "PLANNING", "COMPLETED", True), ("b", 2, "CREATED", "VERIFYING", True),
    }


def test_incident_machine_and_history(spark, tmp_path):
    rows = [[("i", 1, "alert"), ("i", 2, "root_cause")], [("i", 3, "correlated"), ("i", 4, "resolved")]]
    got = run(spark, tmp_path / "m", rows, "key string, seq long, kind string", ST.incidents)
    assert [(r["seq"], r["state"], r["legal"]) for r in sorted(got, key=lambda r: r["seq"])] == [(1, "OPEN", True), (2, "ROOT_CAUSE_FOUND", True), (3, "ROOT_CAUSE_FOUND", False), (4, "CLOSED", True)]
    import json

    events = [[("k", s, "x" * (5000 if s == 2 else 1)) for s in range(3)], [("k", s, "y") for s in range(3, 6)]]
    last = run(spark, tmp_path / "h", events, "kind string, seq long, payload string", lambda s: ST.history(s, 4), "update")[-1]
    assert [(e["seq"], e["payload"]) for e in json.loads(last["entries"])] == [(2, None), (3, "y"), (4, "y"), (5, "y")]


def test_captured_prompts(spark, tmp_path):
    from datetime import datetime, timedelta

    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [[("s", t(0), "a"), ("s", t(30), "b")], [("s", t(70), "a"), ("s", t(80), "c"), ("s", t(140), "c")]]
    got = run(spark, tmp_path, rows, "session string, at timestamp, text string", ST.captured)
    assert [(r["at"], r["text"]) for r in sorted(got, key=lambda r: r["at"])] == [(t(0), "a"), (t(80), "c")]


def test_fan_out_and_watch(spark, tmp_path):
    seen = {"error": [], "*": []}
    spark.createDataFrame([("error", 1), ("log", 2)], "kind string, n long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, n long").parquet(str(tmp_path / "in"))
    sinks = {k: (lambda df, _, k=k: seen[k].extend(r["n"] for r in df.collect())) for k in seen}
    ST.fan_out(stream, sinks, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen["error"] == [1] and sorted(seen["*"]) == [1, 2]
    changes = []
    spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string").write.parquet(str(tmp_path / "list"))
    listings = spark.readStream.schema("path string, hash string").parquet(str(tmp_path / "list"))
    current = lambda: spark.createDataFrame([("a", "0"), ("c", "3")], "path string, hash string")
    ST.watched(listings, current, lambda df, _: changes.extend(map(tuple, df.collect())), str(tmp_path / "w")).trigger(availableNow=True).start().awaitTermination(120)
    assert set(changes) == {("a", "modified"), ("b", "added"), ("c", "removed")}
    shot = ST.Snapshot(lambda: spark.range(1))
    first = shot.get()
    assert shot.get() is first
    shot.refresh()
    assert shot.get() is not first and shot.version == 1
