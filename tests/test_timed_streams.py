"""Streams with timers: idle keys go, bursts settle, old entries too."""

import json
from datetime import datetime, timedelta

import pytest

from talus.streaming import timed as T

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(T.PROVIDER)
    spark.conf.set(T.PROVIDER, T.ROCKS)
    yield spark
    spark.conf.set(T.PROVIDER, before)


class Feed:
    """Batches of rows, one at a time, through one query with a checkpoint."""

    def __init__(self, spark, folder, schema, make, delay="0 seconds"):
        self.spark, self.folder, self.schema, self.make, self.delay = spark, folder, schema, make, delay
        self.n = 0

    def give(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.folder}/in/b{self.n}")
        out = []
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in").withWatermark("at", self.delay)
        query = self.make(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{self.folder}/check").trigger(availableNow=True).start()
        query.awaitTermination(180)
        return sorted(out, key=repr)


def test_idle_tasks_go(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "key string, seq long, at timestamp, state string", lambda s: T.tasks(s, 100))
    assert feed.give(("a", 1, at(0), "ANALYZING"), ("b", 1, at(0), "ANALYZING"), (None, 1, at(0), "ANALYZING"), ("c", 1, None, "ANALYZING")) == [("a", 1, "CREATED", "ANALYZING", True), ("b", 1, "CREATED", "ANALYZING", True)]
    # b goes on, which moves its timer; a falls silent.
    assert feed.give(("b", 2, at(90), "PLANNING")) == [("b", 2, "ANALYZING", "PLANNING", True)]
    gone = feed.give(("d", 1, at(150), "ANALYZING"))
    assert ("a", None, "ANALYZING", None, None) in gone and ("d", 1, "CREATED", "ANALYZING", True) in gone and len(gone) == 2
    # a begins anew, b is still where it was, and has gone once its own time is over.
    assert ("a", 2, "CREATED", "CREATED", False) in feed.give(("a", 2, at(160), "PLANNING"))
    last = feed.give(("e", 1, at(1000), "ANALYZING"))
    assert {r[0] for r in last if r[1] is None} == {"a", "b", "d"} and ("b", None, "PLANNING", None, None) in last


def test_finished_tasks_leave_no_timer(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "key string, seq long, at timestamp, kind string", lambda s: T.incidents(s, 50))
    got = feed.give(("i", 1, at(0), "alert"), ("i", 2, at(1), "resolved"), ("j", 1, at(1), "alert"), ("j", 2, at(2), "nonsense"))
    assert [r[3] for r in got] == ["OPEN", "CLOSED", "OPEN"]
    assert feed.give(("k", 1, at(500), "alert")) == [("j", None, "OPEN", None, None), ("k", 1, "NONE", "OPEN", True)]


def test_debounce_by_timer(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "root string, path string, change string, at timestamp", lambda s: T.debounced(s, 5))
    assert feed.give(("r", "a.py", "modified", at(0)), ("r", "b.py", "added", at(3)), ("q", "z", "added", at(1))) == []
    # r changes again before it has been quiet for long enough; q has been.
    settled = feed.give(("r", "a.py", "removed", at(7)))
    assert settled == [("q", at(1), at(1), 1, json.dumps({"z": "added"}))]
    assert feed.give(("other", None, None, at(60))) == [("r", at(0), at(7), 3, json.dumps({"a.py": "removed", "b.py": "added"}))]
    assert feed.give(("r", "c.py", "added", at(61)), ("x", "y", "added", at(200)))[-1] != []


def test_prompts_of_idle_sessions(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "session string, at timestamp, text string", lambda s: T.captured(s, 60, 300))
    assert [r[2] for r in feed.give(("s", at(0), "a"), ("s", at(30), "b"), ("s", at(70), "c"))] == ["a", "c"]
    assert feed.give(("s", at(140), "c")) == []
    feed.give(("t", at(600), "x"))
    assert [r[2] for r in feed.give(("s", at(601), "c"))] == ["c"]  # the session was forgotten


def test_history_of_idle_kinds(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "kind string, seq long, payload string, at timestamp", lambda s: T.history(s, 3, 100))
    got = lambda rows: {r[0]: [(e["seq"], e["payload"]) for e in json.loads(r[1])] for r in rows}
    assert got(feed.give(*(("k", n, "x" * (5000 if n == 3 else 1), at(n)) for n in range(4)))) == {"k": [(1, "x"), (2, "x"), (3, None)]}
    assert got(feed.give(("k", 4, "y", at(40)))) == {"k": [(2, "x"), (3, None), (4, "y")]}
    feed.give(("other", 1, "o", at(300)))
    assert got(feed.give(("k", 5, "z", at(310)))) == {"k": [(5, "z")]}


def test_needs_rocksdb(spark, tmp_path):
    spark.createDataFrame([("r", "p", "c", at(0))], "root string, path string, change string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("root string, path string, change string, at timestamp").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="RocksDB"):
        T.debounced(stream)
