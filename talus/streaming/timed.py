"""Streams with timers: state that goes when its key falls silent.

Each operator keeps a few values a key with ``transformWithStateInPandas`` and a timer in event time: a
row moves its key's timer on, and once the watermark has passed it the state is removed, for debounced
bursts after their result.

The session must keep its state in RocksDB (``spark.sql.streaming.stateStore.providerClass``), as timers need; a
session that does not gets an error. The caller sets the watermark of ``at`` with ``withWatermark``.

Defined cases: rows whose key or ``at`` is null are left out; rows of one batch are taken by (at, seq);
rows later than the watermark may find their key's state gone, and then begin anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from talus.operators.incidents import INCIDENT_STATES, TASK_STEPS
from talus.streaming.state import GAP, INCIDENT_MOVES, KEPT, PAYLOAD

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HOUR, DAY = 3600, 86400
STEP = "key string, seq long, before string, state string, legal boolean"


def millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class Timed(StatefulProcessor):
    """State with one timer a key: ``idle`` seconds after its latest row in event time."""

    idle = HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def end(self, key: tuple) -> pd.DataFrame | None:
        """What a silent key leaves behind; its state is removed after this."""
        return None

    def forget(self) -> None:
        raise NotImplementedError

    def set_timer(self, latest: int) -> None:
        due = latest + int(self.idle * 1000)
        if self.due.exists():
            (before,) = self.due.get()
            if due <= before:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(due)
        self.due.update((due,))

    def drop(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.clear()
        self.forget()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows))
        part = part.sort_values([c for c in ("at", "seq") if c in part.columns], kind="stable")
        self.set_timer(millis(part["at"].max()))
        yield self.step(key, part)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = self.end(key)
        self.due.clear()
        self.forget()
        if left is not None:
            yield left

    def close(self) -> None:
        pass


def by_key(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    if rows.sparkSession.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"timers need {PROVIDER}={ROCKS}")
    kept = rows.where(F.col(key).isNotNull() & F.col("at").isNotNull())
    return kept.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Machine(Timed):
    """Moves (key, seq, at, state) of a state machine."""

    def __init__(self, start: str, legal: Callable[[str, str], bool], ends: set[str], idle: float):
        self.start, self.legal, self.ends, self.idle = start, legal, ends, idle

    def begin(self, handle):
        self.now = handle.getValueState("now", "state string")

    def step(self, key, rows):
        now, out = (self.now.get()[0] if self.now.exists() else self.start), []
        for seq, wanted in zip(rows["seq"].tolist(), rows["state"].tolist(), strict=True):
            ok = self.legal(now, wanted)
            out.append((key[0], seq, now, wanted if ok else now, ok))
            now = wanted if ok else now
        if now in self.ends:
            self.drop()
        else:
            self.now.update((now,))
        return pd.DataFrame(out, columns=["key", "seq", "before", "state", "legal"])

    def end(self, key):
        """An abandoned key leaves one row: the state that it was in, without a number or a next state."""
        return pd.DataFrame({"key": [key[0]], "seq": pd.array([None], "Int64"), "before": [self.now.get()[0]], "state": [None], "legal": [None]}) if self.now.exists() else None

    def forget(self):
        self.now.clear()


def tasks(moves: DataFrame, idle: float = DAY) -> DataFrame:
    """Rows STEP of tasks (key, seq, at, state) by their table of states; abandoned ones after ``idle`` seconds."""
    table = {k: set(v.split()) for k, v in TASK_STEPS.items()}
    machine = Machine("CREATED", lambda now, to: to in table.get(now, ()), {"COMPLETED", "CANCELLED", "REJECTED", "ROLLED_BACK"}, idle)
    return by_key(moves.select("key", "seq", "at", "state"), "key", machine, STEP)


def incidents(events: DataFrame, idle: float = DAY) -> DataFrame:
    """Rows STEP of incidents (key, seq, at, kind): they only move on, and close from any state."""
    order = {s: k for k, s in enumerate(INCIDENT_STATES)}
    kind = F.create_map(*(F.lit(x) for pair in INCIDENT_MOVES.items() for x in pair))[F.col("kind")]
    moves = events.select("key", "seq", "at", kind.alias("state")).where("state is not null")
    return by_key(moves, "key", Machine("NONE", lambda now, to: order[to] > order.get(now, -1), {"CLOSED"}, idle), STEP)


class Prompts(Timed):
    def __init__(self, gap: float, idle: float):
        self.gap, self.idle = gap, max(gap, idle)

    def begin(self, handle):
        self.last = handle.getValueState("last", "text string, ms long")

    def step(self, key, rows):
        text, ms = self.last.get() if self.last.exists() else (None, None)
        out = []
        for at, said in zip(rows["at"], rows["text"], strict=True):
            if ms is None or (said != text and millis(at) - ms >= self.gap * 1000):
                out.append((key[0], at, said))
                text, ms = said, millis(at)
        if out:
            self.last.update((text, ms))
        return pd.DataFrame(out, columns=["session", "at", "text"])

    def forget(self):
        self.last.clear()


def captured(prompts: DataFrame, gap: float = GAP, idle: float = DAY) -> DataFrame:
    """Prompts (session, at, text) that are kept: not equal to the last one kept, and ``gap`` seconds after it;
    a session silent for ``idle`` seconds is forgotten."""
    return by_key(prompts.select("session", "at", "text"), "session", Prompts(gap, idle), "session string, at timestamp, text string")


class Burst(Timed):
    def __init__(self, quiet: float):
        self.idle = quiet

    def begin(self, handle):
        self.paths = handle.getMapState("paths", "path string", "change string")
        self.span = handle.getValueState("span", "first long, last long, n long")

    def step(self, key, rows):
        first, last, n = self.span.get() if self.span.exists() else (millis(rows["at"].min()), 0, 0)
        for path, change in zip(rows["path"], rows["change"], strict=True):
            self.paths.updateValue((path,), (change,))
        self.span.update((first, max(last, millis(rows["at"].max())), n + len(rows)))
        return pd.DataFrame(columns=["root", "first", "last", "changes", "paths"])

    def end(self, key):
        first, last, n = self.span.get()
        held = sorted((k[0], v[0]) for k, v in self.paths.iterator())
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame({"root": [key[0]], "first": [at(first)], "last": [at(last)], "changes": [n], "paths": [json.dumps(dict(held))]})

    def forget(self):
        self.paths.clear()
        self.span.clear()


def debounced(changes: DataFrame, quiet: float = 1.0) -> DataFrame:
    """(root, first, last, changes, paths) of changes (root, path, change, at): one row a burst, once its root has
    been quiet for ``quiet`` seconds; paths is a JSON object of each path's latest change."""
    path = F.coalesce("path", F.lit(""))
    return by_key(changes.select("root", path.alias("path"), F.coalesce("change", F.lit("")).alias("change"), "at"), "root", Burst(quiet), "root string, first timestamp, last timestamp, changes long, paths string")


class History(Timed):
    def __init__(self, most: int, idle: float):
        self.most, self.idle = most, idle

    def begin(self, handle):
        self.held = handle.getListState("held", "seq long, payload string")

    def step(self, key, rows):
        new = [(int(s), None if p is None or len(p.encode()) > PAYLOAD else p) for s, p in zip(rows["seq"], rows["payload"], strict=True)]
        held = sorted([*(tuple(e) for e in self.held.get()), *new], key=lambda e: e[0])[-self.most :]
        self.held.put(held)
        return pd.DataFrame({"kind": [key[0]], "entries": [json.dumps([{"seq": s, "payload": p} for s, p in held])]})

    def forget(self):
        self.held.clear()


def history(events: DataFrame, most: int = KEPT, idle: float = DAY) -> DataFrame:
    """(kind, entries): the last events (kind, seq, payload, at) of each kind as a JSON list, after each batch;
    payloads over 4 KiB are left out. A kind silent for ``idle`` seconds starts anew."""
    return by_key(events.select("kind", "seq", "payload", "at"), "kind", History(most, idle), "kind string, entries string")
