"""Streams with state of their own: state machines, bounded history, rate limits, topic fan-out, watched folders.

State is a few values a key, kept by ``applyInPandasWithState``; keys go when they end or time out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talus.operators.graph import manifest_diff
from talus.operators.incidents import INCIDENT_STATES, TASK_STEPS

KEPT, PAYLOAD, GAP = 100, 4096, 60
STEP = "key string, seq long, before string, state string, legal boolean"
#: What moves an incident on, by the kind of event.
INCIDENT_MOVES = {"alert": "OPEN", "correlated": "INVESTIGATING", "root_cause": "ROOT_CAUSE_FOUND", "proposed": "FIX_PROPOSED", "approved": "FIX_APPROVED", "verified": "FIX_VERIFIED", "pr": "PR_CREATED", "resolved": "CLOSED"}


def machine(moves: DataFrame, start: str, legal: Callable[[str, str], bool], ends: set[str]) -> DataFrame:
    """Rows STEP of moves (key, seq, state): each with the state before it and whether it may follow; a
    move that may not leaves the state as it is. Keys in an end state are forgotten."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, wanted in zip(rows["seq"].tolist(), rows["state"].tolist(), strict=True):
            ok = legal(now, wanted)
            out.append((key[0], seq, now, wanted if ok else now, ok))
            now = wanted if ok else now
        if now in ends:
            state.remove()
        else:
            state.update((now,))
        yield pd.DataFrame(out, columns=["key", "seq", "before", "state", "legal"])

    return moves.groupBy("key").applyInPandasWithState(run, STEP, "state string", "append", GroupStateTimeout.NoTimeout)


def tasks(moves: DataFrame) -> DataFrame:
    """Tasks by their table of states; they start as CREATED."""
    table = {k: set(v.split()) for k, v in TASK_STEPS.items()}
    return machine(moves, "CREATED", lambda now, to: to in table.get(now, ()), {"COMPLETED", "CANCELLED", "REJECTED", "ROLLED_BACK"})


def incidents(events: DataFrame) -> DataFrame:
    """Incidents (key, seq, kind): they only move on, and close from any state."""
    order = {s: k for k, s in enumerate(INCIDENT_STATES)}
    kind = F.create_map(*(F.lit(x) for pair in INCIDENT_MOVES.items() for x in pair))[F.col("kind")]
    moves = events.select("key", "seq", kind.alias("state")).where("state is not null")
    return machine(moves, "NONE", lambda now, to: order[to] > order.get(now, -1), {"CLOSED"})


def history(events: DataFrame, most: int = KEPT) -> DataFrame:
    """(kind, entries): the last events (kind, seq, payload) of each kind as a JSON list, after each batch;
    payloads over 4 KiB are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for part in batches:
            held += [{"seq": s, "payload": None if p is None or len(p.encode()) > PAYLOAD else p} for s, p in zip(part["seq"].tolist(), part["payload"].tolist(), strict=True)]
        text = json.dumps(sorted(held, key=lambda e: e["seq"])[-most:])
        state.update((text,))
        yield pd.DataFrame({"kind": [key[0]], "entries": [text]})

    return events.select("kind", "seq", "payload").groupBy("kind").applyInPandasWithState(run, "kind string, entries string", "held string", "update", GroupStateTimeout.NoTimeout)


def captured(prompts: DataFrame, gap: int = GAP) -> DataFrame:
    """Prompts (session, at, text) that are kept: not equal to the last one kept, and ``gap`` seconds after it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_text, last_at = state.get if state.exists else (None, float("-inf"))
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, text in zip(rows["at"], rows["text"], strict=True):
            if text != last_text and at.timestamp() - last_at >= gap:
                out.append((key[0], at, text))
                last_text, last_at = text, at.timestamp()
        if out:
            state.update((last_text, last_at))
        yield pd.DataFrame(out, columns=["session", "at", "text"])

    return prompts.groupBy("session").applyInPandasWithState(run, "session string, at timestamp, text string", "text string, at double", "append", GroupStateTimeout.NoTimeout)


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """One query over a stream of events (kind, ...): each batch goes to the sinks of its kinds ('*':
    all). A sink may be a webhook's client; it gets rows, and repeats only when a batch is repeated."""

    def each(batch: DataFrame, number: int) -> None:
        for kind, sink in sinks.items():
            sink(batch if kind == "*" else batch.where(F.col("kind") == kind), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def watched(listings: DataFrame, current: Callable[[], DataFrame], changed: Callable[[DataFrame, int], None], checkpoint: str, settle: str = "1 second"):
    """Runs ``changed`` with (path, change) whenever listings (path, hash) that pollers write differ from
    the current manifest; the trigger's interval lets a burst of changes settle."""

    def each(batch: DataFrame, number: int) -> None:
        diff = manifest_diff(current(), batch.select("path", "hash"))
        if not diff.isEmpty():
            changed(diff, number)

    return listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=settle)


class Snapshot:
    """A table that is read again after a change: one version for all who ask between two refreshes."""

    def __init__(self, read: Callable[[], DataFrame]):
        self.read, self.version, self.held = read, 0, None

    def refresh(self) -> None:
        self.version, self.held = self.version + 1, None

    def get(self) -> DataFrame:
        if self.held is None:
            self.held = self.read()
        return self.held
