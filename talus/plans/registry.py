"""Name -> query and name -> oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from talus.plans import events, graph, index, texts

PARTS = (graph, texts, events, index)
QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in PARTS for k, v in p.ORACLES.items()}
