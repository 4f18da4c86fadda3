"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of all rows, which keeps every
cosine. Rows are ordered by (group, leading coordinates) and cut into blocks of at most
``block`` rows, so a hot group fills many blocks. Two blocks of a group meet where the
boxes of their leading coordinates share a cell of a grid, unless they lie too far apart for
the threshold. Rows are scaled and rotated once, when they are packed.
Inside a tile the product is accumulated over leading dimensions first; after each
step the product of the suffix norms bounds what can still come, and pairs that
cannot reach the threshold stop there; a tile in which none can is left. A tile returns
a link count a row and a spanning forest of its links, never the pairs.

Only rows of one group (label and dimension) are compared. Defined cases: a null
label, a null, empty or zero vector, or one with null, NaN or infinite components links
with nothing; rows that repeat a vec_id are vectors of their own; a null vec_id
takes part and never names a component unless all its members are null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.scratch import Scratch, components, ranked

LEAD = 4  # coordinates that order rows and bound boxes
SLACK = 1e-9  # by which bounds are loosened against rounding
STEPS = (8, 16, 32)  # dimensions after which the bound is applied


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """dimension -> principal axes of the unit vectors of that dimension, from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in by_dimension(batch.column(0)):
                u = unit(x[1])
                total[dim] = total.get(dim, 0) + u.T @ u
        for dim, m in total.items():
            n = dim * dim
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.arange(n), pa.int64()), pa.array(m.ravel())], ["dim", "at", "v"])

    got = rows.select("embedding").mapInArrow(run, "dim int, at long, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).toPandas()  # dim * dim numbers
    out = {}
    for dim, part in got.groupby("dim"):
        m = np.zeros(dim * dim)
        m[part["at"]] = part["v"]
        value, vector = np.linalg.eigh(m.reshape(dim, dim))
        out[int(dim)] = vector[:, ::-1]
    return out


def by_dimension(column: pa.ListArray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(dimension, (row numbers, matrix)) for the vectors of a column."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), (at, flat[(ends[at] - dim)[:, None] + np.arange(dim)])


def links(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (rotated unit vectors) whose cosine
    is at least ``least``; of one block with itself, i < j only."""
    dim = a.shape[1]
    steps = [s for s in STEPS if s < dim] + [dim]
    i = j = part = None
    start = 0
    for end in steps:
        rest = np.sqrt(np.maximum((a[:, end:] ** 2).sum(axis=1), 0)), np.sqrt(np.maximum((b[:, end:] ** 2).sum(axis=1), 0))
        bar = least - (SLACK if end < dim else 0)
        if i is None:  # still dense
            part = a[:, start:end] @ b[:, start:end].T if part is None else part + a[:, start:end] @ b[:, start:end].T
            may = part + np.multiply.outer(*rest) >= bar
            if same:
                may = np.triu(may, 1)
            n = int(may.sum())
            if not n:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if n * 8 < may.size or end == dim:
                i, j = np.nonzero(may)
                part = part[i, j]
        else:
            part = part + np.einsum("ij,ij->i", a[i, start:end], b[j, start:end])
            may = part + rest[0][i] * rest[1][j] >= bar
            i, j, part = i[may], j[may], part[may]
        start = end
    return i, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest vertex reachable by the links (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_duplicates(scratch: Scratch, vectors: DataFrame, least: float = 0.93, block: int = 1024, key: str = "vec_id", group: str = "label") -> DataFrame:
    """One row per input row: ``key``, n_links, component_id, kept."""
    base = scratch.save(vectors.select(key, F.col(group).alias("g"), "embedding").withColumn("uid", F.monotonically_increasing_id()))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = base.where(F.col("g").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    turn = axes(good)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, LEAD))
            for dim, (at, x) in by_dimension(batch.column(1)):
                head = unit(x) @ turn[dim][:, :LEAD]
                out[at, : head.shape[1]] = head
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(LEAD))], ["uid", *(f"c{k}" for k in range(LEAD))])

    names = [f"c{k}" for k in range(LEAD)]
    heads = good.select("uid", "embedding").mapInArrow(lead, "uid long, " + ", ".join(f"{n} double" for n in names))
    heads = heads.join(good.select("uid", "g", F.size("embedding").alias("dim")), "uid")
    cell = lambda n: F.floor(F.col(n) / 0.15)
    order = ranked(scratch, heads.withColumn("k0", cell("c0")).withColumn("k1", cell("c1")), F.col("g"), F.col("dim"), F.col("k0"), F.col("k1"), F.col("c2"), F.col("uid"))
    order = scratch.save(order.withColumn("block", F.floor(F.col("rank") / block)).select("uid", "g", "dim", "block", *names))
    boxes = order.groupBy("g", "dim", "block").agg(*(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)))

    def pack(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        turned = unit(np.stack(rows["embedding"].to_numpy())) @ turn[k[1]]
        return pd.DataFrame({"g": [k[0]], "dim": [k[1]], "block": [k[2]], "uids": [rows["uid"].to_numpy(np.int64).tobytes()], "data": [turned.tobytes()]})

    gtype = vectors.schema[group].dataType.simpleString()
    packed = order.select("uid", "g", "dim", "block").join(good.select("uid", "embedding"), "uid")
    packed = scratch.save(packed.groupBy("g", "dim", "block").applyInPandas(pack, f"g {gtype}, dim int, block long, uids binary, data binary"))
    reach = float(np.sqrt(2 * (1 - least) + SLACK))  # linked rows are no farther apart
    spots = lambda n, wide: F.explode(F.sequence(F.floor((F.col(f"min_{n}") - wide) / reach), F.floor((F.col(f"max_{n}") + wide) / reach))).alias(f"at_{n}")
    boxes = scratch.save(boxes)
    a = boxes.select("*", spots("c0", 0.0)).select("*", spots("c1", 0.0)).alias("a")  # cells of the leading two coordinates
    b = boxes.select("*", spots("c0", reach)).select("*", spots("c1", reach)).alias("b")
    gaps = [F.greatest(F.lit(0.0), F.col(f"a.min_{n}") - F.col(f"b.max_{n}"), F.col(f"b.min_{n}") - F.col(f"a.max_{n}")) for n in names]
    near = sum((x * x for x in gaps), F.lit(0.0)) <= 2 * (1 - least) + SLACK
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("g", "dim", "at_c0", "at_c1")]
    pairs = a.join(b, reduce(and_, [*same, F.col("a.block") <= F.col("b.block"), near]))
    pairs = pairs.select("a.g", "a.dim", F.col("a.block").alias("left"), F.col("b.block").alias("right")).distinct()
    side = lambda s: packed.select("g", "dim", F.col("block").alias(s), F.col("uids").alias(f"{s}_uids"), F.col("data").alias(f"{s}_data"))
    tiles = pairs.join(side("left"), ["g", "dim", "left"]).join(side("right"), ["g", "dim", "right"])

    def compare(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            ua, ub = np.frombuffer(r.left_uids, np.int64), np.frombuffer(r.right_uids, np.int64)
            same = r.left == r.right
            x = np.frombuffer(r.left_data).reshape(len(ua), r.dim)
            y = x if same else np.frombuffer(r.right_data).reshape(len(ub), r.dim)
            i, j = links(x, y, least, same)
            if not len(i):
                continue
            at = j if same else j + len(ua)
            uids = ua if same else np.concatenate([ua, ub])
            n = np.bincount(i, minlength=len(uids)) + np.bincount(at, minlength=len(uids))
            low = forest(i, at, len(uids))
            met = np.flatnonzero(n)
            out.append(pd.DataFrame({"a": uids[met], "b": uids[low[met]], "n": n[met]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})

    found = scratch.save(tiles.groupBy("g", "dim", "left", "right").applyInPandas(compare, "a long, b long, n long"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "uid")
    groups = components(scratch, found.select("a", "b")).withColumnRenamed("id", "uid")
    rows = base.select(key, "uid").join(counts, "uid", "left").join(groups, "uid", "left")
    rows = scratch.save(rows.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "uid").alias("component")))
    names = rows.groupBy("component").agg(F.min(key).alias("component_id"))
    out = rows.join(names, "component")
    return out.select(key, "n_links", "component_id", F.expr(f"{key} <=> component_id").alias("kept"))
