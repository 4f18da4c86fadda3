"""A stored index of vectors for nearest rows by cosine.

Centres are fitted by k-means on a bounded sample, in one task; every row goes to the list of its nearest centre.
A list is blocks of a fixed number of rows, so a crowded list is many blocks, and it knows how far its rows
are from the centre at most. A question looks through the lists of the nearest centres; that is the approximate
answer; how many lists is set when the index is built, by true neighbours of a bounded sample. The exact one then also reads the lists which, by the angle to the centre and their reach, may hold
something better than the worst of the rows found so far.

Defined cases: vectors that are null, zero or hold null or non-finite components are neither rows nor questions; a
row does not find itself (equal ids); of equal scores the smaller id comes first; fewer rows than asked for
are all rows; an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.retrieval import dense_top, top
from talus.shared import cut

#: Rows that centres are fitted on at most, centres at most, rows of a block, questions of a block.
SAMPLE, CENTRES, ROWS, ASKED = 20_000, 1_024, 2_048, 1_024
#: Rows (question, list) that a worker makes at once.
PAIRS = 1 << 14
#: Rows that stand as questions when the number of lists to look through is set, their neighbours, and the share of these that is to be found.
TUNED, NEIGHBOURS, FOUND = 256, 10, 0.95
#: Added to bounds: scores are rounded to six digits.
SLACK = 2e-6


def sound(vectors: DataFrame) -> DataFrame:
    """(id, vec) of the vectors that have a direction."""
    v = F.col("vec")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)))


def unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(vectors: DataFrame, n: int, sample: int = SAMPLE, centres: int = CENTRES, rounds: int = 12) -> np.ndarray:
    """Unit centres, about the root of ``n`` of them, by spherical k-means on ``sample`` rows, those of the least hash of
    their id; at most ``centres`` rows meet the driver."""
    k = max(1, min(centres, int(round(n**0.5))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts).sort_values("id") if parts else pd.DataFrame()
        if not len(rows):
            return
        x = unit(rows["vec"])
        c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-300), c)
        yield pd.DataFrame({"list": range(len(c)), "centre": list(c)})

    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vec").repartition(1)
    held = some.mapInPandas(run, "list int, centre array<double>").orderBy("list").collect()
    return np.array([r["centre"] for r in held]) if held else np.zeros((0, 1))


def tuned(given: DataFrame, dealt: DataFrame, c: np.ndarray) -> int:
    """How many of the nearest centres hold the share FOUND of the true neighbours of TUNED rows."""
    some = given.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TUNED).withColumnRenamed("id", "query")
    true = dense_top(given, some, NEIGHBOURS).select("query", "id").join(dealt.select("id", "list"), "id").join(some, "query").select("vec", "list")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                s = unit(part["vec"]) @ c.T
                mine = s[np.arange(len(s)), part["list"].to_numpy()]
                yield pd.DataFrame({"rank": (s > mine[:, None]).sum(axis=1) + 1})

    got = true.mapInPandas(run, "rank int").agg(F.percentile_approx("rank", FOUND, 10_000)).first()[0]
    return int(got or 1)


def build(vectors: DataFrame, path: str, sample: int = SAMPLE, centres: int = CENTRES, rows: int = ROWS) -> None:
    """Writes the index of vectors (id long, vec) to a folder: blocks (list, block, ids, data) and lists (list, centre,
    reach, blocks, probes), with the number of lists that a question looks through."""
    spark = vectors.sparkSession
    given = sound(vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    c = fitted(given, given.count(), sample, centres)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                s = unit(part["vec"]) @ c.T
                near = np.argmax(s, axis=1)
                yield pd.DataFrame({"id": part["id"], "vec": part["vec"], "list": near, "cos": s[np.arange(len(s)), near]})

    dealt = cut(given.mapInPandas(placed, "id long, vec array<double>, list int, cos double"))
    sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"), F.min("cos").alias("reach"))
    sizes = cut(sizes)  # one row a centre

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        return pd.DataFrame({"list": [key[0]], "block": [key[1]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "data": [unit(part["vec"]).tobytes()]})

    spread = dealt.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = spread.groupBy("list", "block").applyInPandas(packed, "list int, block int, ids binary, data binary")
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    centre = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(c)], "list int, centre array<double>")
    centre = centre.withColumn("probes", F.lit(tuned(given, dealt, c) if len(c) else 0))
    centre.join(sizes, "list").write.mode("overwrite").parquet(f"{path}/lists")


def by_list(part: pd.DataFrame, open_: np.ndarray, names: np.ndarray) -> Iterator[pd.DataFrame]:
    """(query, vec, list) of questions and whether a list is open to each, at most PAIRS rows at once."""
    i, j = np.nonzero(open_)
    for s in range(0, len(i), PAIRS):
        rows = part.iloc[i[s : s + PAIRS]]
        yield pd.DataFrame({"query": rows["query"].to_numpy(), "vec": rows["vec"].to_numpy(), "list": names[j[s : s + PAIRS]]})


def scored(asked: DataFrame, blocks: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(query, id, score): of questions with the list to look through (query, vec, list) the best ``k`` of each block.
    Questions of a list are packed, and each pack meets each block of the list once."""
    counts = lists.select("list", "blocks")
    packs = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("packs"))
    dealt = asked.join(packs, "list").withColumn("pack", F.pmod(F.xxhash64("query"), F.col("packs")).cast("int"))

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"list": [key[0]], "asked": [part["query"].to_numpy(np.int64).tobytes()], "vecs": [unit(part["vec"]).tobytes()]})

    left = dealt.groupBy("list", "pack").applyInPandas(packed, "list int, asked binary, vecs binary")
    left = left.join(F.broadcast(counts), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")  # one row a centre
    tiles = left.join(blocks, ["list", "block"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples():
                q, v = np.frombuffer(r.asked, np.int64), np.frombuffer(r.ids, np.int64)
                s = np.round(np.frombuffer(r.vecs).reshape(len(q), -1) @ np.frombuffer(r.data).reshape(len(v), -1).T, 6)
                s[q[:, None] == v] = -2
                m = min(k, len(v))
                bar = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                i, j = np.nonzero((s >= bar[:, None]) & (s > -2))
                yield pd.DataFrame({"query": q[i], "id": v[j], "score": s[i, j]})

    return tiles.select("asked", "vecs", "ids", "data").mapInPandas(best, "query long, id long, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query, id, score, rank): the ``k`` nearest rows of questions (query long, vec) over the index at ``path``, in the
    lists of the ``probes`` nearest centres (as many as the index was tuned to), or, if ``exact``, in all that bounds
    leave open."""
    lists, blocks = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/blocks")
    held = lists.orderBy("list").collect()  # at most CENTRES rows
    asked = cut(sound(queries.select(F.col("query").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))).withColumnRenamed("id", "query")
    if not held:
        return asked.select("query", F.col("query").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    c, names = np.array([r["centre"] for r in held]), np.array([r["list"] for r in held])
    probes = probes or held[0]["probes"]
    reach = np.arccos(np.clip([r["reach"] for r in held], -1, 1))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for k in range(0, len(part), ASKED):
                some = part.iloc[k : k + ASKED]
                s = unit(some["vec"]) @ c.T
                near = np.zeros(s.shape, bool)
                np.put_along_axis(near, np.argsort(-s, axis=1, kind="stable")[:, :probes], True, axis=1)
                yield from by_list(some, near, names)

    schema = "query long, vec array<double>, list int"
    first = cut(scored(asked.mapInPandas(nearest, schema), blocks, lists, k))
    if not exact:
        return top(first, "query", "score", "id", k)
    bars = top(first, "query", "score", "id", k).where(F.col("rank") == k).select("query", F.col("score").alias("bar"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for k in range(0, len(part), ASKED):
                some = part.iloc[k : k + ASKED]
                s = unit(some["vec"]) @ c.T
                away = np.maximum(np.arccos(np.clip(s, -1, 1)) - reach, 0)
                may = np.cos(away) + SLACK >= some["bar"].to_numpy()[:, None]
                np.put_along_axis(may, np.argsort(-s, axis=1, kind="stable")[:, :probes], False, axis=1)
                yield from by_list(some, may, names)

    open_ = asked.join(bars, "query", "left").fillna(-2.0, ["bar"])  # with fewer rows than k every list may matter
    more = scored(open_.mapInPandas(rest, schema), blocks, lists, k)
    return top(first.unionByName(more), "query", "score", "id", k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (query, id) that were found."""
    n = exact.count()
    return found.join(exact, ["query", "id"], "left_semi").count() / n if n else 1.0
