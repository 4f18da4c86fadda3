"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources, ordered by code point with null last, get weights from a
repeating tuple and share all words; a target stops at ``cap`` times its source's
size and the excess is reshared by weight until none is above.

Draws: a source's quota is so many full passes over its blocks plus a rest. The
blocks (at most ``block_words`` words of one document) are dealt by hash to a
power of two of leaves, so that a leaf holds about ``leaf_words`` words however
large its source is; the rest is split down the binary tree over the leaves by
hypergeometric draws, which leaves the exact quota in the leaves with the law
of a uniform draw without replacement. The top of a large tree is split first, its
subtrees then in tasks of their own. Inside a leaf the blocks are permuted and
taken in that order until the leaf's quota is met; the last one may be cut. Leaves
are dealt in order to the output shards, whose rows are shuffled locally.
Everything is a function of (seed, doc_id, size), so reruns agree.

Defined cases: null and empty texts have size 0 and are never taken; very long texts are
many blocks; null is a source of its own, last in order; rows that repeat a doc_id are rows
of their own, and where two of them have one size either may be the one that is taken;
an empty table gives an empty result; other columns are passed through by
``mixed_documents``, whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.bpe import ODD, mix64
from talus.llm.scratch import Scratch, fresh, ranked

WORD = r"[^\x20\x09-\x0D]+"
#: numpy draws hypergeometric variates for populations below this.
EXACT_DRAW = 10**9
#: Leaves of the top of a source's tree, which one task splits.
TOPS = 1 << 12


def log_binomial(x: int, n: int, p: float) -> float:
    """log P(X = x) for a binomial X by the saddle-point form, accurate for large n as well."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p))

    def stirling(k: int) -> float:
        if k < 16:
            return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)
        return (1 / 12 - (1 / 360 - 1 / (1260 * k * k)) / (k * k)) / k

    def deviance(k: int, mean: float) -> float:
        """k log(k / mean) + mean - k, without cancellation where they are close."""
        v = (k - mean) / (k + mean)
        if abs(v) > 0.1:
            return k * math.log(k / mean) + mean - k
        total, term, j = (k - mean) * v, 2 * k * v, 1
        while True:
            term *= v * v
            new = total + term / (2 * j + 1)
            if new == total:
                return total
            total, j = new, j + 1

    return stirling(n) - stirling(x) - stirling(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def large_draw(left: int, right: int, quota: int, rng: np.random.Generator) -> int:
    """A hypergeometric variate of any population: of two independent binomials with one rate,
    the first given that they sum to the quota, by rejection on the second's probability."""
    if quota in (0, left + right) or not left or not right:
        return min(left, quota)
    rate = quota / (left + right)
    top = log_binomial(min(int((right + 1) * rate), right), right, rate)
    while True:
        x = int(rng.binomial(left, rate))
        if 0 <= quota - x <= right and math.log(1 - rng.random()) < log_binomial(quota - x, right, rate) - top:
            return x


def halve(left: np.ndarray, right: np.ndarray, quota: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of ``quota`` units drawn without replacement, how many come from the left."""
    out = np.zeros(len(quota), np.int64)
    small = left + right < EXACT_DRAW
    if small.any():
        out[small] = rng.hypergeometric(left[small], right[small], quota[small])
    for k in np.flatnonzero(~small):
        out[k] = large_draw(int(left[k]), int(right[k]), int(quota[k]), rng)
    return out


def split_quota(words: np.ndarray, quota: int, seed: list[int]) -> np.ndarray:
    """Quotas of the leaves (a power of two of them) that hold ``words`` words each."""
    levels = [words.astype(np.int64)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    quotas = np.array([quota], np.int64)
    for depth, held in enumerate(reversed(levels[:-1])):
        left, right = held[0::2], held[1::2]
        mine = halve(left, right, quotas, np.random.default_rng([*seed, depth]))
        quotas = np.stack([mine, quotas - mine], axis=1).ravel()
    return quotas


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """Rows (source, sid, source_size, target) from rows (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = ranked(scratch, totals, F.col("source").asc_nulls_last(), name="sid")
    by = scratch.save(by.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights)).cast("int") + 1)))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * float(cap)
    rate, bound = 0.0, -1.0  # words a unit of weight; sources whose limit/weight is at most bound are full
    while total:
        full = F.col("source_size") * float(cap) / F.col("weight") <= bound
        row = by.agg(F.sum(F.when(full, limit)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        rate = (total - (row["used"] or 0.0)) / row["open"]
        if not by.where(~full & (limit / F.col("weight") < rate)).limit(1).count():
            break
        bound = rate
    return by.select("source", "sid", "source_size", F.least(limit, F.col("weight") * rate).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, source, size), one row per input row."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size")).withColumn("uid", F.monotonically_increasing_id())


def leaf_quotas(scratch: Scratch, held: DataFrame, by: DataFrame, seed: int) -> DataFrame:
    """(sid, leaf, quota) from the words of the leaves (sid, leaf, words) and the sources' rests."""

    def split(words: pd.Series, places: pd.Series, leaves: int, quota: int, path: list[int]) -> np.ndarray:
        full = np.zeros(leaves, np.int64)
        full[places.to_numpy()] = words.to_numpy()
        return split_quota(full, quota, path)

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["tops"].iloc[0])
        return pd.DataFrame({"sid": key[0], "top": np.arange(n), "quota": split(rows["words"], rows["top"], n, int(rows["rest"].iloc[0]), [seed, int(key[0])])})

    def under(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["width"].iloc[0])
        return pd.DataFrame({"sid": key[0], "leaf": key[1] * n + np.arange(n), "quota": split(rows["words"], rows["leaf"] % n, n, int(rows["quota"].iloc[0]), [seed, int(key[0]), 1 + int(key[1])])})

    by = by.withColumn("tops", F.least("leaves", F.lit(TOPS))).select("sid", "rest", "tops", (F.col("leaves") / F.col("tops")).cast("long").alias("width"))
    held = scratch.save(held.join(by, "sid").withColumn("top", F.floor(F.col("leaf") / F.col("width"))))
    tops = held.groupBy("sid", "top", "tops", "rest").agg(F.sum("words").alias("words"))
    tops = scratch.save(tops.groupBy("sid").applyInPandas(top, "sid long, top long, quota long"))
    whole = held.where("width = 1").select("sid", "top").join(tops, ["sid", "top"]).select("sid", F.col("top").alias("leaf"), "quota")
    deep = held.where("width > 1").join(tops, ["sid", "top"]).select("sid", "top", "width", "leaf", "words", "quota")
    return scratch.save(whole.unionByName(deep.groupBy("sid", "top").applyInPandas(under, "sid long, leaf long, quota long")))


def plan(scratch: Scratch, sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, block_words: int = 1024, leaf_words: int = 1 << 17, seed: int = 2, shards: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pool, taken): one row per row of ``sized`` with its source's figures, and the mix:
    the blocks taken (uid, shard, first, words, pass), pass 0 for the rests."""
    by = targets(scratch, sized, weights, cap)
    quota = F.rint("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    by = by.withColumn("passes", full).withColumn("rest", quota - F.col("passes") * F.col("source_size"))
    depth = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_size") / float(leaf_words))))
    by = scratch.save(by.withColumn("leaves", F.pow(F.lit(2.0), depth).cast("long")))
    pool = scratch.save(sized.join(by.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    n_blocks = F.ceil(F.col("size") / block_words).cast("int")
    blocks = pool.where("size > 0 and (rest > 0 or passes > 0)").select("uid", "doc_id", "size", "sid", "leaves", "rest", "passes", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("k"))
    blocks = blocks.select(
        "uid", "doc_id", "sid", "leaves", "rest", "passes", (F.col("k") * block_words).cast("long").alias("first"),
        F.least(F.lit(block_words), F.col("size") - F.col("k") * block_words).cast("long").alias("words"), F.xxhash64(F.lit(seed), "doc_id", "size", "k").alias("h"),
    )
    parts = blocks.where("rest > 0").withColumn("leaf", F.pmod("h", "leaves")).withColumn("turn", F.xxhash64("h", F.lit(seed)))
    quotas = leaf_quotas(scratch, parts.groupBy("sid", "leaf").agg(F.sum("words").alias("words")), by, seed)
    before = F.sum("words").over(Window.partitionBy("sid", "leaf").orderBy("turn", "doc_id", "first", "uid").rowsBetween(Window.unboundedPreceding, -1))
    drawn = parts.join(quotas, ["sid", "leaf"]).withColumn("words", F.least("words", F.col("quota") - F.coalesce(before, F.lit(0)))).where("words > 0")
    drawn = drawn.select("uid", F.floor(F.col("leaf") * shards / F.col("leaves")).cast("int").alias("shard"), "first", "words", F.lit(0).alias("pass"))
    whole = blocks.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    whole = whole.select("uid", F.pmod(F.xxhash64("h", "pass"), F.lit(shards)).cast("int").alias("shard"), "first", "words", "pass")
    return pool, drawn.unionByName(whole)


def mix(scratch: Scratch, docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken."""
    pool, taken = plan(scratch, scratch.save(sizes(docs)), **options)
    got = taken.groupBy("uid").agg(F.sum("words").alias("taken"))
    return pool.join(got, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def dealt(rows: DataFrame, shards: int, seed: int, shard: str, *order: str) -> DataFrame:
    """Rows dealt to their shards, in each of them shuffled locally."""
    return rows.repartition(shards, shard).sortWithinPartitions(shard, F.xxhash64(F.lit(seed), *order), *order)


def mixed_blocks(scratch: Scratch, docs: DataFrame, shards: int = 64, seed: int = 2, **options) -> DataFrame:
    """The mix itself: rows (shard, doc_id, first, words), dealt by shard and in
    locally shuffled order; ``first`` and ``words`` give a block's word range."""
    pool, taken = plan(scratch, scratch.save(sizes(docs)), seed=seed, shards=shards, **options)
    rows = taken.join(pool.select("uid", "doc_id"), "uid").select("shard", "doc_id", "first", "words", "pass")
    return dealt(rows, shards, seed, "shard", "doc_id", "first", "pass").drop("pass")


def stretches(cuts: list[dict]) -> list[tuple[int, int]]:
    """First words and ends of the blocks taken of a text, in order, neighbouring blocks as one."""
    out: list[tuple[int, int]] = []
    for c in cuts:
        first, end = c["first"], c["first"] + c["words"]
        if out and out[-1][1] == first:
            first = out.pop()[0]
        out.append((first, end))
    return out


def mixed_documents(scratch: Scratch, docs: DataFrame, shards: int = 64, seed: int = 2, **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` once per full pass, and once more, cut to the
    words that the rest quota takes, where that takes some; dealt to shards and
    shuffled there. The words of a cut text keep what stands between them, across neighbouring blocks too, and a line
    end stands where words are left out; n_chars follows the text."""
    uid, shard, turn, passes, size, cuts = fresh(docs, "uid", "shard", "turn", "passes", "size", "cuts")
    base = scratch.save(docs.withColumn(uid, F.monotonically_increasing_id()))
    sized = base.select(F.col(uid).alias("uid"), "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    pool, taken = plan(scratch, scratch.save(sized), seed=seed, shards=shards, **options)
    rest = taken.where("pass = 0").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("cuts"), F.min("shard").alias("shard"))
    figures = pool.join(rest, "uid", "left").where("size > 0 and (passes > 0 or cuts is not null)")
    figures = figures.select(F.col("uid").alias(uid), F.col("passes").alias(passes), F.col("size").alias(size), F.col("cuts").alias(cuts), F.col("shard").alias(shard))
    names, word = docs.columns, regex.compile(WORD)
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(turn, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, held = batch.column(uid).to_numpy(), batch.column(cuts).to_pylist()
                part = np.array([c is not None for c in held])
                cut = np.array([part[k] and sum(c["words"] for c in held[k]) < n for k, n in enumerate(batch.column(size).to_pylist())], bool)
                times = batch.column(passes).to_numpy() + (part & ~cut)
                full, some = np.repeat(np.arange(len(ids)), times), np.flatnonzero(cut)
                nth = np.arange(len(full)) - np.repeat(np.cumsum(times) - times, times)
                spread = mix64(ids[full].astype(np.uint64) * np.uint64(ODD) + nth.astype(np.uint64)) % np.uint64(shards)
                place = np.where((nth == 0) & (part & ~cut)[full], -1, spread.astype(np.int64))
                leaf = batch.column(shard).fill_null(0).to_numpy()
                texts = batch.column("text").take(pa.array(some)).to_pylist()
                for k, i in enumerate(some):
                    spans = [m.span() for m in word.finditer(texts[k])]
                    texts[k] = "\n".join(texts[k][spans[first][0] : spans[end - 1][1]] for first, end in stretches(held[i]))
                for rows, own in ((full, None), (some, texts)):
                    if not len(rows):
                        continue
                    cols = {n: batch.column(n).take(pa.array(rows)) for n in names}
                    if own is not None:
                        cols["text"] = pa.array(own, cols["text"].type)
                        if "n_chars" in cols:
                            cols["n_chars"] = pa.array([len(t) for t in own], pa.int64()).cast(cols["n_chars"].type)
                    to = np.where(place < 0, leaf[full], place) if own is None else leaf[some]
                    order = mix64((ids[rows].astype(np.uint64) + np.uint64(seed)) * np.uint64(ODD)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(to, pa.int32()), pa.array(order)], schema=pa.schema([*(batch.schema.field(n) for n in names), (shard, pa.int32()), (turn, pa.int64())]))

    out = base.join(figures, uid).mapInArrow(run, schema)
    return dealt(out, shards, seed, shard, turn).select(*names)
