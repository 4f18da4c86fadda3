"""Exact deduplication by content-defined chunk recipes.

A text (A-Z lower-cased, UTF-8) is cut where a rolling sum over the last 32
bytes meets a mask, so equal stretches give equal chunks wherever they stand.
Chunks are deduplicated by digest *and* content: a digest that two contents
share gets one identifier per content, so that identifiers are verified, not
assumed. Texts are equal exactly when their ordered identifier lists (recipes)
are. Each chunk moves once, after the map side has dropped its repeats; long
texts themselves never move, only their recipes do.

Defined cases: a null text counts as empty, the empty text has an empty recipe
and empties equal each other; rows whose doc_id is null or repeated stay rows of
their own, ``keep_id`` is the largest non-null doc_id of the group and every row
carrying it has ``kept`` true (null doc_id: false unless the whole group is null); very long
texts are many chunks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.scratch import Scratch, fresh, join_hot

WINDOW = 32
GEAR = np.random.default_rng(9).integers(0, 2**32, 256, dtype=np.uint32)


def digest16(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def cut_points(data: bytes, least: int, mean_bits: int, most: int) -> list[int]:
    """Ends of the chunks of one text; the last is its length."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # doubling: h covers twice as many bytes each time
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    spots = (np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1).tolist()
    ends, start = [], 0
    for p in spots:
        while p - start > most:
            start += most
            ends.append(start)
        if p - start >= least:
            start = p
            ends.append(p)
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = digest16, least: int = 256, mean_bits: int = 10, most: int = 8192) -> DataFrame:
    """Rows (doc_id, recipe, text_sha256): the ordered chunk digests of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, shas = [], []
            for text in batch.column(1):
                data = normalised(text.as_py())
                start, ids = 0, []
                for end in cut_points(data, least, mean_bits, most):
                    ids.append(digest(data[start:end]))
                    start = end
                lists.append(ids)
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.binary())), pa.array(shas, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, recipe array<binary>, text_sha256 string")


def chunks(docs: DataFrame, digest: Callable[[bytes], bytes] = digest16, least: int = 256, mean_bits: int = 10, most: int = 8192) -> DataFrame:
    """Rows (digest, chunk), without the repeats within one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, None] = {}
            for text in batch.column(0):
                data = normalised(text.as_py())
                start = 0
                for end in cut_points(data, least, mean_bits, most):
                    seen[data[start:end]] = None
                    start = end
            found = list(seen)
            for k in range(0, len(found), 4096):
                part = found[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([digest(c) for c in part], pa.binary()), pa.array(part, pa.binary())], ["digest", "chunk"])

    return docs.select("text").mapInArrow(run, "digest binary, chunk binary")


def verified_recipes(scratch: Scratch, docs: DataFrame, digest: Callable[[bytes], bytes] = digest16, **sizes: int) -> DataFrame:
    """Recipes whose entries are verified identifiers: the digest where it has
    one content, else the digest with the content's ordinal behind it."""
    plain = scratch.save(recipes(docs, digest, **sizes))
    distinct = chunks(docs, digest, **sizes).dropDuplicates(["digest", "chunk"])
    clash = scratch.save(distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if clash.isEmpty():
        return plain
    # Digests with several contents: number the contents, rewrite the recipes that hold them.
    contents = chunks(docs, digest, **sizes).dropDuplicates(["digest", "chunk"]).join(clash, "digest")
    named = scratch.save(contents.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("digest").orderBy("chunk"))))
    options = dict(zip(("least", "mean_bits", "most"), (sizes.get("least", 256), sizes.get("mean_bits", 10), sizes.get("most", 8192)), strict=True))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                data, start, ids, pieces = normalised(text.as_py()), 0, [], []
                for end in cut_points(data, **options):
                    ids.append(digest(data[start:end]))
                    pieces.append(data[start:end])
                    start = end
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.binary()), pa.array(pieces, pa.binary())], ["row", "at", "digest", "chunk"])

    tagged = docs.select("doc_id", "text", F.sha2(F.expr("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), 256).alias("sha"))
    by_text = tagged.groupBy("sha").agg(F.min("text").alias("text")).select(F.col("sha").alias("row"), "text")
    held = by_text.mapInArrow(parts, "row string, at int, digest binary, chunk binary").join(named, ["digest", "chunk"], "left")
    entry = F.when(F.col("ordinal").isNull(), F.col("digest")).otherwise(F.concat("digest", F.encode(F.concat(F.lit("#"), F.col("ordinal").cast("string")), "utf-8")))
    new = held.select("row", F.struct("at", entry.alias("id")).alias("s")).groupBy("row").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["id"]).alias("verified"))
    return plain.join(new, plain.text_sha256 == new.row, "left").select("doc_id", F.coalesce("verified", "recipe").alias("recipe"), "text_sha256")


def exact_groups(scratch: Scratch, docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = verified_recipes(scratch, docs, **options)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = join_hot(rows, groups, "recipe", F.struct("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_copies(scratch: Scratch, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group; where rows that repeat a doc_id hold
    the text that stays, one of them."""
    sha, many = fresh(docs, "sha", "many")
    rows = exact_groups(scratch, docs, **options).where("kept")
    kept = scratch.save(rows.groupBy(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha")).agg((F.count("*") > 1).alias(many)))
    mine = docs.withColumn(sha, F.sha2(F.expr("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), 256))
    out = mine.join(kept, mine.doc_id.eqNullSafe(kept["_keep"]) & (mine[sha] == kept["_sha"]))
    once = out.where(~F.col(many)).select(*docs.columns)
    if not kept.where(many).limit(1).count():
        return once
    return once.unionByName(out.where(many).dropDuplicates(["doc_id", sha]).select(*docs.columns))
