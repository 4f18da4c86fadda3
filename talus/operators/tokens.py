"""Token counts by the merges of a byte-level vocabulary that is given as a file of ranks.

Texts are split into pre-tokens by the JVM. Of an Arrow batch only distinct pre-tokens are merged, by a small helper
that remembers those of earlier batches, and all else are sums over the batch's arrays: nothing is shuffled. Rows that
share an id go another way: their pre-tokens are counted by id, distinct ones are merged once for all, and
their sizes go back by a join in which the most common are looked up in place. No merges are learned here.

Defined cases: null and empty texts have no tokens; rows that share an id are one row, null is an id; a
pre-token of any length is merged in n log n; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.shared import cut

# Fixed value: the pattern that splits text before the merges of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: At most so many pre-tokens are broadcast; any other is in under one row of so many.
HOT = 20_000
#: Pre-tokens whose sizes a worker remembers, at most; each of at most so many characters.
KEPT, LONG = 1 << 17, 64


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of tokens, from lines of a token in base64 and its rank."""
    with open(path, "rb") as rows:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rows)}


def size_of(word: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one pre-token: of all neighbours those of the least rank merge first, the left ones first."""
    if word in ranks:
        return 1
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a token is known by its start; 0 ends one that is merged away
    heap = [(r, k) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, k = heapq.heappop(heap)
        middle = ends[k]
        if not middle or middle >= n or ranks.get(word[k : ends[middle]]) != rank:
            continue  # one of the two has changed since
        end = ends[k] = ends[middle]
        ends[middle] = 0
        left -= 1
        if end < n:
            before[end] = k
            if (r := ranks.get(word[k : ends[end]])) is not None:
                heapq.heappush(heap, (r, k))
        if (p := before[k]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p))
    return left


def sized(words: DataFrame, path: str) -> DataFrame:
    """(word, n) of distinct pre-tokens (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            sizes = [size_of(w.encode(), ranks) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["word", "n"])

    return words.select("word").mapInArrow(run, "word string, n long")


def counted_rows(rows: DataFrame, path: str) -> DataFrame:
    """(id, tokens, words, distinct) of each row (id long, pieces array<string>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = ranks_of(path), {}
        for batch in batches:
            lists = batch.column(1)
            each = np.diff(np.asarray(lists.offsets))
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(known) > KEPT:
                known.clear()
            sizes = np.zeros(len(words), np.int64)
            for k, w in enumerate(words):
                n = known.get(w)
                if n is None:
                    n = size_of(w.encode(), ranks)
                    if len(w) <= LONG:
                        known[w] = n
                sizes[k] = n
            row, code = np.repeat(np.arange(len(each)), each), np.asarray(coded.indices).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes[code])])
            at = np.concatenate([[0], np.cumsum(each)])
            pairs = np.unique(row * max(1, len(words)) + code) // max(1, len(words))
            cols = (ends[at[1:]] - ends[at[:-1]], each, np.bincount(pairs, minlength=len(each)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in cols)], ["id", "tokens", "words", "distinct"])

    return rows.mapInArrow(run, "id long, tokens long, words long, distinct long")


def token_counts(texts: DataFrame, path: str, pattern: str = PATTERN, hot: int = HOT) -> DataFrame:
    """(id, tokens, words, distinct) of texts (id, text): tokens of the vocabulary of ranks at ``path``, pre-tokens,
    and distinct ones. Every executor must reach ``path``."""
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    each = lambda rows: counted_rows(rows.select(F.col("id").cast("long").alias("id"), pieces.alias("pieces")), path)
    repeated = cut(texts.groupBy(F.col("id").alias("_again")).agg(F.count("*").alias("k")).where("k > 1").select("_again"))
    if repeated.isEmpty():
        return each(texts)
    same = texts.id.eqNullSafe(repeated["_again"])
    return each(texts.join(repeated, same, "left_anti")).unionByName(shared_counts(texts.join(repeated, same, "left_semi"), path, pieces, hot))


def shared_counts(texts: DataFrame, path: str, pieces: Column, hot: int) -> DataFrame:
    """``token_counts`` where ids repeat."""
    each = cut(texts.select("id", F.explode(pieces).alias("word")).groupBy("id", "word").agg(F.count("*").alias("m")))
    rows = cut(each.groupBy("word").agg(F.count("*").alias("rows")))
    total = rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    sizes = cut(sized(rows, path).join(rows, "word").withColumn("hot", F.col("rows") * hot >= total).drop("rows"))
    often = F.broadcast(sizes.where("hot").drop("hot"))  # at most ``hot`` rows
    rare = each.join(often.select("word"), "word", "left_anti").join(sizes.where("not hot").drop("hot"), "word")
    sums = each.join(often, "word").unionByName(rare).groupBy(F.col("id").alias("_id")).agg(F.sum(F.col("m") * F.col("n")).alias("tokens"), F.sum("m").alias("words"), F.count("*").alias("distinct"))
    ids = texts.select("id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.join(sums, ids.id.eqNullSafe(sums["_id"]), "left").select("id", zero("tokens"), zero("words"), zero("distinct"))
