"""Alignment of two tokenizers over the same bytes.

Each Arrow batch is laid end to end: the tokens of all its documents by A and by B get byte offsets
of one long string, one bincount a side marks where tokens end, and where both end the string is
cut. Sums of those marks from the left give each token's group, and their differences at the
documents' bounds give each document's figures. Every link is a pair of token ids that end together;
pairs are counted over the corpus, and the counts come back to the documents by a join in which the
pairs that most documents hold are looked up in place.

A is a byte-level BPE (file of the tokenizers library, and if given the same vocabulary as ranks, which
is faster and verified to be the same); B is a sentencepiece model, which adds the space in front itself.

Defined cases: null and empty texts have no tokens and zeros, as have texts whose tokens do not join to
a space and the text; a null or repeated doc_id is a row of its own; of equally frequent partners of a B
id each is best; long texts are laid out alone; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.scratch import Scratch

#: Bytes of text that are laid end to end at once; a longer text goes alone.
SPAN = 4 << 20
#: Texts of more characters go through the slower form of A: the faster one has no bound on its stack.
LONG = 200_000
#: At most so many pairs of ids are broadcast; any other pair is in under one row of so many.
HOT = 20_000

ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Side:
    """One tokenizer: ``encode(texts)`` gives lists of ids, ``pieces[id]`` the bytes of a token."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        names = [str(k) for k in range(len(pieces))]
        self.names = {end: np.array([n + end for n in names], object) for end in ",|;"}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes in order for the code points from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.cache
def byte_level(path: str, ranks: str | None = None, pattern: str | None = None) -> Side:
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    letters, special = byte_letters(), {t["id"] for t in json.loads(slow.to_str())["added_tokens"]}
    vocabulary = {k: v for v, k in slow.get_vocab().items()}
    pieces = [b"" if k in special else bytes(letters[c] for c in vocabulary.get(k, "")) for k in range(max(vocabulary) + 1)]

    def by_file(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]

    if ranks is None:
        return Side(by_file, pieces)
    import tiktoken

    with open(ranks, "rb") as lines:
        fast_ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
    if any(pieces[n] != t for t, n in fast_ranks.items()) or len(fast_ranks) != sum(map(bool, pieces)):
        raise ValueError("the rank file holds another vocabulary")
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=fast_ranks, special_tokens={})
    return Side(lambda texts: [fast.encode_ordinary(t) if len(t) < LONG else by_file([t])[0] for t in texts], pieces)


@functools.cache
def piece_level(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [(k, model.id_to_piece(k)) for k in range(model.get_piece_size())]
    pieces = [bytes([int(p[1:-1], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in names]
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


def laid_out(a: Side, b: Side, ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
    """Per document (n_groups, text of the groups, pairs, times) of documents whose tokens of either
    side cover the same bytes, all laid end to end."""
    ta, tb = np.concatenate(ids_a), np.concatenate(ids_b)
    ends_a, ends_b = np.cumsum(a.sizes[ta]), np.cumsum(b.sizes[tb])
    size = int(ends_a[-1]) + 1
    cut = (np.bincount(ends_a, minlength=size) > 0) & (np.bincount(ends_b, minlength=size) > 0)
    before = np.cumsum(cut)
    stops_a, stops_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
    bounds = np.concatenate([[0], ends_a[stops_a - 1]])
    groups = np.diff(before[bounds])
    # One token a side ends at a cut: the links. Pairs are counted document by document.
    cut_a, cut_b = cut[ends_a], cut[ends_b]
    room = len(a.pieces) * len(b.pieces)
    pair = ta[cut_a] * len(b.pieces) + tb[cut_b]
    held, times = np.unique(np.repeat(np.arange(len(ids_a)), groups) * room + pair, return_counts=True)
    splits = np.searchsorted(held, np.arange(1, len(ids_a)) * room)
    held %= room
    held = (held // len(b.pieces) << 32) | held % len(b.pieces)
    # Text of the groups: A's tokens of a group, then B's; what follows a token says what comes next.
    said = np.concatenate([
        np.where(cut_a, a.names["|"][ta], a.names[","][ta]),
        np.where(cut_b, b.names[";"][tb], b.names[","][tb]),
    ])
    said = said[np.argsort(np.concatenate([2 * (before[ends_a] - cut_a), 2 * (before[ends_b] - cut_b) + 1]), kind="stable")]
    stops = np.concatenate([[0], stops_a + stops_b])
    texts = ["".join(said[s:e])[:-1] for s, e in zip(stops[:-1], stops[1:], strict=True)]
    return groups.tolist(), texts, np.split(held, splits), np.split(times, splits)


def one_span(a: Side, b: Side, doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """The rows of some documents."""
    full = [k for k, t in enumerate(texts) if t]
    given = [texts[k] for k in full]
    ids_a, ids_b = a.encode([" " + t for t in given]), b.encode(given)
    sound, keep_a, keep_b = [], [], []
    for k, x, y in zip(full, ids_a, ids_b, strict=True):
        want = b" " + texts[k].encode("utf-8", "surrogatepass")
        if b"".join(map(a.pieces.__getitem__, x)) == want and b"".join(map(b.pieces.__getitem__, y)) == want:
            sound.append(k)
            keep_a.append(np.array(x, np.int64))
            keep_b.append(np.array(y, np.int64))
    n = len(texts)
    figures = np.zeros((3, n), np.int64)
    sha, pairs, times = [""] * n, [[]] * n, [[]] * n
    if sound:
        groups, said, held, counts = laid_out(a, b, keep_a, keep_b)
        figures[:, sound] = [[len(x) for x in keep_a], [len(x) for x in keep_b], groups]
        for at, k in enumerate(sound):
            sha[k], pairs[k], times[k] = hashlib.sha256(said[at].encode()).hexdigest(), held[at], counts[at]
    columns = [pa.array(doc_ids, pa.int64()), *(pa.array(figures[i]) for i in (0, 1, 2, 2)), pa.array(sha, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def encoded(docs: DataFrame, a: tuple, b: tuple, span: int = SPAN) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): the counts, the digest of the groups, and the distinct pairs
    of linked ids (A's in the upper 32 bits) with how often the document has them; ``a`` and ``b`` are the
    arguments of byte_level and piece_level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(*a), piece_level(*b)
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if ids and size + len(text or "") > span:
                    yield one_span(left, right, ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
            if ids:
                yield one_span(left, right, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def align(scratch: Scratch, docs: DataFrame, a: tuple, b: tuple, hot: int = HOT) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = scratch.save(encoded(docs, a, b)).withColumn("row", F.monotonically_increasing_id())
    made = scratch.save(made)
    pairs = made.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = scratch.save(pairs.groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("rows")))
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("top"))  # one row an id of B: bounded by its vocabulary
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    graded = counts.withColumn("b", of_b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"), (F.col("rows") * hot >= total).alias("hot"))
    graded = scratch.save(graded)
    often = F.broadcast(graded.where("hot").drop("hot"))  # at most ``hot`` rows
    rare = pairs.join(often.select("pair"), "pair", "left_anti").join(graded.where("not hot").drop("hot"), "pair")
    linked = pairs.join(often, "pair").unionByName(rare).groupBy("row")
    sums = linked.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = made.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
