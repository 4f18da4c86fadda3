"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens
that are vocabulary entries (the entry's bytes are compared, so a stranger never
passes). Tier two, for the misses: merging over a linked list of bytes, the next
merge taken from a heap by (rank, place). Both run once per distinct pre-token of
a block of texts, behind a bounded cache in each worker.

The vocabulary is read on the driver and broadcast; its size is that of the file
(50 thousand entries here), whatever the corpus. Defined cases: null encodes as the
empty text, the empty text has no ids; very long texts are never cut; a null doc_id and
repeated rows stay; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: An odd multiplier for hashes by prefix sums.
ODD = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(6).integers(0, 2**64, 256, dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser (xor-shift, multiply) over unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_all(items: list[bytes]) -> np.ndarray:
    """64-bit hashes of many byte strings at once, by prefix sums."""
    if not items:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    data = np.frombuffer(b"".join(items), np.uint8)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.full(int(lengths.max()) + 1, ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * power[place], dtype=np.uint64)])
    ends = np.cumsum(lengths)
    return mix64(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets of about
    four; a bucket, largest first, gets the first displacement that sends its keys
    to free places, and buckets of one key get a free place by number."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = hash_all(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        singles = []
        self.at = np.zeros(n, np.int64)
        for members in sorted(groups, key=len, reverse=True):
            if len(members) == 1:
                singles.append(int(members[0]))
                continue
            start = 0
            while True:
                spots = self._spots(h[members], np.arange(start, start + 512)[:, None])
                good = free[spots].all(axis=1)
                for k in np.flatnonzero(good):
                    if len(set(spots[k].tolist())) == len(members):
                        break
                else:
                    start += 512
                    if start > 1 << 22:
                        raise ValueError("keys repeat or collide")
                    continue
                free[spots[k]] = False
                self.shift[bucket[members[0]]] = start + k
                self.at[spots[k]] = members
                break
        for member, spot in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.shift[bucket[member]] = -1 - spot
            self.at[spot] = member

    def _spots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix64(h + (shift.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, items: list[bytes]) -> np.ndarray:
        """For each item the index of the only key that it can equal."""
        h = hash_all(items)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.at[np.where(d < 0, -1 - d, self._spots(h, np.maximum(d, 0)))]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost among equals."""
    n = len(word)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    ends = list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapify(heap)
    while heap:
        rank, i, end = heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or ends[j] != end or ranks.get(word[i:end]) != rank or ends[i] != j:
            continue  # one of the two has been merged since
        ends[i], alive[j] = end, False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            new = ranks.get(word[i : ends[right[i]]])
            if new is not None:
                heappush(heap, (new, i, ends[right[i]]))
        if left[i] >= 0:
            k = left[i]
            new = ranks.get(word[k:end])
            if new is not None:
                heappush(heap, (new, k, end))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder over one vocabulary; ids are little-endian uint32."""

    CACHE = 1 << 19

    def __init__(self, vocabulary: list[bytes], ids: list[int], pattern: str):
        self.keys, self.ids = vocabulary, ids
        self.packed = [int(i).to_bytes(4, "little") for i in ids]
        self.ranks = dict(zip(vocabulary, ids, strict=True))
        self.table = dict(zip(ids, vocabulary, strict=True))
        self.find = regex.compile(pattern).findall
        self.hash = PerfectHash(vocabulary)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for word, data, k in zip(words, raw, self.hash.lookup(raw).tolist(), strict=True):
            if self.keys[k] == data:
                self.known[word] = self.packed[k]
            else:
                self.known[word] = np.array(merge(data, self.ranks), "<u4").tobytes()

    def encode(self, texts: list[str], block: int = 1 << 20) -> Iterator[bytes]:
        """The packed ids of each text; about ``block`` characters at a time."""
        k = 0
        while k < len(texts):
            lists, room = [], block
            while k < len(texts) and room > 0:
                lists.append(self.find(texts[k]))
                room -= len(texts[k]) + 1
                k += 1
            if len(self.known) > self.CACHE:
                self.known.clear()
            new = set().union(*lists).difference(self.known)
            if new:
                self._learn(list(new))
            for words in lists:
                yield b"".join(map(self.known.__getitem__, words))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def vocabulary(path: str) -> tuple[list[bytes], list[int]]:
    """Entries and ranks of a file with a base64 entry and its rank on each line."""
    keys, ids = [], []
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                key, rank = line.split()
                keys.append(base64.b64decode(key))
                ids.append(int(rank))
    return keys, ids


class Shared:
    """A vocabulary for the workers, which build the codec once per broadcast."""

    built: tuple[tuple, Codec] | None = None

    def __init__(self, spark, path: str, pattern: str):
        self.sent, self.pattern = spark.sparkContext.broadcast(vocabulary(path)), pattern

    def codec(self) -> Codec:
        data = self.sent.value
        if Shared.built is None or Shared.built[0] is not data:
            Shared.built = (data, Codec(*data, self.pattern))
        return Shared.built[1]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids array<int>), one per input row."""
    shared = Shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.frombuffer(x, "<i4") for x in codec.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, data binary) from rows (doc_id, ids)."""
    shared = Shared(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            data = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes the ids and digests both: doc_id, n_tokens, ids_sha256,
    decoded_sha256; neither ids nor bytes leave the worker."""
    shared = Shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, back = [], [], []
            for packed in codec.encode(texts):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
