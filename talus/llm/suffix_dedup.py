"""Suffix-array dedup: removes bytes of strings of ``width`` bytes that recur.

Dealing. Every window of ``width`` bytes has one anchor: of its GRAM-byte strings the one with
the least hash, leftmost among equals. Equal windows have equal anchors at equal
places, so windows need to be compared under their anchor only. The windows of one anchor
occurrence form a segment. Anchors that occur once are done; hashes decide nothing else.

Suffix arrays. The segments of an anchor that occurs again are dealt to shards by anchor; equal
ones travel once, with all their places. A segment that stands in several places, byte for
byte, recurs whole. The different segments of an anchor are a shard's text, which is sorted by
induced sorting (``suffix.suffix_array``); permuted common prefixes of at least ``width``
between neighbours name the windows that recur. A worker settles beforehand, byte by byte,
segments that repeat in its own flush.

An anchor with more than HOT different segments (a common passage in changing surroundings) would
outgrow a shard; its segments are cut finer, to single windows, which are compared by 128
bits of two hashes, one of them cryptographic, one small entry a window.

Defined cases: null and empty texts have no bytes; windows never cross texts; a text shorter
than ``width`` loses nothing; very long texts are read whole, in overlapping pieces; rows
that repeat (doc_id, text) count as occurrences of their own and all lose their bytes, as do
rows with a null doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.bpe import ODD, TABLE, mix64
from talus.llm.scratch import Scratch
from talus.llm.shingles import powers
from talus.llm.suffix import common_prefixes, suffix_array

GRAM, HOT = 64, 512
PIECE = 1 << 18  # bytes that a worker hashes at a time
FLUSH = 1 << 13  # entries that it folds at a time; keeps packed rows short
HELD = 1 << 22  # bytes of segments that it folds at a time
ASK = "bucket int, key binary, sub binary, n binary, row binary, a binary, b binary"
NAMES = ("key", "sub", "n", "row", "a", "b")
TYPES = ("<u8", "<u8", "<i8", "<i8", "<i8", "<i8")


def pieces(rows: list[int], texts: list[str | None], width: int, room: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, place, bytes) of about ``room`` bytes together; of longer texts pieces
    that share ``width`` - 1 bytes, so that each window lies in one."""
    held, size = [], 0
    for row, text in zip(rows, texts, strict=True):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data) - width + 1, 0), room):
            held.append((row, at, data[at : at + room + width - 1]))
            size += len(held[-1][2])
            if size >= room:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(raw: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, segment hash, first window, last window, anchor place) of pieces
    of texts, places counted within the piece. Hashes only bring together what may be equal."""
    lens = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * up, dtype=np.uint64)])
    gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    bits = np.uint64(max(n, 2).bit_length())
    least = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)  # hash first, then place
    reach, span = width - GRAM + 1, 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(lens)
    start = np.arange(len(place))
    text = np.searchsorted(ends, start, "right")
    ok = start + width <= ends[text]
    start, place, text = start[ok], place[ok], text[ok]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    first, last, at, owner = start[cut], start[np.append(cut[1:], len(start)) - 1], place[cut], text[cut]
    segment = mix64((sums[last + width] - sums[first]) * down[first] + mix64(((at - first) * 1024 + (last - first)).astype(np.uint64)))
    base = (ends - lens)[owner]
    key = mix64(gram[at] + np.uint64(ODD))  # least hashes crowd near zero; buckets need even keys
    return owner, key, segment, first - base, last - base, at - base


def fold(parts: list[tuple[np.ndarray, ...]], same=None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of entries (key, sub, n, row, a, b, ...): what repeats among them already, as (row, a,
    b), and one entry for each (key, sub). ``same`` tells of two entries whether their bytes
    are equal, too; those that are not stay entries of their own."""
    key, sub, n, row, a, b, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    turn = np.lexsort((sub, key))
    key, sub, n, row, a, b = (x[turn] for x in (key, sub, n, row, a, b))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    if same is not None:
        rest = [x[turn] for x in rest]
        for k in np.flatnonzero(~new):
            if not same(*(x[lead[k]] for x in rest), *(x[k] for x in rest)):
                lead[k] = k
    total = np.bincount(lead, weights=n, minlength=len(key)).astype(np.int64)
    twice = total[lead] > 1
    one = np.flatnonzero(lead == np.arange(len(key)))
    return [row[twice], a[twice], b[twice]], [key[one], sub[one], total[one], row[one], a[one], b[one]]


def emit(done: list[np.ndarray], one: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a scan: settled stretches (row, a, b packed; bucket null) and entries packed by bucket."""
    names = ["bucket", *NAMES]
    if len(done[0]):
        null = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), null, null, null, *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in done)], names)
    bucket = ((one[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # keys, so buckets too, are in order
    stop = np.append(start[1:], len(bucket))
    for s in range(0, len(start), 64):
        part = list(zip(start[s : s + 64], stop[s : s + 64], strict=True))
        cols = [pa.array([x[i:j].astype(t).tobytes() for i, j in part], pa.binary()) for x, t in zip(one, TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[start[s : s + 64]], pa.int32()), *cols], names)


def scan(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """The anchors of all texts, folded and packed; docs has (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, held = [], [], 0

        def same(p: int, x: int, y: int, q: int, u: int, v: int) -> bool:
            return texts[p][x:y] == texts[q][u:v]

        for batch in batches:
            for held_pieces in pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), width, PIECE):
                owner, key, sub, first, last, _ = anchors([x[2] for x in held_pieces], width)
                if not len(owner):
                    continue
                row, place = (np.array([x[c] for x in held_pieces], np.int64)[owner] for c in (0, 1))
                parts.append((key, sub, np.ones(len(key), np.int64), row, place + first, place + last + width, owner + len(texts), first, last + width))
                texts += [x[2] for x in held_pieces]
                held += len(owner)
                if held > FLUSH:
                    yield from emit(*fold(parts, same), buckets)
                    parts, texts, held = [], [], 0
        if parts:
            yield from emit(*fold(parts, same), buckets)

    return docs.select("row", "text").mapInArrow(run, ASK)


def settled(asks: DataFrame) -> DataFrame:
    """Rows (row, a, b) of the stretches that a flush settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[k].as_py(), "<i8")) for c in range(3)], ["row", "a", "b"])

    return asks.where("bucket is null").select("row", "a", "b").mapInArrow(run, "row long, a long, b long")


def find(asks: DataFrame, equal: bool = False) -> DataFrame:
    """Rows (row, a, b, key, n, segments) of the entries whose key another entry has; with
    ``equal``, of those whose sub is the same as well. segments: different subs under the key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, sub, n, row, a, b = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in zip(NAMES, TYPES, strict=True))
        turn = np.lexsort((sub, key))
        key, sub, n, row, a, b = (x[turn] for x in (key, sub, n, row, a, b))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_sub = new_key | np.concatenate([[True], sub[1:] != sub[:-1]])
        k, s = np.cumsum(new_key) - 1, np.cumsum(new_sub) - 1
        segments = np.bincount(k[new_sub])[k]
        keep = (np.bincount(s)[s] if equal else np.bincount(k)[k]) > 1
        return pd.DataFrame({"row": row[keep], "a": a[keep], "b": b[keep], "key": key[keep].view(np.int64), "n": n[keep], "segments": segments[keep]})

    return asks.where("bucket is not null").groupBy("bucket").applyInPandas(run, "row long, a long, b long, key long, n long, segments long")


def recurring(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment the starts of its windows that recur in the shard, from
    the suffix array of all segments, each behind a separator."""
    s = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 2
    lens = np.array([len(x) for x in segments])
    ends = np.cumsum(lens + 1)
    full = np.ones(ends[-1] + 1, np.int16)  # 1 separates, 0 ends
    full[np.arange(len(s)) + np.repeat(np.arange(len(lens)), lens)] = s
    full[-1] = 0
    before, length = common_prefixes(full, suffix_array(full), width)
    long = np.flatnonzero(length >= width)
    hit = np.zeros(len(full), bool)
    hit[long] = hit[before[long]] = True
    start = ends - lens - 1
    return [np.flatnonzero(hit[a : max(a, a + n - width + 1)]) for a, n in zip(start, lens, strict=True)]


def stretches(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + width) over sorted starts."""
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + width]))
    return starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + width


PIECES = "shard int, hot boolean, key long, rows binary, places binary, often boolean, data binary"


def cut(docs: DataFrame, needs: DataFrame, shards: int) -> DataFrame:
    """Rows of PIECES: the segments asked for, dealt by anchor; equal ones of a flush are one row
    with all their places."""
    asked = needs.groupBy("row").agg(F.collect_list(F.struct("a", "b", "key", (F.col("n") > 1).alias("often"), (F.col("segments") > HOT).alias("hot"))).alias("wanted"))
    both = docs.join(asked, "row").select("row", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            which = list(held)
            packed = [pa.array([np.array(held[k][c], "<i8").tobytes() for k in which], pa.binary()) for c in (0, 1)]
            out = [pa.array([mixed_shard(k[0], shards) for k in which], pa.int32()), pa.array([held[k][3] for k in which], pa.bool_()), pa.array([k[0] for k in which], pa.int64()), *packed, pa.array([held[k][2] for k in which], pa.bool_()), pa.array([k[1] for k in which], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["shard", "hot", "key", "rows", "places", "often", "data"])

        for batch in batches:
            for row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    part = data[w["a"] : w["b"]]
                    entry = held.setdefault((w["key"], part), [[], [], False, w["hot"]])
                    entry[0].append(row)
                    entry[1].append(w["a"])
                    entry[2] |= w["often"]
                    size += len(part) + 64
                    if size > HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return both.mapInArrow(run, PIECES)


def by_array(cuts: DataFrame, width: int) -> DataFrame:
    """Rows (row, a, b): recurring stretches of each shard's segments, by its suffix array."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        places: dict[bytes, list] = {}
        for key, data, where, at, often in zip(rows["key"], rows["data"], rows["rows"], rows["places"], rows["often"], strict=True):
            entry = places.setdefault(data, [[], [], False, key])
            entry[0].append(np.frombuffer(where, "<i8"))
            entry[1].append(np.frombuffer(at, "<i8"))
            entry[2] |= bool(often) or len(entry[0]) > 1 or len(entry[0][0]) > 1
        different = Counter(entry[3] for entry in places.values())
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for data, entry in places.items():
            if entry[2]:  # stands in several places, so all of it recurs
                out[0] += entry[0]
                out[1] += entry[1]
                out[2] += [at + len(data) for at in entry[1]]
        sorted_ = [x for x, entry in places.items() if different[entry[3]] > 1]
        for data, starts in zip(sorted_, recurring(sorted_, width) if sorted_ else (), strict=True):
            if len(starts) and not places[data][2]:
                lo, hi = stretches(starts, width)
                where, at = places[data][0][0], places[data][1][0]
                out[0].append(np.repeat(where, len(lo)))
                out[1].append(at + lo)
                out[2].append(at + hi)
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("row", "a", "b"), out, strict=True)})

    return cuts.where("not hot").groupBy("shard").applyInPandas(run, "row long, a long, b long")


def by_window(scratch: Scratch, cuts: DataFrame, width: int, buckets: int) -> DataFrame:
    """Rows (row, a, b): recurring windows of the segments of anchors with over HOT different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for where, at, often, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                s = np.frombuffer(data, np.uint8)
                up, down = powers(len(s))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[s] * up, dtype=np.uint64)])
                key = mix64((sums[width:] - sums[:-width]) * down[: len(s) - width + 1])
                sub = np.array([int.from_bytes(hashlib.blake2b(data[k : k + width], digest_size=8).digest(), "little") for k in range(len(key))], np.uint64)
                n = np.full(len(key), 2 if often else 1)
                for row, a in zip(np.frombuffer(where, "<i8"), np.frombuffer(at, "<i8"), strict=True):
                    place = a + np.arange(len(key))
                    parts.append((key, sub, n, np.full(len(key), row), place, place + width))
                    held += len(key)
                    if held > FLUSH:
                        yield from emit(*fold(parts), buckets)
                        parts, held = [], 0
        if parts:
            yield from emit(*fold(parts), buckets)

    hot = scratch.save(cuts.where("hot").select("rows", "places", "often", "data").mapInArrow(run, ASK))
    return settled(hot).unionByName(find(hot, equal=True).select("row", "a", "b"))


def mixed_shard(key: int, shards: int) -> int:
    return (key & 0xFFFFFFFFFFFFFFFF) * 0x9E3779B97F4A7C15 % 2**64 * shards >> 64


def remove_recurring(scratch: Scratch, docs: DataFrame, width: int = 200) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    spans (the removed runs as pairs of byte places)."""
    docs = scratch.save(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts * 2, min(size >> 24, 1 << 15))  # about 16 MB of text each
    asks = scratch.save(scan(docs, width, buckets))
    found = scratch.save(find(asks))
    cover = scratch.save(settled(asks))
    scratch.drop(asks)
    shards = max(parts * 2, min(found.count() >> 14, 1 << 30))
    cuts = scratch.save(cut(docs, found, shards))
    cover = cover.unionByName(scratch.save(by_array(cuts, width).unionByName(by_window(scratch, cuts, width, buckets))))
    scratch.drop(cuts)
    scratch.sweep()
    spans = cover.distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, runs = text.encode("utf-8", "surrogatepass"), []
                for s in spans or ():
                    if runs and s["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["b"])
                    else:
                        runs.append([s["a"], s["b"]])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for k, v in enumerate((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [x for r in runs for x in r])):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    both = docs.join(spans, "row", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
