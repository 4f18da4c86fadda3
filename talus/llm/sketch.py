"""A counting sketch over all texts: one array of counts, by the leading bits of hashes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = 64
HEAD, SCHEMA = ["chunk", "counts"], "chunk int, counts binary"


class Cells:
    """Counts of one worker's hashes."""

    def __init__(self, bits: int):
        self.bits, self.cells = bits, np.zeros(1 << bits, np.uint32)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: np.ndarray) -> None:
        """Counts unsigned 64-bit hashes."""
        self.waiting.append((hashes >> np.uint64(64 - self.bits)).astype(np.int64))
        self.held += len(hashes)
        if self.held > 1 << 21:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.cells += np.bincount(np.concatenate(self.waiting), minlength=1 << self.bits).astype(np.uint32)
        self.waiting, self.held = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows (chunk, counts) at a partition's end."""
        self.settle()
        if self.cells.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in self.cells.reshape(CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], HEAD)


def count(docs: DataFrame, bits: int, hashes: Callable[[list[str | None]], Iterator[np.ndarray]]) -> np.ndarray:
    """Counts of what ``hashes`` yields for lists of the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(bits)
        for batch in batches:
            for h in hashes(batch.column(0).to_pylist()):
                cells.add(h)
        yield from cells.rows()

    return total(docs.select("text").mapInArrow(run, SCHEMA), bits)


def total(rows: DataFrame, bits: int) -> np.ndarray:
    """The sum of all partitions' counts; 2**bits numbers meet on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in sums.values()], pa.binary())], HEAD)

    cells = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.int64)
    for r in rows.repartition(CHUNKS, "chunk").mapInArrow(run, SCHEMA).collect():
        cells[r["chunk"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return cells.ravel()
