"""Word and shingle hashes of whole texts, many texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is the sum over its UTF-8
bytes of mixed values of byte and place, a shingle's comes from its words' hashes; both are
64 bits wide and mixed, and stand for their strings (two different shingles of a pair of
texts meet with a chance of about 2**-64 a pair of shingles).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from talus.llm.bpe import ODD, TABLE, mix64

INVERSE = pow(ODD, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**k and ODD**-k modulo 2**64 for k < n (kept for the next call)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        up, down = np.full(size, ODD, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def blocks(texts: list[str | None], room: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``room`` characters together, one text at least."""
    start = used = 0
    for k, t in enumerate(texts):
        used += len(t or "") + 1
        if used >= room:
            yield start, k + 1
            start, used = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str | None], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text k have hashes[bounds[k]:bounds[k + 1]]. Long texts
    are hashed in pieces of about ``piece`` bytes, cut between words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    del raw
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(at + piece, len(data))
        while stop < len(data) and not SPACE[data[stop - 1]]:
            stop = min(stop + 64, len(data))
            space = np.flatnonzero(SPACE[data[stop - 64 : stop]]) if stop < len(data) else []
            if len(space):
                stop += int(space[-1]) - 63
        part = data[at:stop]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[part], [True]])))
        start, end = edge[0::2], edge[1::2]
        if len(start):
            size = end - start
            first = np.cumsum(size) - size
            within = (np.arange(int(size.sum())) - np.repeat(first, size)).astype(np.uint64)
            value = mix64(TABLE[part[~SPACE[part]]] + within * np.uint64(ODD))
            hashes.append(mix64(np.add.reduceat(value, first) + size.astype(np.uint64)))
            starts.append(start + at)
        at = stop
    none = [np.zeros(0, np.int64)]
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.searchsorted(np.concatenate(starts or none), ends_of_text)])


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted unsigned hashes. A text with
    fewer words than ``width`` has its whole sequence as one; without words, none."""
    h, bounds = word_hashes(texts)
    n = np.diff(bounds)
    grams = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        grams = (grams + h[k : len(h) - width + 1 + k]) * np.uint64(ODD) if len(grams) else grams
    grams = mix64(grams)
    out = []
    for k in range(len(texts)):
        a, b = bounds[k], bounds[k + 1]
        if n[k] >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif n[k]:
            short = np.uint64(n[k])
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    short = (short + x) * np.uint64(INVERSE)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
