"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than their successors, the leftmost-smaller
ones are sorted by their substrings, and all others are induced from them. Equal substrings
get one name, and the string of names is sorted by the same procedure, recursively. Whole
buckets are induced at once with numpy; names go into the recursion as digits of a small
alphabet, so that buckets stay few and large.

Common prefixes are computed in text order: where the symbols before a suffix and before its
predecessor agree, the prefix is one shorter than that of the suffix before, so only
the others (irreducible ones) are compared, several symbols at a time.
"""

from __future__ import annotations

import math

import numpy as np

DIGITS = 512  # names go in as they are up to this many, else as two digits
SMALL = 1 << 17  # strings that are sorted at once, where the recursion ends


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last (sentinel) is."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    at = np.searchsorted(change, np.arange(n - 1))  # the next place where the symbol changes
    small = np.empty(n, bool)
    small[-1] = True
    small[:-1] = s[change[at] + 1] > s[change[at]]
    return small


def _spread(sa: np.ndarray, at: np.ndarray, j: np.ndarray, c: np.ndarray, down: bool) -> None:
    """Appends the suffixes j to the buckets of their symbols c, in order."""
    turn = np.argsort(c, kind="stable")
    j, c = j[turn], c[turn]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(start, len(c)))
    place = np.arange(len(c)) - np.repeat(start, size)
    sa[at[c] - place if down else at[c] + place] = j
    at[c[start]] += -size if down else size


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order of what the ordered leftmost-smaller ones induce."""
    n = len(s)
    count = np.bincount(s, minlength=symbols)
    end = np.cumsum(count)
    begin = end - count
    sa = np.full(n, -1, np.int64)
    lms_count = np.bincount(s[lms], minlength=symbols)
    lms_at = end - lms_count
    sa[np.repeat(lms_at, lms_count) + _within(s[lms], symbols)] = lms[np.argsort(s[lms], kind="stable")]
    head = begin.copy()
    for c in np.flatnonzero(count):
        done = begin[c]
        while done < head[c]:  # larger suffixes, those that the bucket induces into itself included
            part = sa[done : head[c]]
            done = head[c]
            j = part[part > 0] - 1
            j = j[~small[j]]
            if len(j):
                _spread(sa, head, j, s[j], False)
        j = sa[lms_at[c] : end[c]]
        j = j[j > 0] - 1
        if len(j):
            _spread(sa, head, j, s[j], False)
    tail = end - 1
    for c in np.flatnonzero(count)[::-1]:
        done = end[c] - 1
        while done > tail[c]:  # smaller suffixes, from the end
            part = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            j = part[part > 0] - 1
            j = j[small[j]]
            if len(j):
                _spread(sa, tail, j, s[j], True)
        part = sa[begin[c] : head[c]][::-1]
        j = part[part > 0] - 1
        j = j[small[j]]
        if len(j):
            _spread(sa, tail, j, s[j], True)
    sa[0] = n - 1  # the sentinel, which nothing induces
    return sa


def _within(c: np.ndarray, symbols: int) -> np.ndarray:
    """0, 1, 2, ... within each symbol, in symbol order."""
    size = np.bincount(c, minlength=symbols)
    return np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small unsigned symbols whose last is the unique least."""
    if len(s) < max(3, SMALL):
        return sorted_at_once(s)
    symbols = int(s.max()) + 1
    s = s.astype(np.int16 if symbols < 1 << 15 else np.int64)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        first = induce(s, small, lms, symbols)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        by_substring = first[is_lms[first]]
        name = names(s, lms, by_substring)
        lms = by_substring if name.max() + 1 == len(lms) else lms[sort_names(name, len(s))]
    return induce(s, small, lms, symbols)


def sorted_at_once(s: np.ndarray) -> np.ndarray:
    """The suffixes of a short string, by ranks of stretches twice as long each time."""
    rank, span = s.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:] + 1
        both = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(both, kind="stable")
        rank = np.empty(len(both), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])[: len(order)]
        span *= 2
        if span >= len(rank) or rank.max(initial=0) == len(rank) - 1:
            return order


def names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, equal ones alike, in text order. A substring
    reaches to the next one's first symbol; neighbours in the order are compared symbol by symbol."""
    at = np.searchsorted(lms, ordered)
    stop = np.append(lms[1:], lms[-1]) + 1
    length = (stop - lms)[at]
    same = length[1:] == length[:-1]
    size = length[1:][same]
    if len(size):
        start = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(start, size)
        equal = s[np.repeat(ordered[1:][same], size) + within] == s[np.repeat(ordered[:-1][same], size) + within]
        same[same] = np.logical_and.reduceat(equal, start)
    out = np.empty(len(lms), np.int64)
    out[at] = np.concatenate([[0], np.cumsum(~same)])
    return out


def sort_names(name: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes of a string of names (its last the unique least), by induced
    sorting again. Many names become two digits each, which keep their order; where that
    would not shorten the string (``longest`` symbols), they go in as they are."""
    top = int(name.max()) + 1
    if top <= DIGITS or 2 * len(name) + 1 > 0.9 * longest:
        return suffix_array(name)
    base = math.isqrt(top - 1) + 1
    digits = np.zeros(2 * len(name) + 1, np.int64)
    digits[:-1:2], digits[1::2] = name // base + 1, name % base + 1
    order = suffix_array(digits)
    return order[(order % 2 == 0) & (order < 2 * len(name))] // 2


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, length): for each suffix, in text order, its predecessor in the array
    (-1 for the first) and the length of their common prefix, exact up to ``cap`` and at
    least ``cap`` where it is longer. Symbols are under 2**16."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (s[:-1] == s[before[1:] - 1])
    start = np.flatnonzero(~reducible)
    most = np.append(start[1:], n) - start + cap  # what the suffixes that follow from it need
    word = np.zeros(n + 3, np.uint64)
    for k in range(4):
        word[: max(n - k, 0)] |= s[k:].astype(np.uint64) << np.uint64(16 * k)
    got = np.zeros(len(start), np.int64)
    left = np.flatnonzero(before[start] >= 0)
    while len(left):
        differ = word[start[left] + got[left]] ^ word[before[start[left]] + got[left]]
        got[left] += np.where(differ == 0, 4, np.where(differ & np.uint64(0xFFFF), 0, np.where(differ & np.uint64(0xFFFF0000), 1, np.where(differ & np.uint64(0xFFFF00000000), 2, 3))))
        left = left[(differ == 0) & (got[left] < most[left])]
    which = np.cumsum(~reducible) - 1
    return before, np.maximum(got[which] - (np.arange(n) - start[which]), 0)
