"""Toxicity by a subsequence string-kernel support vector machine.

The unit is a word (or a run of single characters: "i d i o t"). Two units are
compared by the gap-weighted subsequence kernel: the sum over shared subsequences of
``ORDER`` characters of decay ** (spanned length), normalised; gaps and inserted
characters lower it gently instead of breaking it. Landmark units, the words most
telling of toxic training texts and the clean words most like them, give the Nystroem
map, on which a linear squared-hinge SVM is trained. Labels stand on texts, so
training is multi-instance: of a toxic text, the sentences' best units are the witnesses,
of a clean text every unit is an example, and witnesses are chosen again by the
machine so far. A text's score is a logistic function of its best unit.

A worker scores each distinct unit once (cache bounded in characters). Kernels are
only computed for pairs whose longest common subsequence, found bit-parallel, has
ORDER characters; all others are exactly zero. A unit that meets no landmark of positive
weight cannot pass FLOOR and needs no kernel at all.

Training reads at most ``SAMPLE`` labelled texts a class (by hash order of doc_id), in one
executor task that hands back the landmarks and their weights only; scoring reads every
whole text. Defined cases: a null text counts as empty; a text without units gets the
score of the lowest unit, and so does every text of an empty vocabulary; an empty table
gives an empty result; without labels of both classes every score is the smoothed share of
label 1; a doc_id labelled both ways counts as toxic; of rows that repeat a doc_id one text,
the least, is learned from; ties between landmarks go by code point; a null doc_id is not held
out and not learned from; repeated rows stay; very long texts are read whole, words of over
LONGEST characters in overlapping windows; other columns pass through ``scored`` untouched.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.quality import held_out

ORDER, DECAY, LONGEST, STEP, LANDMARK_CHARS = 4, 0.7, 32, 16, 16
SAMPLE = 2000
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
EDGES = ".,;:!?\"'()[]{}«»¿¡-_*"


def words_of(text: str) -> set[str]:
    """The distinct raw units of a text: its words and its spelled-out runs."""
    low = text.lower()
    out = set(low.split())
    for m in SPELLED.finditer(low):
        out.add("".join(m[0].split()))
    return out


def pieces(word: str) -> list[str]:
    """A raw unit as scored: edge punctuation off, windows where it is long;
    where it holds other characters than letters, its letters alone as well."""
    word = word.strip(EDGES)
    forms = [word] if word.isalpha() else [word, "".join(filter(str.isalpha, word))]
    return [w[k : k + LONGEST] for w in forms for k in ([0] if len(w) <= LONGEST else range(0, len(w) - STEP, STEP))]


def as_codes(items: list[str], width: int) -> np.ndarray:
    """Code points of each item, padded with zeros."""
    text = "".join(x.ljust(width, "\0") for x in items)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(items), width)


def discount(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.where(k[:, None] >= k, DECAY ** np.maximum(k[:, None] - k, 0.0), 0).astype(np.float32)


def kernel(equal: np.ndarray) -> np.ndarray:
    """Unnormalised kernels of pairs from their equality matrices (pairs, n, m)."""
    match = np.float32(DECAY * DECAY) * equal
    rows, cols = discount(equal.shape[1]), discount(equal.shape[2]).T
    before = np.ones_like(match)
    for _ in range(ORDER - 1):
        inner = rows @ (match * before) @ cols
        before = np.zeros_like(match)
        before[:, 1:, 1:] = inner[:, :-1, :-1]
    return (match * before).sum(axis=(1, 2), dtype=np.float64)


def equality(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] != 0)).astype(np.float32)


class Landmarks:
    """Normalised kernels of units against fixed landmark units."""

    def __init__(self, items: list[str]):
        self.items = items
        self.codes = as_codes(items, LANDMARK_CHARS)
        self.own = kernel(equality(self.codes, self.codes))
        alphabet = sorted({ord(c) for x in items for c in x})
        self.alphabet = np.array(alphabet or [1], np.uint32)
        self.masks = np.zeros((len(self.alphabet) + 1, len(items)), np.uint32)
        for j, x in enumerate(items):
            for k, c in enumerate(x):
                self.masks[1 + int(np.searchsorted(self.alphabet, ord(c))), j] |= np.uint32(1 << k)
        self.full = np.array([(1 << len(x)) - 1 for x in items], np.uint32)
        self.wanted = np.ones(len(items), bool)  # of these a unit must meet one

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, landmark) indices with a common subsequence of ORDER characters."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        at = np.where(self.alphabet[at] == codes, at + 1, 0)
        rest = np.full((len(codes), len(self.items)), 0xFFFFFFFF, np.uint32)
        for t in range(codes.shape[1]):
            hit = rest & self.masks[at[:, t]]
            rest = (rest + hit) | (rest & ~hit)
        met = np.bitwise_count(~rest & self.full) >= ORDER
        return np.nonzero(met & (met & self.wanted).any(axis=1)[:, None])

    def similar(self, units: list[str], sink, chunk: int = 2048) -> None:
        """Calls sink(positions, landmarks, values) for the kernels that are not zero."""
        by_width: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            if len(u) >= ORDER:
                by_width.setdefault(8 if len(u) <= 8 else 16 if len(u) <= 16 else LONGEST, []).append(k)
        for width, places in by_width.items():
            for s in range(0, len(places), chunk):
                spots = np.array(places[s : s + chunk])
                codes = as_codes([units[k] for k in spots], width)
                i, j = self.shared(codes)
                if not len(i):
                    continue
                which, back = np.unique(i, return_inverse=True)
                own = kernel(equality(codes[which], codes[which]))
                for p in range(0, len(i), chunk):
                    a, b = i[p : p + chunk], j[p : p + chunk]
                    value = kernel(equality(codes[a], self.codes[b])) / np.sqrt(own[back[p : p + chunk]] * self.own[b])
                    sink(spots[a], b, value)

    def matrix(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(self.items)))

        def put(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
            out[i, j] = v

        self.similar(units, put)
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the active set; y is -1 or 1."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    reg = ridge * weight.sum() * np.eye(len(w))
    reg[-1, -1] *= 1e-3
    for _ in range(rounds):
        on = y * (z @ w) < 1
        a = z[on] * weight[on, None]
        new = np.linalg.solve(z[on].T @ a + reg, a.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic fit with a slight prior."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
        w -= np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


class Machine:
    """Trained on (units of a text, label) pairs; scores texts."""

    FLOOR, CACHE = -0.5, 1 << 21  # characters of cached units: some tens of megabytes a worker

    def __init__(self, texts: list[tuple[set[str], int]], landmarks: int = 32):
        y = np.array([t for _, t in texts])
        self.flat = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
        self.forget()
        if self.flat is not None:
            return
        texts = list({frozenset(u): (u, t) for u, t in sorted(texts, key=lambda x: x[1])}.values())  # copies teach nothing new
        y = np.array([t for _, t in texts])
        bags = [{p for w in units for p in pieces(w) if ORDER <= len(p)} for units, _ in texts]
        n = [max(1, int((y == c).sum())) for c in (0, 1)]
        count = [Counter(u for bag, t in zip(bags, y, strict=True) if t == c for u in bag) for c in (0, 1)]
        base, bar = n[1] / sum(n), np.log(20 * max(len(count[1]), 1))  # a word must beat chance over all words tried

        def evidence(k: int, c: int) -> float:
            share = k / (k + c)
            return k * np.log(share / base) + (c * np.log((1 - share) / (1 - base)) if c else 0.0) if share > base else 0.0

        odds = {u: np.log((k + 0.5) / (n[1] + 1)) - np.log((count[0][u] + 0.5) / (n[0] + 1)) for u, k in count[1].items() if evidence(k, count[0][u]) > bar}
        telling = sorted((u for u in odds if odds[u] > 1.5 and len(u) <= LANDMARK_CHARS), key=lambda u: (-count[1][u] * odds[u], u))[:landmarks]
        if not telling:
            self.flat = (y.sum() + 1) / (len(y) + 2)
            return
        first = Landmarks(telling)
        clean = sorted(count[0], key=lambda u: (-count[0][u], u))
        like = first.matrix(clean).max(axis=1)
        order = np.argsort(-like, kind="stable")
        confusable = [clean[k] for k in order if len(clean[k]) <= LANDMARK_CHARS and odds.get(clean[k], 0) < 0.5][:16]
        self.landmarks = Landmarks(telling + confusable)
        gram = self.landmarks.matrix(self.landmarks.items)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        good = value > 1e-6 * value.max()
        whiten = vector[:, good] / np.sqrt(value[good])
        negative = [clean[k] for k in order if like[k] > 0.02][: 1 << 14]
        x0 = self.landmarks.matrix(negative) @ whiten
        c0 = np.array([count[0][u] for u in negative], float)
        units = sorted({u for bag, t in zip(bags, y, strict=True) if t for u in bag})
        x1 = self.landmarks.matrix(units) @ whiten
        place = {u: k for k, u in enumerate(units)}
        rank = np.array([odds.get(u, -9.0) for u in units])
        least = 1.5
        gapped = [u[:k] + "\1" + u[k:] for u in telling for k in range(1, len(u))]  # a stranger inserted
        x2 = self.landmarks.matrix(gapped) @ whiten
        for _ in range(3):
            witness = Counter()
            for bag, t in zip(bags, y, strict=True):
                if t:
                    for k in (place[u] for u in bag):
                        if rank[k] > least:
                            witness[k] += 1
            ones = np.array(sorted(witness), int)
            c1 = np.array([witness[k] for k in ones], float)
            unlike = np.zeros((1, x0.shape[1]))  # stands for the many units unlike any landmark
            x = np.vstack([x1[ones], x2, x0, unlike])
            t = np.concatenate([np.ones(len(ones) + len(x2)), -np.ones(len(x0) + 1)])
            w = np.concatenate([np.sqrt(c1) / max(np.sqrt(c1).sum(), 1), np.full(len(x2), 0.5 / len(x2)), np.sqrt(c0) / max(np.sqrt(c0).sum(), 1), [1.0]])
            slope, self.shift = svm(x, t, w)
            rank, least = x1 @ slope + self.shift, 0.0
        self.beta = whiten @ slope
        self.landmarks.wanted = self.beta > 0
        self.CACHE = math.inf  # all training texts at once
        self._learn(set().union(*(u for u, _ in texts)))
        best = np.array([self.best(u) for u, _ in texts])
        del self.CACHE
        self.a, self.c = logistic(best, y)
        self.forget()

    def forget(self) -> None:
        self.cold: set[str] = set()
        self.hot: dict[str, float] = {}
        self.held = 0

    def _learn(self, units: set[str]) -> None:
        """Puts the units of a block of texts into the cache, which is emptied only here."""
        if self.held > self.CACHE:
            self.forget()
        words = [u for u in units - self.cold if u not in self.hot]
        self.held += sum(map(len, words))
        parts, owner = [], []
        for k, w in enumerate(words):
            for p in pieces(w):
                parts.append(p)
                owner.append(k)
        value = np.full(len(parts), self.shift)

        def add(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
            np.add.at(value, i, self.beta[j] * v)

        self.landmarks.similar(parts, add)
        best = np.full(len(words), self.FLOOR)
        np.maximum.at(best, owner, value)
        for w, f in zip(words, best.tolist(), strict=True):
            if f > self.FLOOR:
                self.hot[w] = f
            else:
                self.cold.add(w)

    def best(self, units: set[str]) -> float:
        """The largest value of a text's units, all of them learned, not below FLOOR."""
        return max((self.hot[u] for u in units - self.cold), default=self.FLOOR)

    def scores(self, texts: list[str], block: int = 1 << 20) -> list[float]:
        if self.flat is not None:
            return [float(self.flat)] * len(texts)
        best, k = [], 0
        while k < len(texts):
            units, room = [], block
            while k < len(texts) and room > 0:
                units.append(words_of(texts[k]))
                room -= len(texts[k]) + 1
                k += 1
            self._learn(set().union(*units))
            best += [self.best(u) for u in units]
        return (1 / (1 + np.exp(-np.clip(self.a * np.array(best) + self.c, -500, 500)))).tolist()

    def __getstate__(self):
        return self.__dict__ | {"cold": set(), "hot": {}, "held": 0}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, rest: int = 0, sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled texts of each class, fitted by one
    executor task; the driver gets the finished machine (at most 48 landmarks) alone."""
    key = F.col("doc_id")
    marks = labels.where(F.col(label).isin(0, 1)).where(~(F.crc32(key.cast("string")) % folds == rest)).select("doc_id", F.col(label).cast("int").alias("t")).distinct()
    picked = [marks.where(F.col("t") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * sample rows, so small enough to send out
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "t").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "t")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool: dict[str, str] = {}  # one string a unit, however many texts hold it
        got = [({pool.setdefault(w, w) for w in words_of(text or "") if len(w) >= ORDER}, t) for part in batches for text, t in zip(part["text"], part["t"], strict=True)]
        yield pd.DataFrame({"machine": [pickle.dumps(Machine(got))]})

    made = rows.select("text", "t").mapInPandas(fit, "machine binary").collect()  # one row at most
    return pickle.loads(made[0]["machine"]) if made else Machine([])


def scored(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text as a further column."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = sent.value
        for part in texts:
            yield pd.Series(held.scores([t or "" for t in part]), dtype="float64")

    return docs.withColumn(column, score("text"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, rest: int = 0, **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, folds=folds, rest=rest, **options))
    return out.select("doc_id", held_out(F.col("doc_id"), folds, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
