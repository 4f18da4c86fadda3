"""Quality classifier: regularised quadratic discriminant over document statistics.

A text becomes a short vector of transformed statistics (logs of sizes, square
roots of shares). The labelled training rows, all of them, are reduced to counts, sums
and products per class in their partitions; those few hundred numbers give the
class means and covariances. A covariance is shrunk towards the pooled one and towards
its own mean variance, so its Cholesky factor exists; the factors are computed
once and sent with the scoring function. The score is the logistic function of the
tempered log-density difference from the Mahalanobis distances.

Defined cases: a null text counts as empty and gets a finite score like any
other; without labels of both classes the score is the smoothed share of label
1; labels other than 0 and 1 or null are not used, a label that is repeated counts once and a
doc_id labelled both ways for both classes; a null doc_id is not held out and never trained
on; an empty table gives an empty result; very long texts are read whole, their statistics
counted byte by byte; repeated rows and ties stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.scratch import Scratch


def _classes() -> np.ndarray:
    """Byte classes whose shares are statistics, as a 256 x k matrix."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"?()-", "!", "|<>{}[]\\/=_", "#$%&*+@^~", " \t\r\n"]
    out = np.zeros((256, len(groups) + 1))
    for k, chars in enumerate(groups):
        out[[ord(c) for c in chars], k] = 1
    out[128:, len(groups)] = 1
    return out


CLASSES = _classes()
D = CLASSES.shape[1] + 9


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics a text."""
    counts, rest = np.zeros((len(texts), 256)), np.zeros((len(texts), 8))
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts[k] = np.bincount(data, minlength=256)
        words, lines = text.split(), text.split("\n")
        title = sum(map(str.istitle, words)) if words else 0
        rest[k] = len(data), len(words), len(set(words)), len(lines), len(set(lines)), max(map(len, words), default=0), title, max(map(len, lines))
    size, words, distinct, lines, unlike, longest, title, line = rest.T
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    shares = np.sqrt(counts @ CLASSES / np.maximum(size, 1)[:, None])
    more = [np.log1p(size), np.log1p(words), np.log1p(size / np.maximum(words, 1)), share(distinct, words), share(unlike, lines), np.log1p(words / np.maximum(lines, 1)), np.log1p(longest), share(title, words), np.log1p(line)]
    return np.column_stack([shares, *more])


def described(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x array<double>), one per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = statistics([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """class -> (n, sum, sum of products) over all rows (x, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, D + 1, D + 1))
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            x = np.array(batch.column(0).to_pylist(), float).reshape(len(y), D)
            x = np.column_stack([np.ones(len(x)), x])
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["at", "v"])

    parts = rows.select("x", "label").mapInArrow(run, "at long, v double")
    total = np.zeros(2 * (D + 1) ** 2)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():  # 2 (D + 1)**2 rows
        total[r["at"]] = r["v"]
    total = total.reshape(2, D + 1, D + 1)
    return {c: (total[c, 0, 0], total[c, 0, 1:], total[c, 1:, 1:]) for c in (0, 1)}


class Discriminant:
    """Class means, Cholesky factors and log determinants, ready to score."""

    def __init__(self, sums: dict, pooled: float = 0.3, ridge: float = 0.02, temper: float = 0.5):
        self.n = {c: sums[c][0] for c in (0, 1)}
        self.temper = temper
        self.flat = (self.n[1] + 1) / (self.n[0] + self.n[1] + 2) if min(self.n.values()) < 2 else None
        if self.flat is not None:
            return
        means = {c: s / n for c, (n, s, _) in sums.items()}
        scatter = {c: p - n * np.outer(means[c], means[c]) for c, (n, _, p) in sums.items()}
        both = (scatter[0] + scatter[1]) / max(self.n[0] + self.n[1] - 2, 1)
        scale = np.sqrt(np.maximum(np.diag(both), 1e-8))
        self.scale, self.mean, self.factor, self.log_det = scale, means, {}, {}
        for c in (0, 1):
            cov = (1 - pooled) * scatter[c] / max(self.n[c] - 1, 1) + pooled * both
            cov = cov / np.outer(scale, scale)
            cov = (1 - ridge) * cov + ridge * np.mean(np.diag(cov)) * np.eye(D)
            low = np.linalg.cholesky(cov)
            self.factor[c] = np.linalg.inv(low)
            self.log_det[c] = 2 * np.log(np.diag(low)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        log = {}
        for c in (0, 1):
            z = ((x - self.mean[c]) / self.scale) @ self.factor[c].T
            log[c] = -0.5 * ((z * z).sum(axis=1) + self.log_det[c])
        gap = self.temper * (log[1] - log[0]) + np.log(self.n[1] / self.n[0])
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def held_out(key: Column, folds: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest`` modulo ``folds``."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == rest, F.lit(False))


def classify(scratch: Scratch, docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, rest: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    rows = scratch.save(described(docs))
    marks = labels.where(F.col(label).isin(0, 1)).where(~(F.crc32(F.col("doc_id").cast("string")) % folds == rest)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    model = Discriminant(moments(rows.join(marks, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, D)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
