"""Hashed n-gram logistic regression in numpy: features, training, calibration, scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, word_hashes

_MUL = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


@dataclass
class HashedLinear:
    """Features: shares of a text's hashed character n-grams (and words and word pairs), all of them. Score: a logistic of their weighted sum.

    With ``log_ratio`` every feature is scaled by its naive Bayes log-count ratio before the regression. Training streams over the
    texts: it holds a few numbers for each of the 2 ** ``bits`` features, whatever the number of texts and their length.
    A text without features scores the logistic of the bias.
    """

    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    words: bool = False
    lower: bool = True
    log_ratio: bool = True
    #: Length of the regression's steps, and its passes over the texts.
    step: float = 0.1
    passes: int = 4
    #: Shares are of a text's features and so many more: a short text is drawn to the bias.
    smooth: int = 800
    #: Weight of the rows of class 1 in training, of 1 for both.
    part: float = 0.5
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)  # calibration: a * score + b
    weights: np.ndarray = field(default=None, repr=False)

    def indexes(self, text: str) -> np.ndarray:
        """The bucket of every feature occurrence of the whole text."""
        if self.lower:
            text = text.lower()
        c = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32)
        shift, out, h = np.uint32(32 - self.bits), [], c
        for n in range(2, max(self.sizes) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * _MUL + c[n - 1 :] * _SPREAD
            if n in self.sizes:
                out.append((h * _SPREAD) >> shift)
        if self.words:
            w = word_hashes(text.encode())
            out.append((w >> np.uint64(64 - self.bits)).astype(np.uint32))
            if len(w) > 1:
                out.append(((w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) >> np.uint64(64 - self.bits)).astype(np.uint32))
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def fit(self, texts: Sequence[str], labels: Sequence[int], calibrate: float = 0.0) -> HashedLinear:
        """Train on labelled texts; with ``calibrate``, that share of them (every k-th) fits the calibration instead."""
        y = np.asarray(labels, float)
        own = np.ones(len(y), bool)
        if calibrate:
            own[:: max(2, round(1 / calibrate))] = False
        self.weights = np.zeros(1 << self.bits, np.float32)
        if not len(y) or y[own].min(initial=1) == y[own].max(initial=0):
            self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
            return self
        n1, n0 = y[own].sum(), (1 - y[own]).sum()
        if self.log_ratio:
            held = np.zeros((2, 1 << self.bits), np.float32)
            for k in np.flatnonzero(own):
                held[int(y[k]), np.unique(self.indexes(texts[k]))] += 1
            ratio = (np.log((held[1] + 0.5) / (n1 + 1)) - np.log((held[0] + 0.5) / (n0 + 1))).astype(np.float32)
        else:
            ratio = np.ones(1 << self.bits, np.float32)
        self._regress([(texts[k], y[k]) for k in np.flatnonzero(own)], ratio, len(y[own]) * np.array([(1 - self.part) / n0, self.part / n1]))
        if calibrate:
            self.scale = _platt(np.array([self._raw(texts[k]) for k in np.flatnonzero(~own)]), y[~own])
        return self

    def _regress(self, rows: list[tuple[str, float]], ratio: np.ndarray, share: np.ndarray) -> None:
        """Logistic regression by gradient steps, text by text, each feature's steps shortened by its own gradients so far. share: weights of the two classes' texts."""
        w, sums = self.weights, np.full(1 << self.bits, 1e-6, np.float32)
        b, own_sum = 0.0, 1e-6
        for _ in range(self.passes):
            for text, label in rows:
                at = self.indexes(text)
                r, unit = ratio[at], 100 / max(1, len(at) + self.smooth)
                z = b + unit * float(w[at] @ r)
                g = float((1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) - label) * share[int(label)])
                move = r * np.float32(g * unit)
                np.add.at(sums, at, move * move)
                np.subtract.at(w, at, np.float32(self.step) * move / np.sqrt(sums[at]))
                own_sum += g * g
                b -= self.step * g / own_sum**0.5
        w *= ratio * np.float32(100)
        self.bias = float(b)

    def _raw(self, text: str) -> float:
        idx = self.indexes(text)
        return self.bias + (float(self.weights[idx].sum(dtype=np.float64)) / (len(idx) + self.smooth) if len(idx) else 0.0)

    def score(self, text: str) -> float:
        """Probability of label 1."""
        z = self.scale[0] * self._raw(text) + self.scale[1]
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: the logistic of a * s + b fitted by Newton steps on smoothed targets; a stays positive."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    mean, spread = s.mean(), s.std() or 1.0
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, ab = np.stack([(s - mean) / spread, np.ones_like(s)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (p - t)), -0.5, 0.5)
    return (float(ab[0] / spread), float(ab[1] - ab[0] * mean / spread)) if ab[0] > 0 else (1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, fold: int | None = 0, folds: int = 5) -> DataFrame:
    """y, rank, id, text of at most ``most`` labelled texts of each class, those whose ids hash lowest.

    The bound is this parameter; fitting on a bounded sample is all it limits. Rows whose
    crc32(doc_id as text) mod ``folds`` is ``fold`` aren't used. The ids are drawn from the label
    table alone, so the broadcast side has at most ``2 * most`` rows. Of an id with several texts the least one counts.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if fold is not None:
        usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    rank = F.xxhash64(F.col("doc_id"), F.lit(11))
    drawn = None
    for value in (0, 1):
        one = usable.where(F.col(label) == value).select(F.col("doc_id").alias("id"), F.lit(value).alias("y"), rank.alias("rank")).distinct().orderBy("rank", "id").limit(most)
        drawn = one if drawn is None else drawn.union(one)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "id").groupBy("id", "y", "rank").agg(F.min("text").alias("text")).select("y", "rank", "id", "text")


def fit_sample(model: HashedLinear, sample: DataFrame, calibrate: float = 0.0) -> HashedLinear:
    """``model`` fitted to a bounded sample (y, rank, id, text) in one task; its weights (2 ** bits numbers) come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, texts = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            texts += b.column(3).to_pylist()
        model.fit(texts, y, calibrate)
        row = [[model.bias], [model.scale[0]], [model.scale[1]], [model.weights.tobytes()]]
        y, texts, model.weights = [], [], None
        release()
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, [pa.float64()] * 3 + [pa.binary()], strict=True)], names=["bias", "a", "b", "weights"])

    one = sample.repartition(1).sortWithinPartitions("rank", "id", "y").mapInArrow(run, "bias double, a double, b double, weights binary")
    got = one.toArrow()
    if not len(got):  # an empty sample may have no task
        return model.fit([], [])
    model.bias, model.scale = got["bias"][0].as_py(), (got["a"][0].as_py(), got["b"][0].as_py())
    model.weights = np.frombuffer(got["weights"][0].as_py(), np.float32)
    return model
