"""Quality rules: exact base rules, then a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .quality_trees import training_labels
from .textstats import base_counts

#: Labelled rows to fit on, buckets for word and for character n-grams each, and fixed thresholds.
MAX_TRAIN_ROWS = 4_000
BUCKETS = 1 << 14
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.35
_WORDS_KNOWN = 300_000


class _Hashes(dict):
    """Stable 64-bit hashes of words; a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of words, and of all runs of 3 and 4 bytes, of the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    shift = np.uint64(64 - int(np.log2(buckets)))
    words = raw.split()
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(3) + one[1:]
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    three = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) + np.uint64(1) if len(b) > 2 else b[:0]
    four = three[:-1] << np.uint64(8) | b[3:] if len(b) > 3 else b[:0]
    return (np.concatenate([one, two]) * _ODD >> shift).astype(np.int64), (np.concatenate([three, four]) * _ODD >> shift).astype(np.int64)


@dataclass
class GramModel:
    """Weights on the shares of the buckets, and the line that turns a margin into a probability."""

    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, text: str) -> float:
        word, char = gram_buckets(text, len(self.word))
        margin = self.bias + (self.word[word].mean() if len(word) else 0.0) + (self.char[char].mean() if len(char) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


@dataclass
class Sparse:
    """Rows of shares in compressed form: the columns and values of row i lie from ends[i] to ends[i + 1]."""

    ends: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def block(self, a: int, b: int) -> Sparse:
        lo, hi = self.ends[a], self.ends[b]
        return Sparse(self.ends[a : b + 1] - lo, self.cols[lo:hi], self.vals[lo:hi])

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.vals * w[self.cols])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


def _descend(x: Sparse, y: np.ndarray, fit: np.ndarray, width: int, steps: int = 150, rows: int = 512) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with Adam over the rows to fit, a block of rows at a time."""
    w, m, v, bias, mb, vb = np.zeros(width), np.zeros(width), np.zeros(width), 0.0, 0.0, 0.0
    blocks = [(x.block(a, min(a + rows, len(y))), slice(a, min(a + rows, len(y)))) for a in range(0, len(y), rows)]
    for t in range(1, steps + 1):
        g, gb = 1e-7 * w, 0.0
        for part, at in blocks:
            err = np.where(fit[at], 1 / (1 + np.exp(-np.clip(part.times(w) + bias, -30, 30))) - y[at], 0.0) / fit.sum()
            g += np.bincount(part.cols, part.vals * np.repeat(err, np.diff(part.ends)), width)
            gb += err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.5 * (m / up) / (np.sqrt(v / down) + 1e-10)
        bias -= 0.05 * (mb / up) / (np.sqrt(vb / down) + 1e-10)
    return w, float(bias)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets; stays the identity if it can't be fitted."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h, g = p * (1 - p) + 1e-9, p - target
        haa, hab, hbb = (h * margin * margin).sum() + 1e-6, (h * margin).sum(), h.sum()
        ga, gb, det = (g * margin).sum(), g.sum(), haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return (float(a), float(b)) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def fit_gram_model(x: Sparse, y: np.ndarray, buckets: int = BUCKETS) -> GramModel:
    """Fit on four fifths of the sample, calibrate on the rest; without both labels, always 1/2."""
    if len(y) < 10 or y.min() == y.max():
        return GramModel(np.zeros(buckets), np.zeros(buckets), 0.0)
    fit = np.arange(len(y)) % 5 != 0
    w, bias = _descend(x, y, fit, 2 * buckets)
    margin = bias + np.concatenate([x.block(a, min(a + 512, len(y))).times(w) for a in range(0, len(y), 512)])
    slope, shift = _platt(margin[~fit], y[~fit])
    return GramModel(w[:buckets], w[buckets:], bias, slope, shift)


def _shares(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        cols, vals = [], []
        for text in texts:
            word, char = gram_buckets(text)
            w, nw = np.unique(word, return_counts=True)
            c, nc = np.unique(char, return_counts=True)
            cols.append(np.concatenate([w, c + BUCKETS]).astype(np.int32))
            vals.append(np.concatenate([nw / max(len(word), 1), nc / max(len(char), 1)]).astype(np.float32))
        yield pd.DataFrame({"cols": pd.Series(cols, dtype=object), "vals": pd.Series(vals, dtype=object)})


def fit_quality_rules(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS) -> GramModel:
    """N-gram shares of at most ``most`` labelled rows are fitted in one task; the driver gets the weights.

    Each row holds at most 2 * BUCKETS shares of 8 bytes, so the task's memory has a bound whatever
    the corpus. Of rows that repeat a doc_id one counts. Null labels, labels outside 0 and 1, and
    null ids are left out; without both labels every probability is 1/2.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, cols, vals, y = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(0)]
        for batch in batches:
            size.append(pc.list_value_length(batch.column("cols")).to_numpy(zero_copy_only=False))
            cols.append(batch.column("cols").flatten().to_numpy().copy())
            vals.append(batch.column("vals").flatten().to_numpy().copy())
            y.append(batch.column("quality").to_numpy().astype(float))
        model = fit_gram_model(Sparse(np.cumsum(np.concatenate(size)), np.concatenate(cols), np.concatenate(vals)), np.concatenate(y))
        weights = np.concatenate([model.word, model.char, [model.bias, model.slope, model.shift]])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    chosen = F.broadcast(training_labels(labels, most))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.max("text").alias("text"))
    rows = rows.select("doc_id", "quality", F.pandas_udf(_shares, "cols array<int>, vals array<float>")(text_or_empty()).alias("x"))
    rows = rows.select("doc_id", "quality", "x.*").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = rows.mapInArrow(fit, "weights binary").first()
    if found is None:
        return GramModel(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0)
    fitted = np.frombuffer(found["weights"])
    return GramModel(fitted[:BUCKETS].copy(), fitted[BUCKETS : 2 * BUCKETS].copy(), *map(float, fitted[2 * BUCKETS :]))


_JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def judge_quality(docs: DataFrame, model: GramModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds the base counts, base_failed, the calibrated probability of quality 1, and kept.

    A text fails the base rules with fewer than MIN_WORDS words, or if more than
    MAX_REPEAT_PERCENT of its words lie in repeated 8-word windows. Others are kept if their
    probability is at least ``keep_from``. Null counts as empty, which has no words and fails.
    Clashing input columns are replaced; rows are judged one by one, repeated rows and
    null ids like any other, without a shuffle; an empty table stays empty.
    """

    @F.pandas_udf(_JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _JUDGED.split(", ")]
        for texts in batches:
            rows = []
            for text in texts:
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                p = model.probability(text)
                rows.append((*counts, failed, p, not failed and p >= keep_from))
            yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in _JUDGED.split(", ")]
    judged = docs.drop(*names).withColumn("_judged", judge(text_or_empty()))
    return judged.select("*", "_judged.*").drop("_judged")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_quality(docs.select("doc_id", "text"), fit_quality_rules(docs, labels)).drop("text")
