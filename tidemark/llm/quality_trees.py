"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .textstats import NAMES, features

#: Labelled rows to fit on: those with the smallest keyed hash. More labels don't change the cost.
MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 1.0


@dataclass
class Forest:
    """Complete trees of one depth as arrays: node k's children are 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees at once, one level a step."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            f = self.feature[trees, node]
            node = 2 * node + 1 + (np.take_along_axis(x, f, axis=1) > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Second-order boosting of the log loss on binned features; splits by the histograms' gain.

    Without rows, or with one label only, the forest gives the (smoothed) share of label 1.
    """
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    if n == 0 or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    offset = np.arange(width) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * width * bins + offset + binned).ravel()
            g = np.bincount(cell, np.repeat(grad, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hess, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(h < 1) | (ht - h < 1)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[k, f, cut] > 1e-6 and cut < len(cuts[f]):
                    forest.feature[t, first + k], forest.threshold[t, first + k] = f, cuts[f][cut]
            at = forest.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), at] > forest.threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        forest.leaf[t] = -RATE * g / (h + L2)
        margin += forest.leaf[t][leaf]
    return forest


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in any fit: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out part: those with the least hash of the id.

    Where there are many more, a bound on the hash, about a fifth above what is needed, comes first,
    so that each task hands on its share of the sample and not ``most`` rows of its own. Null ids and
    labels other than 0 and 1 are left out; of several labels of an id the greatest counts.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = 1.2 * (most + 1000) / max(usable.count(), 1)
    if share < 1:
        usable = usable.filter(F.xxhash64("doc_id") < F.lit(int(-(2**63) + share * 2**64)))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts], dtype=object)


def fit_quality_trees(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS) -> Forest:
    """Statistics are computed on the executors; only ``most`` rows of them reach the driver.

    The labels' side of the join has a bound, ``most``, so it is broadcast. Of rows that repeat a
    doc_id one counts, the same in every run. Without usable labels every score is 0.5.
    """
    chosen = F.broadcast(training_labels(labels, most))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", F.pandas_udf(_features, "array<double>")(text_or_empty()).alias("x"))
    rows = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES))
    return fit_forest(x, rows["quality"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """Adds ``out``: how likely label 1 is, from the text alone, between 0 and 1.

    Null and empty texts have all statistics zero and get the score of that. Rows are scored one by
    one, repeated rows and null ids like any other; nothing is shuffled. A clashing ``out`` column is replaced; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES))
            yield pd.Series(forest.score(x) if len(texts) else np.zeros(0))

    return docs.withColumn(out, score(text_or_empty()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text"), fit_quality_trees(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
