"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, store, text_or_empty

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
SEED = 17


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def keyed_draw(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed alone."""
    digest = F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":mix:{seed}")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row per source: its size, and the words that the mix should take from it.

    Sources in code-point order (null last) have the weights in turn. They share ``budget`` times
    all words by weight; no source gets more than ``cap`` times its own words, and what it leaves
    goes to the others by weight. That is the water level L with sum(min(cap_i, w_i * L)) = budget:
    with the sources by falling fill (cap_i / w_i), L is the largest of the levels that result when
    the first k are full. The windows without partitions run over one row per source.
    """
    sized = docs.groupBy("source").agg(F.sum(word_count()).alias("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(order) - 1) % len(weights)
    weighted = sized.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1).alias("weight")
    ).withColumn("room", F.col("source_size") * F.lit(cap))
    by_fill = W.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        weighted.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("room", F.col("weight") * F.col("level")).alias("target"))
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Decide how many copies of each document the mix takes; adds size, source_size, target, copies.

    A source's rate is target / source_size; a document is taken floor(rate) times, and once more
    if its own draw is below the fraction. Null or empty texts have size 0; a source without words
    has rate 0. A null source is a source of its own. Repeated doc_ids share a draw. An empty table
    gives an empty table. Columns of the input with one of the four names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    targets, _ = store(source_targets(docs, weights, budget, cap), "mix-targets")
    targets = targets.withColumnRenamed("source", "_mix_source")
    joined = docs.join(targets, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    once_more = (keyed_draw(F.col("doc_id"), seed) < rate - whole).cast("long")
    return joined.withColumn("size", word_count()).withColumn("copies", whole + once_more)


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy that ``mix_sources`` granted, numbered from 1 in ``copy``."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    return mix_sources(docs.select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
