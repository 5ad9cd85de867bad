"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store

MAX_ROUNDS = 60


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least of u and all v that stand beside the same u.

    The least is combined before the shuffle; the join back is one whose skew Spark can split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u <> v").distinct()
    small = _with_least(large)
    moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): the least id reachable, for every id in a link that isn't its own least.

    Alternating large-star and small-star steps end with every node linked to its least one, after
    about log(n) rounds whatever the shape; each round is a table in the shared folder. Links of an
    id with itself or with null are no links. Ids without a row are components of their own.
    """
    a, b = F.col(left), F.col(right)
    links = links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = links.sparkSession
    links, path = store(links, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        links, new = store(_round(links), "links")
        discard(spark, path)
        path = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
