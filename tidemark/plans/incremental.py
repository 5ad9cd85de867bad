"""Incremental views: joins and counts of signed deltas that equal a full recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_delta(view: DataFrame, delta: DataFrame) -> DataFrame:
    """View and delta have a column ``n`` of support counts; what falls to zero goes."""
    keys = [c for c in view.columns if c != "n"]
    both = view.unionByName(delta.select(view.columns))
    return both.groupBy(*keys).agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")


def join_delta(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str]) -> DataFrame:
    """The change of a join b when a changes by da and b by db: three joins with a delta on one side at least.

    All four have a signed count ``n``; counts multiply.
    """

    def pair(x: DataFrame, y: DataFrame) -> DataFrame:
        out = x.withColumnRenamed("n", "_nx").join(y.withColumnRenamed("n", "_ny"), on)
        return out.withColumn("n", F.col("_nx") * F.col("_ny")).drop("_nx", "_ny")

    changed = pair(da, b).unionByName(pair(a, db)).unionByName(pair(da, db))
    keys = [c for c in changed.columns if c != "n"]
    return changed.groupBy(*keys).agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")


def regroup(groups: DataFrame, rows: DataFrame, delta: DataFrame, by: list[str], aggregate) -> DataFrame:
    """Groups of an aggregate that can't be inverted: only those that the delta touches are computed anew."""
    hit = delta.select(*by).distinct()
    kept = groups.join(hit, by, "left_anti")
    return kept.unionByName(aggregate(rows.join(hit, by, "left_semi")).select(groups.columns))
