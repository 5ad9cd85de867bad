"""Exact nearest neighbours of a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 2048


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(q, key, cosine, rank): the k rows most like each query, itself left out; ties by key.

    Each task compares its rows, a batch at a time, with one block of queries and keeps k per query;
    the shuffle sees only those. Rows are repeated per block of queries, never paired with single
    queries. Null, empty, zero and non-finite vectors have no neighbours.
    """
    name = queries.schema[key].dataType.simpleString()
    blocks = max(1, -(-queries.count() // BLOCK))
    part = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    asked = queries.select(part.alias("block"), F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("x"))
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("q", "x")).alias("asked"))
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    met = held.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows.count() // BLOCK)))).alias("tile")).agg(F.collect_list(F.struct("id", "v")).alias("tile_rows"))

    def unit(items) -> tuple[np.ndarray, np.ndarray]:
        sound = [(i["id"] if "id" in i else i["q"], np.asarray(i["v"] if "v" in i else i["x"], float)) for i in items if (i.get("v") if "v" in i else i.get("x")) is not None]
        sound = [(i, v) for i, v in sound if v.size and np.isfinite(v).all() and v.any()]
        ids = np.array([i for i, _ in sound], np.int64)
        return ids, np.stack([v / np.linalg.norm(v) for _, v in sound]) if sound else np.zeros((0, 1))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for asked_rows, tile in zip(frame["asked"], frame["tile_rows"], strict=True):
                q, x = unit(asked_rows)
                i, v = unit(tile)
                if not len(q) or not len(i):
                    continue
                cosine = np.round(x @ v.T, 6)
                cosine[q[:, None] == i[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(i, cosine.shape), -cosine), axis=1)[:, :k]
                best = np.take_along_axis(cosine, order, axis=1)
                out = pd.DataFrame({"q": np.repeat(q, order.shape[1]), "id": i[order].ravel(), "cosine": best.ravel()})
                yield out[np.isfinite(out["cosine"])]

    found = met.crossJoin(asked).select("asked", "tile_rows").mapInPandas(compare, "q long, id long, cosine double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").cast(name), F.col("id").cast(name).alias(key), "cosine", "rank")
