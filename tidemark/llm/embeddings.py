"""Embedding near-dedup: an exact cosine join by pigeonhole over blocks of rotated vectors.

For unit vectors cosine >= t means squared distance <= 2 - 2t. Split into B blocks of coordinates,
some block must differ by at most 1/B of that, so the union of one range join per block holds every
pair. A fixed random rotation spreads the variance evenly over the blocks first.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .components import connected_components

THRESHOLD = 0.95
BLOCKS = 4
#: Vectors on either side of one range-join task, and rows of a distance tile within it.
TASK_ROWS = 8192
TILE = 512
_SLACK = 1e-5
#: Steps of a rotated coordinate, and of the factors that it is made of. Whole numbers of these sizes add up
#: without rounding, so a block's distance is the same number in every task.
_GRID, _FINE = 2.0**24, 2.0**26
_CELLS = "block int, cell string, vec_id long, copies long, vector binary"
_FOUND = "vec_id long, other long, links long"


@functools.cache
def rotation(width: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _edges(width: int, blocks: int) -> list[slice]:
    at = np.linspace(0, width, min(blocks, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


def _turned(units: np.ndarray) -> np.ndarray:
    """Rotated vectors in whole steps of the grid."""
    return np.rint(np.rint(units * _FINE) @ np.rint(rotation(units.shape[1]) * _FINE) * (_GRID / _FINE**2))


def _within(a: np.ndarray, b: np.ndarray, budget: float) -> np.ndarray:
    """Which rows of two blocks on the grid differ by at most the budget: the one test of what a block finds."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap) <= budget * _GRID**2


def _cells(vectors: DataFrame, blocks: int, axes: int, budget: float) -> DataFrame:
    """A row per vector and block, with its cell.

    Cells are cubes over the block's first ``axes`` coordinates. Their edge is the block's radius in
    whole steps of the grid, so whatever the one test finds is in a cell that touches. Only vectors
    of equal width meet.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for width, part in frame.groupby(frame["vector"].map(len) // 8):
                turned = _turned(_unit(_stack(part["vector"])))
                parts = _edges(width, blocks)
                edge = math.ceil(math.sqrt(_budget(budget, len(parts))) * _GRID) + 1
                for b, cut in enumerate(parts):
                    at = np.floor_divide(turned[:, cut][:, :axes], edge).astype(int)
                    yield pa.RecordBatch.from_pandas(
                        pd.DataFrame({
                            "block": np.int32(b), "cell": [f"{width}:" + ",".join(map(str, x)) for x in at],
                            "vec_id": part["vec_id"].to_numpy(), "copies": part["copies"].to_numpy(), "vector": part["vector"].to_numpy(),
                        }),
                        preserve_index=False, schema=_cells_schema(),
                    )

    return vectors.select("vec_id", "copies", "vector").mapInArrow(place, _CELLS)


def _cells_schema() -> pa.Schema:
    return pa.schema([("block", pa.int32()), ("cell", pa.string()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary())])


def _budget(budget: float, parts: int) -> float:
    """The share of the squared distance that a block may use: rounding must not lose a pair that links."""
    return budget / parts + _SLACK


def _after(cell: str) -> list[str]:
    """The cells that touch a cell and come after it, so that each pair of cells meets once."""
    width, at = cell.split(":")
    at = [int(x) for x in at.split(",")]
    ahead = [s for s in itertools.product((-1, 0, 1), repeat=len(at)) if s > (0,) * len(at)]
    return [f"{width}:" + ",".join(str(x + d) for x, d in zip(at, s, strict=True)) for s in ahead]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _range_join(block: int, left: pd.DataFrame, right: pd.DataFrame, same: bool, blocks: int, threshold: float) -> pd.DataFrame:
    """Links between two sets: counts per vector, and the pairs of a spanning forest.

    Pairs within the block's budget are candidates. One that an earlier block also finds is left to
    that block, so that each is verified and counted once without comparing lists of pairs.
    """
    a, b = _unit(_stack(left["vector"])), _unit(_stack(right["vector"]))
    parts = _edges(a.shape[1], blocks)
    budget = _budget(2 - 2 * threshold, len(parts))
    ra, rb = _turned(a), _turned(b)
    sub = (rb[:, parts[block]] / _GRID).astype(np.float32)
    square = np.einsum("ij,ij->i", sub, sub)
    many_a, many_b = left["copies"].to_numpy(), right["copies"].to_numpy()
    links_a, links_b, forest, kept = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), _Forest(len(a) + len(b)), []
    if same:
        for k in range(len(a)):
            forest.join(k, len(a) + k)
    for at in range(0, len(a), TILE):
        own = (ra[at : at + TILE, parts[block]] / _GRID).astype(np.float32)
        first = at if same else 0
        far = np.einsum("ij,ij->i", own, own)[:, None] + square[None, first:] - 2 * own @ sub[first:].T
        i, j = np.nonzero(far <= budget + _SLACK)
        i, j = i + at, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for part in np.array_split(np.arange(len(i)), len(i) // 50_000 + 1):
            x, y = i[part], j[part]
            here = _within(ra[x, parts[block]], rb[y, parts[block]], budget)
            x, y = x[here], y[here]
            earlier = np.zeros(len(x), bool)
            for cut in parts[:block]:
                earlier |= _within(ra[x, cut], rb[y, cut], budget)
            x, y = x[~earlier], y[~earlier]
            linked = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            x, y = x[linked], y[linked]
            np.add.at(links_a, x, many_b[y])
            np.add.at(links_b, y, many_a[x])
            kept += [(u, v) for u, v in zip(x.tolist(), y.tolist(), strict=True) if forest.join(u, len(a) + v)]
    ids_a, ids_b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    ka, kb = links_a > 0, links_b > 0
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return pd.DataFrame({
        "vec_id": np.concatenate([ids_a[ka], ids_b[kb], ids_a[pairs[:, 0]]]),
        "other": pd.array([None] * int(ka.sum() + kb.sum()) + ids_b[pairs[:, 1]].tolist(), dtype="Int64"),
        "links": np.concatenate([links_a[ka], links_b[kb], np.zeros(len(pairs), np.int64)]),
    })


def find_links(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(vec_id, other, links): link counts where other is null, else a link of a spanning forest.

    A task is a cell's vectors beside those of the cells after it; a vector is in a task once. Cells
    of more than ``task_rows`` are split into parts, and what stands beside a part into slices, so no
    task grows with a dense spot. The number of cell axes follows the number of vectors.
    """
    axes = 1 + int(math.log(max(1.0, vectors.count() / (8 * TASK_ROWS)), 3))
    placed, _ = store(_cells(vectors, blocks, axes, 2 - 2 * threshold), "cells")
    sizes, _ = store(placed.groupBy("block", "cell").agg(F.count("*").alias("n")), "cell-sizes")

    @F.pandas_udf("array<string>")
    def after(cells: pd.Series) -> pd.Series:
        return cells.map(_after)

    pairs = sizes.select("block", "cell", F.explode(after("cell")).alias("beside")).join(sizes.select("block", F.col("cell").alias("beside"), F.col("n").alias("m")), ["block", "beside"])
    pairs, _ = store(pairs, "cell-pairs")
    parts = F.ceil(F.col("n") / task_rows).cast("int")
    around = pairs.groupBy("block", "cell").agg(F.sum("m").alias("m"))
    tasks = sizes.withColumn("parts", parts).join(around, ["block", "cell"], "left")
    beside = F.coalesce("m", F.lit(0)) + F.when(F.col("parts") > 1, F.col("n")).otherwise(0)
    tasks, _ = store(tasks.select("block", "cell", "parts", F.greatest(F.ceil(beside / task_rows), F.lit(1)).cast("int").alias("slices")), "cell-tasks")
    member = placed.join(tasks, ["block", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def rows(df: DataFrame, cell: str, part: Column, slice_: Column, own: bool) -> DataFrame:
        task = F.xxhash64("block", cell, part, slice_)
        return df.select(task.alias("task"), "block", (slice_ == 0).alias("first"), F.lit(own).alias("own"), "vec_id", "copies", "vector")

    def up_to(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    slice_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("slices")).cast("int")
    own = rows(member.withColumn("slice", up_to("slices")), "cell", F.col("part"), F.col("slice"), True)
    within = rows(member.filter("part > 0").withColumn("earlier", up_to("part")), "cell", F.col("earlier"), slice_of, False)
    owner = pairs.select("block", F.col("cell").alias("owner"), F.col("beside").alias("cell"))
    owner = owner.join(tasks.select("block", F.col("cell").alias("owner"), "parts", "slices"), ["block", "owner"])
    ahead = placed.join(owner, ["block", "cell"]).withColumn("of", up_to("parts"))
    halo = rows(ahead, "owner", F.col("of"), slice_of, False)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", ignore_index=True)
        left, right = frame[frame["own"]], frame[~frame["own"]]
        block, found = int(frame["block"].iloc[0]), []
        if len(left) and frame["first"].iloc[0]:
            found.append(_range_join(block, left, left, True, blocks, threshold))
        if len(left) and len(right):
            found.append(_range_join(block, left, right, False, blocks, threshold))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"vec_id": np.zeros(0, np.int64), "other": pd.array([], dtype="Int64"), "links": np.zeros(0, np.int64)})

    return own.unionByName(within).unionByName(halo).groupBy("task").applyInPandas(join, _FOUND)


def dedup_embeddings(table: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Equal vectors are one while links are sought and count as linked to each other; only groups of
    two or more are joined back. Vectors that are null, empty, zero, or hold null, NaN or infinite
    components link with nothing, like vectors of another width; they are kept. Rows that share a
    vec_id count as vectors of their own but have one name, so counts add up under it. A null vec_id
    links with nothing. Other columns, label included, play no part.
    """

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for x in rows:
                v = None if x is None else np.asarray(x, dtype=np.float64)
                out.append((v + 0.0).tobytes() if v is not None and v.size and np.isfinite(v).all() and v.any() else None)
            yield pd.Series(out, dtype=object)

    packed = table.select("vec_id", F.pandas_udf(pack, "binary")(F.col("embedding")).alias("vector"))
    packed = packed.withColumn("vector", F.when(F.col("vec_id").isNotNull(), F.col("vector")))
    packed, _ = store(packed, "vectors")
    groups = packed.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    groups, _ = store(groups, "distinct-vectors")
    found, _ = store(find_links(groups, threshold, blocks), "vector-links")
    roots = connected_components(found.filter("other IS NOT NULL"), "vec_id", "other")
    counts = found.filter("other IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links"))
    of_group = (
        groups.select("vec_id", "copies").join(counts, "vec_id", "left").join(roots, F.col("vec_id") == F.col("id"), "left")
        .select(F.col("vec_id").alias("first_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .filter("n_links > 0")
    )
    of_group, _ = store(of_group, "linked-groups")
    repeated, _ = store(groups.filter("copies > 1").select(F.col("vector").alias("same_vector"), F.col("vec_id").alias("same_id")), "repeated-vectors")
    named = packed.join(repeated, F.col("vector") == F.col("same_vector"), "left").select("vec_id", F.coalesce("same_id", "vec_id").alias("first_id"), F.col("vector").isNotNull().alias("sound"))
    joined = named.join(of_group, "first_id", "left")
    linked = F.col("sound") & F.col("n_links").isNotNull()
    return joined.select(
        "vec_id",
        F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
