"""Bloom filters of a fixed largest size, to keep rows that can't join out of a shuffle.

A filter only saves work: it passes every member, and what else it passes a join drops later. Its
size follows the number of members up to MAX_BITS, so the broadcast has a bound whatever the data.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

MIN_BITS, MAX_BITS = 1 << 16, 1 << 26
#: Numbers of a block in which the tasks' parts travel.
BLOCK = 1024
BLOCKS = "block int, held binary"
#: Blocks of a record batch.
_ROWS = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(x)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def contains(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = _places(x, 64 * len(words))
    one, low, six = np.uint64(1), np.uint64(63), np.uint64(6)
    return (words[a >> six] >> (a & low) & words[b >> six] >> (b & low) & one).astype(bool)


def _packed(blocks: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (block, held), each block compressed: those of one task are mostly zeros, and every task sends all of them."""
    pack = zstandard.ZstdCompressor(level=1).compress
    while rows := list(itertools.islice(blocks, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([pack(x.tobytes()) for _, x in rows], pa.binary())], names=["block", "held"])


def blocks_of(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array of numbers as rows (block, held), some blocks at a time; blocks of zeros are left out."""
    parts = ((k, values[at : at + BLOCK]) for k, at in enumerate(range(0, len(values), BLOCK)))
    yield from _packed((k, part) for k, part in parts if part.any())


def gathered(parts: DataFrame, size: int, kind: type, combine: np.ufunc) -> np.ndarray:
    """The tasks' arrays combined by block on the executors; the driver gets one array of fixed size."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, own = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(unpack(raw.as_buffer()), kind)
                own[k] = combine(own[k], part) if k in own else part
        yield from _packed(iter(own.items()))

    whole, unpack = np.zeros(size, kind), zstandard.ZstdDecompressor().decompress
    for row in parts.repartition("block").mapInArrow(merge, BLOCKS).collect():
        part = np.frombuffer(unpack(row["held"]), kind)
        whole[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return whole


def build_filter(df: DataFrame, column: str, count: int):
    """A broadcast array of words for the long ``column``; built in the tasks and combined by OR."""
    bits = MIN_BITS
    while bits < min(16 * count, MAX_BITS):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for p in _places(x, bits):
                np.bitwise_or.at(held, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        yield from blocks_of(held)

    whole = gathered(df.select(column).mapInArrow(words, BLOCKS), bits // 64, np.uint64, np.bitwise_or)
    return df.sparkSession.sparkContext.broadcast(whole)
