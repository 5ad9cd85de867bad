"""N-gram Jaccard join: signature trees over the documents that share rare shingles with one document.

1. A document is the set of its 5-word shingles, hashed. Equal sets are one from here on.
2. Shingles are ordered from rare to frequent by a sketch of their counts. Two sets with a Jaccard
   index of at least t share one of the first n - ceil(t n) + 1 of each (the prefix principle). The
   documents that hold a shingle in their prefix meet under the least of their ids, its centre; so
   the many shingles that a group of near copies shares make one neighbourhood, not one group each.
   Any order is exact; the sketch only keeps passages that many documents share out of the prefixes.
3. A task holds a batch of whole neighbourhoods. Signature trees over the batch, one for each class
   of sizes, hold OR-combined bitmaps of the shingles and the ranges of sizes, neighbourhoods and
   component labels. A dual traversal drops pairs of nodes whose largest possible overlap is too
   small, whose ranges don't meet, or below which all is connected already. The first traversal, on
   bitmaps alone, leaves the few documents that may have a partner; only their texts are shuffled.
4. The second is on their sets: what survives is verified in place, and only links that connect
   something leave the task: fewer than it has documents. A neighbourhood above CHUNK is cut, with its
   centre in every part; afterwards its parts meet in pairs, but only where they hold more than one
   component.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import blocks_of, build_filter, contains, gathered, mixed
from .common import LOWER, UPPER, discard, store, text_batches, text_or_empty
from .components import connected_components

SHINGLE = 5
#: Two sets link when WHOLE * intersection >= LEAST * union: a Jaccard index of 0.75.
WHOLE, LEAST = 100, 75
SKETCH_BITS = 22
#: Most documents, and shingles in all, of one part of a neighbourhood, and of a batch of parts.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
BATCH = 4096
FANOUT = 8
#: Sets below 2^LEAST_CLASS shingles are one class of sizes; each further class doubles.
LEAST_CLASS = 7
_SLICE = 4096
#: Words of bitmaps that are compared at a time.
_WORDS = 1 << 19
#: The label of documents that are known to have a partner.
_ALIVE = np.iinfo(np.int64).min
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TURNS = mixed(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_INK = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@functools.lru_cache(4)
def _factors(size: int) -> np.ndarray:
    """A fixed odd 64-bit factor for each place in a word."""
    return mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order: its bytes by the factors of their places, mixed."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    ink = _INK[b]
    edge = np.nonzero(ink[1:] != ink[:-1])[0]
    if not len(edge):
        return np.zeros(0, np.uint64)
    size = edge[1::2] - edge[::2]
    opens = np.cumsum(size) - size
    place = np.arange(opens[-1] + size[-1]) - np.repeat(opens, size)
    longest = 1 << max(6, int(size.max()).bit_length())
    return mixed(np.add.reduceat((b[ink].astype(np.uint64) + np.uint64(1)) * _factors(longest)[place], opens))


def shingle_set(text: str) -> np.ndarray:
    """Distinct shingles of the whole text as sorted 64-bit hashes; empty without words."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(w):
        return np.zeros(0, np.uint64)
    if len(w) < SHINGLE:
        h = np.full(1, len(w), np.uint64)
        for x in w:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x)
        return h
    n = len(w) - SHINGLE + 1
    h = w[:n] * _TURNS[0]
    for k in range(1, SHINGLE):
        h += w[k : k + n] * _TURNS[k]
    h = mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and WHOLE * both >= LEAST * (len(a) + len(b) - both)


def prefix(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, as many as two linked sets can't both avoid sharing one of."""
    n = len(tokens)
    size = n - (LEAST * n + WHOLE - 1) // WHOLE + 1 if n else 0
    seen = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return tokens[np.argsort(seen, kind="stable")[:size]]


def size_class(n: np.ndarray) -> np.ndarray:
    """Linked sets differ in size by a third at most, so their classes are equal or neighbours."""
    return np.maximum(np.frexp(n.astype(float))[1], LEAST_CLASS)


def bitmaps(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of ``size`` bits for each set; a power of two."""
    many = np.fromiter(map(len, sets), np.int64, len(sets))
    held = np.zeros(len(sets) * size, bool)
    held[np.repeat(np.arange(len(sets)) * size, many) + (np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.uint64).reshape(len(sets), -1)


def folded(bits: np.ndarray) -> np.ndarray:
    """The bitmaps at half their size."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


class SignatureTree:
    """Levels of nodes, the leaves (documents) first; a node covers FANOUT neighbours below it.

    A node has the OR of its bitmaps, and the least and greatest of sizes, neighbourhoods and labels
    below it, and how many shingles a set may have beyond one for each of its bits.
    """

    def __init__(self, bits: np.ndarray, n: np.ndarray, group: np.ndarray, label: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(axis=1)
        self.leaf_labels = label
        self.levels = [(bits, excess, (n, n), (group, group), (label, label))]

    def grow(self, depth: int) -> SignatureTree:
        while len(self.levels) <= depth:
            bits, excess, *ranges = self.levels[-1]
            at = np.arange(0, len(excess), FANOUT)
            merged = [(np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) for low, high in ranges]
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.maximum.reduceat(excess, at), *merged))
        return self

    def __len__(self) -> int:
        return len(self.levels[0][1])


def _possible(p: tuple, q: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs may hold a link that isn't known yet."""
    bits_p, excess_p, (least_p, most_p), (first_p, last_p), (low_p, high_p) = p
    bits_q, excess_q, (least_q, most_q), (first_q, last_q), (low_q, high_q) = q
    ok = (first_p[i] <= last_q[j]) & (first_q[j] <= last_p[i])
    ok &= (WHOLE * most_p[i] >= LEAST * least_q[j]) & (WHOLE * most_q[j] >= LEAST * least_p[i])
    ok &= ~((low_p[i] == high_p[i]) & (low_q[j] == high_q[j]) & (low_p[i] == low_q[j]))
    left = np.nonzero(ok)[0]
    step = max(_WORDS // bits_p.shape[1], 1)
    for k in range(0, len(left), step):
        at = left[k : k + step]
        x, y = i[at], j[at]
        # A shared shingle has its bit in both bitmaps; beyond one for each bit, a set has its excess.
        most = np.bitwise_count(bits_p[x] & bits_q[y]).sum(axis=1).astype(np.int64) + np.minimum(excess_p[x], excess_q[y])
        most = np.minimum(most, np.minimum(most_p[x], most_q[y]))
        ok[at] = (WHOLE + LEAST) * most >= LEAST * (least_p[x] + least_q[y])
    return ok


def dual_traversal(p: SignatureTree, q: SignatureTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of leaves of two trees; of one tree with itself only i < j."""
    depth, most = 0, max(len(p), len(q))
    while most > FANOUT:
        most, depth = -(-most // FANOUT), depth + 1
    p, q = p.grow(depth), q.grow(depth)
    n_q = len(q.levels[depth][1])
    stack = [(depth, *np.divmod(np.arange(len(p.levels[depth][1]) * n_q), n_q))]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
    while stack:
        level, i, j = stack.pop()
        if p is q:
            ordered = i <= j if level else i < j
            i, j = i[ordered], j[ordered]
        ok = _possible(p.levels[level], q.levels[level], i, j)
        i, j = i[ok], j[ok]
        if not level:
            if len(i):
                yield i, j
            continue
        for at in range(0, len(i), _SLICE):
            x = (i[at : at + _SLICE, None] * FANOUT + a).ravel()
            y = (j[at : at + _SLICE, None] * FANOUT + b).ravel()
            there = (x < len(p.levels[level - 1][1])) & (y < len(q.levels[level - 1][1]))
            stack.append((level - 1, x[there], y[there]))


class _Batch:
    """The documents of some neighbourhoods, with what is known of their links."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = np.cumsum(self.n)
        self.root = np.unique(label, return_inverse=True)[1].astype(np.int64)
        distinct, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.marked = np.zeros(len(distinct), bool)
        self.found: list[tuple[int, int]] = []

    def of(self, i: int) -> np.ndarray:
        return self.number[self.ends[i] - self.n[i] : self.ends[i]]

    def verify(self, i: int, js: np.ndarray) -> None:
        """Count what i shares with each j that it isn't connected with, and note the links that connect."""
        js = js[self.root[js] != self.root[i]]
        if not len(js):
            return
        own = self.of(i)
        self.marked[own] = True
        size = self.n[js]
        both = np.add.reduceat(self.marked[np.concatenate([self.of(j) for j in js.tolist()])].astype(np.int64), np.cumsum(size) - size)
        self.marked[own] = False
        for j in js[WHOLE * both >= LEAST * (len(own) + size - both)].tolist():
            x, y = self.root[i], self.root[j]
            if x != y:
                self.root[self.root == max(x, y)] = min(x, y)
                self.found.append((int(self.ids[i]), int(self.ids[j])))


def _trees(group: np.ndarray, n: np.ndarray, label: np.ndarray, bits_of) -> Iterator[tuple]:
    """Pairs of trees that may hold links, each with its rows: a class of sizes with itself and with the next."""
    sizes, held = size_class(n), {}
    for c in np.unique(sizes).tolist():
        at = np.nonzero(sizes == c)[0]
        at = at[np.lexsort((n[at], group[at]))]
        held[c] = at, bits_of(at, c), (n[at], group[at], label[at])
    for c, (at, bits, rest) in held.items():
        own = SignatureTree(bits, *rest)
        yield own, at, own, at
        if c + 1 in held:
            next_at, next_bits, next_rest = held[c + 1]
            yield own, at, SignatureTree(folded(next_bits), *next_rest), next_at


def promising(group: np.ndarray, n: np.ndarray, label: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which documents may link with another of their group and another label, by bitmaps alone."""
    alive = np.zeros(len(n), bool)
    for p, at, q, other_at in _trees(group, n, label, lambda at, c: np.frombuffer(b"".join([bits[k] for k in at.tolist()]), np.uint64).reshape(len(at), -1)):
        for tree, rows in ((p, at), (q, other_at)):
            tree.leaf_labels[alive[rows]] = _ALIVE
        for i, j in dual_traversal(p, q):
            alive[at[i]] = alive[other_at[j]] = True
            # Of two documents that both have a partner, nothing more need be known here.
            p.leaf_labels[i] = q.leaf_labels[j] = _ALIVE
    return alive


def connecting_links(group: np.ndarray, ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Links (a > b) within groups that connect all documents that links connect; equal labels are connected.

    The first document of each group is compared with the others; trees search for the rest.
    """
    batch = _Batch(ids, label, sets)
    opens = np.concatenate([[0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)]])
    for a, b in zip(opens[:-1].tolist(), opens[1:].tolist(), strict=True):
        near = (WHOLE * batch.n[a + 1 : b] >= LEAST * batch.n[a]) & (WHOLE * batch.n[a] >= LEAST * batch.n[a + 1 : b])
        batch.verify(a, a + 1 + np.nonzero(near)[0])
    group = np.repeat(np.arange(len(opens) - 1), np.diff(opens))
    for p, at, q, other_at in _trees(group, batch.n, batch.root, lambda at, c: bitmaps([sets[k] for k in at.tolist()], 4 << c)):
        for i, j in dual_traversal(p, q):
            i, j = at[i], other_at[j]
            apart = batch.root[i] != batch.root[j]
            i, j = i[apart], j[apart]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cuts = np.nonzero(i[1:] != i[:-1])[0] + 1
            for x, y in zip(i[np.append(0, cuts)].tolist() if len(i) else [], np.split(j, cuts), strict=False):
                batch.verify(x, y)
    pairs = np.array(batch.found, np.int64).reshape(-1, 2)
    return np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1) if len(pairs) else pairs


class _Held:
    """Rows of whole parts, up to what one batch of trees may have."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.shingles = 0

    def full(self, part: int) -> bool:
        return bool(self.rows) and part != self.rows[-1][0] and (len(self.rows) >= BATCH or self.shingles >= CHUNK_SHINGLES)

    def add(self, *row, shingles: int) -> None:
        self.rows.append(row)
        self.shingles += shingles

    def taken(self) -> list[list]:
        columns = [list(x) for x in zip(*self.rows, strict=True)]
        self.rows, self.shingles = [], 0
        return columns


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "doc_id")


def _promising(rows: DataFrame) -> DataFrame:
    """The rows (part, doc_id, label) that may link with another row of their part; input has n and bits, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def found() -> pa.RecordBatch:
            part, ids, label, n, bits = held.taken()
            part, ids, label, n = (np.array(x, np.int64) for x in (part, ids, label, n))
            keep = promising(np.cumsum(np.append(0, part[1:] != part[:-1])), n, label, bits)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (part, ids, label)], names=["part", "doc_id", "label"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "label", "n", "bits")), strict=True):
                if held.full(row[0]):
                    yield found()
                held.add(*row, shingles=row[3])
        if held.rows:
            yield found()

    return _by_part(rows).mapInArrow(run, "part long, doc_id long, label long")


def _connect(rows: DataFrame) -> DataFrame:
    """Distinct links (a, b) that connect the documents of each part; rows are (part, doc_id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor().decompress, _Held()

        def found() -> pa.RecordBatch:
            *named, sets = held.taken()
            pairs = connecting_links(*(np.array(x, np.int64) for x in named), sets)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            for part, i, label, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "label")), batch.column("text"), strict=True):
                if held.full(part):
                    yield found()
                tokens = shingle_set(unpack(text.as_py()).decode("utf-8", "surrogatepass"))
                held.add(part, i, label, tokens, shingles=len(tokens))
        if held.rows:
            yield found()

    return _by_part(rows).mapInArrow(run, "a long, b long").distinct()


def _profiles(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, s1, s2, bits) for the documents, and (block, held) for each task's sketch."""
    schema = "doc_id long, n long, s1 long, s2 long, bits binary, block int, held binary"
    types = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bits", pa.binary()), ("block", pa.int32()), ("held", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            n, s1, s2, bits = [], [], [], []
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py())
                np.add.at(counts, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.int32(1))
                raw = tokens.tobytes()
                n.append(len(tokens))
                s1.append(xxhash.xxh64_intdigest(raw))
                s2.append(xxhash.xxh64_intdigest(raw, 1))
                bits.append(bitmaps([tokens], 2 << int(size_class(np.array([len(tokens)]))[0])).tobytes() if len(tokens) else None)
            none = pa.nulls(len(n))
            marks = (pa.array(np.array(s, np.uint64).view(np.int64)) for s in (s1, s2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *marks, pa.array(bits, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=types)
        for part in blocks_of(counts):
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(part.num_rows, pa.binary()), *part.columns], schema=types)

    return docs.mapInArrow(run, schema)


def _sketch(profiles: DataFrame):
    """2^SKETCH_BITS counts over all documents: a broadcast of fixed size. Sums past 2^31 stay there."""
    parts = profiles.filter("block IS NOT NULL").select("block", "held")
    counts = gathered(parts, 1 << SKETCH_BITS, np.int32, _sum)
    return profiles.sparkSession.sparkContext.broadcast(counts)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.int64) + b, np.iinfo(np.int32).max).astype(np.int32)


#: Documents to scan: pairs of a table and a filter of ids to pass over, or None.
Scans = list[tuple[DataFrame, object]]


def _scan(scans: Scans, run, schema: str) -> DataFrame:
    """What ``run(batches)`` makes of the documents of all scans."""

    def over(docs: DataFrame, skip) -> DataFrame:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch if skip is None else batch.filter(pa.array(~contains(skip.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))

        return docs.mapInArrow(lambda batches: run(some(batches)), schema)

    found = [over(docs, skip) for docs, skip in scans]
    return functools.reduce(DataFrame.unionByName, found)


def _prefixes(docs: Scans, counts) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(shingle_set(t.as_py()), counts.value) for t in batch.column("text")]
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), size)
            tokens = np.concatenate(found) if found else np.zeros(0, np.uint64)
            for at in range(0, len(ids), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[at : at + 500_000].view(np.int64)), pa.array(ids[at : at + 500_000])], names=["token", "doc_id"])

    return _scan(docs, run, "token long, doc_id long")


def _members(docs: Scans, counts, chosen) -> DataFrame:
    """The prefix rows that the filter of chosen shingles lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(shingle_set(t.as_py()), counts.value) for t in batch.column("text")]
            found = [x[contains(chosen.value, x)] for x in found]
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), size)
            tokens = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(ids)], names=["token", "doc_id"])

    return _scan(docs, run, "token long, doc_id long")


def _packed(docs: Scans, rows: DataFrame) -> DataFrame:
    """(doc_id, text) with the text compressed, for the documents in ``rows``; the filter only saves shuffling others."""
    named = build_filter(rows, "doc_id", rows.count())

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            part = batch.filter(pa.array(contains(named.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            texts = [pack(x.as_py().encode("utf-8", "surrogatepass")) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return _scan(docs, only, "doc_id long, text binary")


def _links(parts: DataFrame, signed: DataFrame, docs: Scans) -> DataFrame:
    """The links (a, b) that connect the documents of each part (part, doc_id, label).

    A repeated doc_id has several rows in ``signed``; they have one label, so they aren't compared.
    """
    rows, _ = store(_promising(parts.join(signed, "doc_id").select("part", "doc_id", "label", "n", "bits")), "promising")
    links, _ = store(_connect(rows.join(_packed(docs, rows), "doc_id").select("part", "doc_id", "label", "text")), "connecting-links")
    return links


def _cuts(rows: str = "rows", shingles: str = "shingles") -> Column:
    """Into how many parts a set of documents is cut."""
    return F.ceil(F.greatest(F.col(rows) / CHUNK, F.col(shingles) / CHUNK_SHINGLES)).cast("int")


def _parts(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, doc_id, label) of the first pass, and the centres whose neighbourhoods are in several parts."""
    size = members.groupBy("low").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).withColumn("cuts", _cuts())
    size, _ = store(size.select("low", "cuts"), "neighbourhoods")
    # The centre is in every part of its neighbourhood; a neighbourhood in one part needs no draw.
    own = F.when(F.col("doc_id") == F.col("low"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")))
    rows = members.join(size, "low").select("low", "doc_id", F.explode(own).alias("cut"))
    return rows.select(F.xxhash64("low", "cut").alias("part"), "doc_id", F.col("doc_id").alias("label")), size.filter("cuts > 1").select("low")


def _open_parts(members: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, doc_id, label) of the second pass: what the cuts of large neighbourhoods kept apart.

    Only neighbourhoods with several labels remain. They are cut by label, so that parts of one
    label never meet; the other parts meet in pairs.
    """
    rows = members.join(large, "low", "left_semi").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    rows, _ = store(rows.select("low", "doc_id", "n", "label"), "large-neighbourhoods")
    still = rows.groupBy("low").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("label").alias("first"), F.max("label").alias("last"))
    still = still.filter("first <> last").select("low", _cuts().alias("cuts"))
    rows = rows.join(still, "low").withColumn("cut", F.pmod(F.xxhash64("label"), F.col("cuts")).cast("int")).drop("cuts")
    again = rows.groupBy("low", "cut").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).select("low", "cut", _cuts().alias("cuts"))
    rows = rows.join(again, ["low", "cut"]).withColumn("chunk", F.xxhash64("low", "cut", F.pmod(F.xxhash64("doc_id"), F.col("cuts"))))
    rows, _ = store(rows.select("low", "chunk", "doc_id", "label"), "open-members")
    chunks, _ = store(rows.groupBy("low", "chunk").agg(F.min("label").alias("first"), F.max("label").alias("last")), "open-chunks")
    p, q = (chunks.select("low", *[F.col(c).alias(f"{c}_{s}") for c in ("chunk", "first", "last")]) for s in "pq")
    tasks = p.join(q, "low").filter("chunk_p <= chunk_q AND NOT (first_p = last_p AND first_q = last_q AND first_p = first_q)")
    tasks = tasks.select("low", F.xxhash64("chunk_p", "chunk_q").alias("part"), F.explode(F.array_distinct(F.array("chunk_p", "chunk_q"))).alias("chunk"))
    return rows.join(tasks, ["low", "chunk"]).select("part", "doc_id", "label")


def _passed(docs: DataFrame, held) -> DataFrame:
    """The documents whose id the filter passes."""

    @F.pandas_udf("boolean")
    def passed(ids: pd.Series) -> pd.Series:
        return pd.Series(contains(held.value, ids.to_numpy(np.int64)))

    return docs.filter("doc_id IS NOT NULL").filter(passed("doc_id"))


def _one_row_each(docs: DataFrame, sizes: DataFrame, alike: DataFrame) -> tuple[Scans, str]:
    """Scans of the documents without the copies in ``alike``, a row per doc_id.

    Ids that are copies, or stand in several rows, are few: a filter of them tells which documents
    need a closer look, and only the texts of those are shuffled. The others are read where they are.
    """
    again = sizes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    odd = alike.select("doc_id", F.lit(True).alias("gone")).unionByName(again.select("doc_id", F.lit(False).alias("gone")))
    odd, _ = store(odd.groupBy("doc_id").agg(F.bool_or("gone").alias("gone")), "odd-ids")
    held = build_filter(odd, "doc_id", odd.count())
    gone = odd.filter("gone").select(F.col("doc_id").alias("gone_id"))
    once, path = store(_passed(docs, held).join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").dropDuplicates(["doc_id"]), "looked-at-once")
    return [(docs.filter("doc_id IS NOT NULL"), held), (once, None)], path


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows
    that repeat a doc_id with the same text are one document. If the texts differ, the id stands for
    whichever row is read, so ids should be unique. A null doc_id has a null component and links
    with nothing. Other columns play no part; an empty table gives an empty result.
    """
    with text_batches(docs.sparkSession):
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    profiles, path = store(_profiles(docs), "profiles")
    sizes = profiles.filter("block IS NULL").select("doc_id", "n", "s1", "s2")
    counts = _sketch(profiles)
    sets = sizes.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    repeated, repeated_path = store(sets.filter("rows > 1").select("n", "s1", "s2", "first_id"), "equal-sets")
    alike, alike_path = store(
        sizes.join(repeated, ["n", "s1", "s2"]).filter("doc_id <> first_id").select("doc_id", "first_id").distinct(), "copies"
    )
    unlike, once_path = _one_row_each(docs, sizes, alike)
    groups = (
        _prefixes(unlike, counts).groupBy("token")
        .agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.expr("bit_xor(xxhash64(doc_id))").alias("mark"))
        .filter("low <> high").groupBy("rows", "low", "high", "mark").agg(F.min("token").alias("token"))
    )
    groups, groups_path = store(groups.select("token", "low"), "groups")
    chosen = build_filter(groups, "token", groups.count())
    members = _members(unlike, counts, chosen).join(groups, "token").select("low", "doc_id").distinct()
    signed = profiles.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "bits")
    one_each = signed.groupBy("doc_id").agg(F.max("n").alias("n"))
    members, members_path = store(members.join(one_each, "doc_id"), "members")
    parts, large = _parts(members)
    links = _links(parts, signed, unlike)
    labels, _ = store(connected_components(links, "a", "b"), "first-labels")
    more = _links(_open_parts(members, large, labels), signed, unlike)
    if more.limit(1).count():
        labels, _ = store(connected_components(links.unionByName(more), "a", "b"), "labels")
    discard(spark, members_path, groups_path, once_path)
    named = sizes.join(alike.withColumnRenamed("doc_id", "copy_id"), F.col("doc_id") == F.col("copy_id"), "left").withColumn("_set", F.coalesce("first_id", "doc_id"))
    return named.join(labels, F.col("_set") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "_set")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: that with the component's least doc_id.

    Of rows that repeat a doc_id one stays. Rows with a null doc_id, and documents without words, are
    like no other and all stay. The columns stay as they are. Only documents that may go are
    shuffled; the others pass a filter of those ids and stay where they are.
    """
    found = jaccard_components(docs).filter("doc_id IS NOT NULL").groupBy("doc_id")
    found = found.agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone OR rows > 1")
    odd, _ = store(found.select(F.col("doc_id").alias("_odd_id"), "gone"), "odd-ids")
    held = build_filter(odd, "_odd_id", odd.count())

    @F.pandas_udf("boolean")
    def free(ids: pd.Series) -> pd.Series:
        return pd.Series(~contains(held.value, ids.to_numpy(np.int64)))

    straight = docs.filter("doc_id IS NOT NULL").filter(free("doc_id"))
    looked_at = _passed(docs, held).join(odd.filter("gone").select("_odd_id"), F.col("doc_id") == F.col("_odd_id"), "left_anti").dropDuplicates(["doc_id"])
    return docs.filter("doc_id IS NULL").unionByName(straight).unionByName(looked_at)
