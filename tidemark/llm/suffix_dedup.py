"""Suffix-array dedup: remove every byte of a 200-byte string that also starts elsewhere.

1. Anchors deal the work out. Each 200-byte string has one: the 64-byte string in it with the least
   hash, the leftmost of equals. Equal strings have equal anchors at equal places, so they meet in
   the group of that anchor. Neighbouring starts with one anchor make a piece of a document; each
   start belongs to exactly one piece, and a piece has at most 336 bytes.
2. Equal pieces are counted and are one from here on. All starts of a piece seen twice are repeated.
3. Groups of unlike pieces, as far as any two agree, go through a suffix array that grows by columns: one symbol per piece
   each round, from the last to the first, with the collection's Burrows-Wheeler transform and the
   common prefixes (up to 200) read from one pair of files and written to the next. A start is
   repeated if the common prefix with a neighbour reaches 200.
4. Groups with more unlike pieces than a parameter says are cut to single 200-byte strings,
   which are counted by a shuffle, so that no task grows with a frequent passage.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build_filter, contains, mixed
from .common import discard, store, text_or_empty

MATCH = 200
ANCHOR = 64
#: Unlike pieces of one construction, and the most that one group may have for it.
BATCH_PIECES = 4096
GROUP_PIECES = 16384
#: Pieces of one task, on the average.
TASK_PIECES = 16384
#: Values of a block when the least of a range is sought.
SPAN = 64
#: Starts of a long document that are looked at together.
BLOCK = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(24)
#: A run of starts in one number: first start << 10 | starts.
_RUN = 10
#: A piece in one number: start << 16 | place of its anchor << 8 | starts.
_START, _LEAD, _BYTE = 16, 8, 255
_OCCURRENCES = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int64())])
_RUNS = "key long, h1 long, runs array<long>"


def anchored_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, anchor hash and anchor's place of each run with one anchor."""
    if len(raw) < MATCH:
        return (np.zeros(0, np.int64),) * 4
    h, width = raw.astype(np.uint64) + np.uint64(1), 1
    while width < ANCHOR:
        h = h[:-width] * (_ODD + np.uint64(2 * width)) + h[width:]
        width *= 2
    h = mixed(h)
    least = h >> _PLACE << _PLACE | np.arange(len(h), dtype=np.uint64)
    width, whole = 1, MATCH - ANCHOR + 1
    while 2 * width <= whole:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < whole:
        least = np.minimum(least[: -(whole - width)], least[whole - width :])
    anchor = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(anchor[1:] != anchor[:-1])[0] + 1])
    return first, np.diff(np.append(first, len(anchor))), h[anchor[first]].view(np.int64), anchor[first] - first


def _runs_of(text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, max(len(text) - MATCH + 1, 0), BLOCK):
        raw = np.frombuffer(text, np.uint8, min(BLOCK + MATCH - 1, len(text) - at), at)
        yield at, *anchored_runs(raw)


def _anchors(docs: DataFrame) -> DataFrame:
    """The anchor of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("raw"):
                for _, _, _, key, _ in _runs_of(text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    return docs.select("raw").mapInArrow(run, "key long")


def _occurrences(docs: DataFrame, held) -> DataFrame:
    """A row for each piece with an anchor that the filter passes, without its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text_hash, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("raw"), strict=True):
                text = raw.as_py()
                view = memoryview(text)
                for at, first, size, key, lead in _runs_of(text):
                    hit = contains(held.value, key)
                    if not hit.any():
                        continue
                    first, size, key, lead = first[hit] + at, size[hit], key[hit], lead[hit]
                    ends = (first + size + (MATCH - 1)).tolist()
                    h1 = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), ends, strict=True)), np.uint64, len(key))
                    ids = pa.nulls(len(key), pa.int64()) if doc_id is None else pa.array(np.full(len(key), doc_id, np.int64))
                    place = first << _START | lead << _LEAD | size
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h1.view(np.int64)), ids, pa.array(np.full(len(key), text_hash)), pa.array(place)], schema=_OCCURRENCES)

    return docs.mapInArrow(run, "key long, h1 long, doc_id long, text_hash long, place long")


def _fetch(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, h1, lead, piece): the bytes of one occurrence of each piece.

    Documents are joined with what is wanted of them; the filter of documents is only there to
    shuffle fewer of them, so without it each text would move once.
    """
    wanted = pieces.groupBy(F.col("first.text_hash").alias("want_hash"), F.col("first.doc_id").alias("want_id")).agg(
        F.collect_list(F.struct("key", "h1", F.col("first.place").alias("place"))).alias("wanted")
    )
    wanted, _ = store(wanted, "wanted-pieces")
    some = _having(docs, build_filter(wanted, "want_hash", wanted.count()))
    both = some.join(wanted, (F.col("text_hash") == F.col("want_hash")) & F.col("doc_id").eqNullSafe(F.col("want_id")))
    each = both.select("raw", F.explode("wanted").alias("w")).select("raw", "w.*")
    start = F.shiftright("place", _START) + 1
    # Positions in a binary column are 32-bit numbers, as the length of any text is.
    piece = F.substring(F.col("raw"), start.cast("int"), (F.col("place").bitwiseAND(_BYTE) + (MATCH - 1)).cast("int"))
    return each.select("key", "h1", F.shiftright("place", _LEAD).bitwiseAND(_BYTE).cast("int").alias("lead"), piece.alias("piece"))


def _having(docs: DataFrame, held, wanted: bool = True) -> DataFrame:
    """The documents that the filter passes, or those that it doesn't."""

    @F.pandas_udf("boolean")
    def passed(text_hash: pd.Series) -> pd.Series:
        return pd.Series(contains(held.value, text_hash.to_numpy(np.int64)) == wanted)

    return docs.filter(passed("text_hash"))


class _Column:
    """Two files in turn: a symbol and a common prefix for each suffix, in suffix order.

    They are the task's own, have no name in any folder, and end with it. A batch bounds their size.
    """

    def __init__(self):
        self.files, self.turn, self.count = [tempfile.TemporaryFile(buffering=0) for _ in range(2)], 0, 0

    def write(self, pairs: np.ndarray) -> None:
        self.turn ^= 1
        self.count = pairs.size
        self.files[self.turn].seek(0)
        self.files[self.turn].write(memoryview(pairs).cast("B"))

    def read(self) -> np.ndarray:
        pairs = np.empty((self.count // 2, 2), np.uint8)
        self.files[self.turn].seek(0)
        self.files[self.turn].readinto(memoryview(pairs).cast("B"))
        return pairs

    def close(self) -> None:
        for f in self.files:
            f.close()


def _least_between(values: np.ndarray, after: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[after + 1 .. last]) for each pair with after < last.

    Long ranges are their first and last SPAN values and the least of the whole blocks between, so
    the work and memory per range have a bound.
    """
    size = last - after
    long = np.nonzero(size > 3 * SPAN)[0]
    if len(long):
        out = np.empty(len(size), values.dtype)
        short = np.nonzero(size <= 3 * SPAN)[0]
        if len(short):
            out[short] = _least_between(values, after[short], last[short])
        blocks = np.minimum.reduceat(values, np.arange(0, len(values), SPAN))
        a, b = after[long], last[long]
        inside = _least_between(blocks, -(-(a + 1) // SPAN) - 1, (b + 1) // SPAN - 1)
        ends = np.minimum(_least_between(values, a, a + SPAN), _least_between(values, b - SPAN, b))
        out[long] = np.minimum(inside, ends)
        return out
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) + np.repeat(after + 1 - ends + size, size)
    return np.minimum.reduceat(values[at], ends - size)


def repeated_starts(pieces: list[bytes], match: int = MATCH) -> list[np.ndarray]:
    """For each piece, which of its starts have ``match`` bytes that start somewhere else, too.

    Round j inserts the suffix of length j of every piece that has one. The suffix that begins with
    symbol c, before the one at place p, goes to the place that the count of smaller symbols and of
    earlier c gives; its common prefix with the neighbours is one more than the least between p and
    the nearest c on each side. Bytes are stored plus one (UTF-8 has no byte 255); 0 ends a piece.
    """
    m = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, m)
    if not m or not size.max():
        return [np.zeros(0, bool) for _ in pieces]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum(size)
    column = _Column()
    try:
        symbols = np.zeros(m, np.uint8)
        symbols[size > 0] = text[end[size > 0] - 1] + 1
        column.write(np.stack([symbols, np.zeros(m, np.uint8)], axis=1))
        count = np.bincount(symbols, minlength=257)
        piece, place = np.arange(m), np.arange(m)  # of the suffixes that the last round inserted, by place
        for j in range(1, int(size.max()) + 1):
            pairs = column.read()
            bwt, lcp = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
            n = len(bwt)
            more = size[piece] >= j
            piece, place = piece[more], place[more]
            order = np.argsort(bwt, kind="stable")
            opens = np.cumsum(count) - count
            c = bwt[place]
            by_symbol = np.argsort(c, kind="stable")
            piece, p, c = piece[by_symbol], place[by_symbol], c[by_symbol]
            edges = [0, *(np.nonzero(c[1:] != c[:-1])[0] + 1).tolist(), len(c)]
            k = np.empty(len(p), np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lo = int(opens[c[a]])
                k[a:b] = np.searchsorted(order[lo : lo + int(count[c[a]])], p[a:b])
            has_before, has_after = k > 0, k + 1 < count[c]
            k += opens[c]
            place = m + k - int(count[0])
            own, next_own = np.zeros(len(p), np.uint8), np.zeros(len(p), np.uint8)
            if has_before.any():
                own[has_before] = np.minimum(_least_between(lcp, order[k[has_before] - 1], p[has_before]), match - 1) + 1
            if has_after.any():
                next_own[has_after] = np.minimum(_least_between(lcp, p[has_after], order[k[has_after] + 1]), match - 1) + 1
            grown = np.empty((n + len(p), 2), np.uint8)
            old = np.ones(len(grown), bool)
            old[place] = False
            grown.view(np.uint16).reshape(-1)[old] = pairs.view(np.uint16).reshape(-1)
            symbols = np.where(size[piece] > j, text[np.maximum(end[piece] - j - 1, 0)] + 1, 0).astype(np.uint8)
            grown[place, 0] = symbols
            grown[place, 1] = own
            follows = has_after & old[np.minimum(place + 1, len(old) - 1)]
            grown[place[follows] + 1, 1] = next_own[follows]
            column.write(grown)
            count += np.bincount(symbols, minlength=257)
        pairs = column.read()
    finally:
        column.close()
    full = pairs[:, 1] >= match
    full[:-1] |= full[1:]
    return _by_start(pairs[:, 0], full, size, match)


def _by_start(bwt: np.ndarray, full: np.ndarray, size: np.ndarray, match: int) -> list[np.ndarray]:
    """The marks of the suffixes dealt back to the starts of the pieces, by walking the transform."""
    m, n = len(size), len(bwt)
    order = np.argsort(bwt, kind="stable")
    done = n - int(np.count_nonzero(bwt))
    step = np.empty(n, np.int64)
    step[order[done:]] = m + np.arange(n - done)
    many = np.maximum(size - match + 1, 0)
    opens = np.cumsum(many) - many
    marks = np.zeros(int(many.sum()), bool)
    where, live = np.arange(m), np.arange(m)
    for j in range(1, int(size.max()) + 1):
        more = size[live] >= j
        live, where = live[more], step[where[more]]
        if j >= match:
            hit = live[full[where]]
            marks[opens[hit] + size[hit] - j] = True
    return np.split(marks, opens[1:])


def _coded(marks: np.ndarray, at: int = 0) -> list[int]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    first = np.nonzero(edge == 1)[0]
    return (first + at << _RUN | (np.nonzero(edge == -1)[0] - first)).tolist()


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The longest prefix that each row of bytes has in common with another row, up to its size."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").reshape(-1), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    longest = np.zeros(len(rows), np.int64)
    longest[order[1:]] = same
    longest[order[:-1]] = np.maximum(longest[order[:-1]], same)
    return np.minimum(longest, size)


def _padded(parts: list[bytes]) -> np.ndarray:
    width = max(map(len, parts))
    return np.frombuffer(b"".join([x.ljust(width, b"\0") for x in parts]), np.uint8).reshape(len(parts), width)


def worth(pieces: list[bytes], lead: np.ndarray, key: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """The part (from, to) of each piece that can hold a repeated string; from = to if there is none.

    A string and its equal agree from their anchor to the left and to the right. So a piece counts
    only as far as it agrees with any piece of its group on either side, and not at all if both
    sides together are too short.
    """
    lead = lead.astype(np.int64)
    right = _common(_padded([p[a:] for p, a in zip(pieces, lead.tolist(), strict=True)]), np.fromiter(map(len, pieces), np.int64, len(pieces)) - lead)
    marks = [k.tobytes() for k in key]
    left = _common(_padded([k + p[:a][::-1] for k, p, a in zip(marks, pieces, lead.tolist(), strict=True)]), lead + 8) - 8
    left = np.maximum(left, 0)
    any_left = left + right >= match
    return np.where(any_left, lead - left, 0), np.where(any_left, lead + right, 0)


def _search(pieces: DataFrame, unlike: int) -> DataFrame:
    """Runs of repeated starts of pieces that lie together by key; whole groups go in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            while table.num_rows > BATCH_PIECES:
                key = table.column("key").to_numpy()
                change = np.nonzero(key[1:] != key[:-1])[0] + 1
                fit = change[change <= BATCH_PIECES]
                if not len(change):
                    break
                cut = int(fit[-1] if len(fit) else change[0])
                yield from found(table.slice(0, cut))
                table = table.slice(cut)
            rest = table
        if rest is not None and rest.num_rows:
            yield from found(rest)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, h1 = table.column("key").to_numpy(), table.column("h1").to_numpy()
        # Repeated rows of a document give the same piece several times.
        table = table.filter(pa.array(np.concatenate([[True], (key[1:] != key[:-1]) | (h1[1:] != h1[:-1])])))
        pieces = table.column("piece").to_pylist()
        first, last = worth(pieces, table.column("lead").to_numpy(), table.column("key").to_numpy())
        held = np.nonzero(last > first)[0].tolist()
        marks = repeated_starts([pieces[i][first[i] : last[i]] for i in held])
        runs: list[list[int]] = [[]] * len(pieces)
        for i, x in zip(held, marks, strict=True):
            runs[i] = _coded(x, int(first[i]))
        has = np.fromiter(map(bool, runs), bool, len(runs))
        if has.any():
            named = table.select(["key", "h1"]).filter(pa.array(has)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(named.column(c).combine_chunks() for c in ("key", "h1")), pa.array([r for r in runs if r], pa.list_(pa.int64()))], names=["key", "h1", "runs"])

    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), unlike // TASK_PIECES)
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "h1").mapInArrow(run, _RUNS)


def _count_windows(pieces: DataFrame) -> DataFrame:
    """The same for groups of any size, by a count of each 200-byte string."""
    types = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("key", pa.int64()), ("h1", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                pieces = part.column("piece").to_pylist()
                many = np.array([len(p) - MATCH + 1 for p in pieces], np.int64)
                raw = b"".join([xxhash.xxh3_128_digest(p[k : k + MATCH]) for p in pieces for k in range(len(p) - MATCH + 1)])
                w = np.frombuffer(raw, np.int64).reshape(-1, 2)
                names = [np.repeat(part.column(c).to_numpy(zero_copy_only=False), many) for c in ("key", "h1")]
                start = np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (w[:, 0], w[:, 1], *names, start))], schema=types)

    windows, _ = store(pieces.dropDuplicates(["key", "h1"]).mapInArrow(run, "w1 long, w2 long, key long, h1 long, at long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    code = F.shiftleft("at", _RUN) + 1
    return windows.join(twice, ["w1", "w2"]).groupBy("key", "h1").agg(F.collect_list(code).alias("runs"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), text_or_empty()))


def repeated_spans(docs: DataFrame, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, text_hash, spans): the runs of repeated starts of each document that has any.

    Anchors held once, which most are, go out before any piece is shuffled: they are counted first,
    and a filter of those that repeat stands at the second look at the texts. What else it passes
    stays alone in its group and is dropped there.
    """
    rows = _keyed(docs).select("doc_id", "text_hash", text_or_empty().cast("binary").alias("raw"))
    anchors, path = store(_anchors(rows).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated-anchors")
    held = build_filter(anchors, "key", anchors.count())
    discard(docs.sparkSession, path)
    seen, _ = store(_occurrences(rows, held), "occurrences")
    pieces = seen.groupBy("key", "h1").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "doc_id", "place")).alias("first"))
    pieces, _ = store(pieces, "pieces")
    groups, _ = store(pieces.groupBy("key").agg(F.count("*").alias("unlike")).filter("unlike > 1"), "piece-groups")
    fetched, _ = store(_fetch(rows, pieces.join(groups.select("key"), "key", "left_semi")), "fetched-pieces")
    large = groups.filter(F.col("unlike") > group_pieces).select("key")
    usual = _search(fetched.join(large, "key", "left_anti"), groups.agg(F.sum("unlike")).first()[0] or 0)
    counted = _count_windows(fetched.join(large, "key", "left_semi"))
    copied = pieces.filter("n > 1").select("key", "h1", F.array(F.col("first.place").bitwiseAND(_BYTE)).alias("runs"))
    runs, _ = store(usual.unionByName(counted).unionByName(copied), "repeated-starts")
    moved = seen.join(runs, ["key", "h1"]).select(
        F.col("doc_id").alias("_span_id"), F.col("text_hash").alias("_span_hash"), F.explode("runs").alias("run"), F.shiftright("place", _START).alias("start")
    )
    moved = moved.select("_span_id", "_span_hash", (F.col("run") + F.shiftleft("start", _RUN)).alias("run"))
    # Dealt first, so that the lists are made once, where they are needed.
    return moved.repartition("_span_hash").groupBy("_span_id", "_span_hash").agg(F.collect_list("run").alias("_spans"))


def _removed(raw: bytes, spans: np.ndarray | None) -> tuple[int, int, int, bytes]:
    if spans is None or not len(spans):
        return len(raw), 0, 0, raw
    spans = np.sort(np.asarray(spans, np.int64))
    first, last = spans >> _RUN, (spans >> _RUN) + (spans & ((1 << _RUN) - 1)) + (MATCH - 1)
    last = np.maximum.accumulate(last)
    opens = np.concatenate([[True], first[1:] > last[:-1]])
    a, b = first[opens], last[np.append(np.nonzero(opens)[0][1:] - 1, len(last) - 1)]
    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
    return len(raw), int((b - a).sum()), len(a), kept


def dedup_substrings(docs: DataFrame, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (binary: the bytes that stay) to ``docs``.

    A byte goes if a 200-byte string that covers it also starts anywhere else, in the same document
    or another; strings are judged on the input. Null and empty texts, and texts under 200 bytes,
    keep what they have. Repeated rows are documents of their own, so each repeats the other. A null
    doc_id is an id like any other. Clashing input columns are replaced; an empty table stays empty.
    Groups of more than ``group_pieces`` unlike pieces are counted string by string.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "_span_id", "_span_hash", "_spans", "text_hash")
    spans, _ = store(repeated_spans(docs.select("doc_id", "text"), group_pieces), "spans")
    held = build_filter(spans, "_span_hash", spans.count())

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, runs in batches:
            rows = [_removed(raw, spans) for raw, spans in zip(raws, runs, strict=True)]
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    rows, raw = _keyed(docs), text_or_empty().cast("binary")
    whole = _having(rows, held, False).drop("text_hash").withColumns(
        {"n_bytes": F.octet_length(raw).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": raw}
    )
    some = _having(rows, held).join(spans, (F.col("text_hash") == F.col("_span_hash")) & F.col("doc_id").eqNullSafe(F.col("_span_id")), "left")
    some = some.withColumn("_cut", cut(raw, F.col("_spans"))).drop("_spans", "_span_id", "_span_hash", "text_hash").select("*", "_cut.*").drop("_cut")
    return whole.unionByName(some)


def substring_digests(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
