from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd import components, docs, texts  # noqa: F401

from tidemark.llm import jaccard
from tidemark.llm.bloom import BLOCKS, blocks_of, gathered
from tidemark.llm.common import text_batches


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _want(texts):
    """All pairs, by the product of the table of texts and shingles."""
    sets = [_shingles(t) for t in texts]
    seen = Counter(x for s in sets for x in s)
    shared = {x: k for k, x in enumerate(x for x, n in seen.items() if n > 1)}
    held = np.zeros((len(sets), len(shared)), np.float32)
    for k, s in enumerate(sets):
        held[k, [shared[x] for x in s if x in shared]] = 1
    both, size = np.rint(held @ held.T), np.array([len(s) for s in sets])
    near = (both > 0) & (100 * both >= 75 * (size[:, None] + size - both))
    pairs = np.argwhere(np.tril(near, -1)).tolist()
    return [(k, len(s), x) for k, (s, x) in enumerate(zip(sets, components(len(sets), pairs), strict=True))]


def _got(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(tuple(r) for r in jaccard.jaccard_components(docs).collect())


def test_jaccard_join_equals_all_pairs(docs, texts):
    sets = [_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(len(sets), pairs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {k: (len(s), want[k]) for k, s in enumerate(sets)}


def test_jaccard_join_of_repeated_rows(spark):
    """The first and last text of four link with both between them, which don't link with each other: their groups have the same ends."""
    texts = []
    for c in range(12):
        base = [f"c{c}w{k}" for k in range(104)]
        between = [" ".join(base[:at] + [f"c{c}v{at + k}" for k in range(10)] + base[at + 10 :]) for at in (20, 60)]
        texts += [" ".join(base), *between, " ".join([*base, f"c{c}end"])]
    sets = [_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = [(k, len(s), x) for k, (s, x) in enumerate(zip(sets, components(len(sets), pairs), strict=True))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(docs.union(docs)).collect())) == sorted(want * 2)


def _near_copies(rnd, base, many, changes):
    out = []
    for _ in range(many):
        words = list(base)
        for at in rnd.sample(range(len(words)), rnd.randint(*changes)):
            words[at] = f"v{rnd.randrange(10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("many", "length", "changes"), [(9, 120, (0, 6)), (100, 300, (3, 9)), (3000, 150, (2, 4))])
def test_groups_of_near_copies_equal_all_pairs(spark, many, length, changes):
    """Copies of one text that link with some of each other; the trees have up to four levels."""
    rnd = random.Random(many)
    texts = _near_copies(rnd, [f"b{k}" for k in range(length)], many, changes) + [" ".join(f"o{k}" for k in range(50))]
    assert _got(spark, texts) == _want(texts)


def test_parts_of_a_large_neighbourhood_meet(spark, monkeypatch):
    """With small parts, links between parts are found by the second pass; the first leaves several components."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rnd = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    texts = [" ".join(base)] + _near_copies(rnd, base, 150, (4, 9))
    assert _got(spark, texts) == _want(texts)


def test_given_tables_equal_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    texts = [r["text"] for r in rows]
    assert _got(spark, texts) == _want(texts)


def test_sets_of_one_long_document_and_odd_ones(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    near = long[:59_000] + ["other"] * 3
    texts = [" ".join(long), " ".join(near), None, "", " \n", "a b", "A  b", "a b c d", "a", " ".join(long[:40_000])]
    assert _got(spark, texts) == _want(texts)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 2, None), (3, 2, 2), (3, 2, 2), (2, 2, 2), (9, 0, 9), (9, 0, 9)], key=str)
    left = sorted(map(tuple, jaccard.one_of_each(docs).collect()), key=str)
    assert left == sorted([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (9, None)], key=str)


def test_search_in_trees_of_four_levels_equals_all_pairs():
    """Sets of three sizes in many groups of one batch; every connecting link is a link, and none is missed."""
    draw = np.random.default_rng(5)
    group, sets = [], []
    for g in range(60):
        base = draw.integers(0, 2**63, (100, 130, 600)[g % 3]).astype(np.uint64)
        for _ in range(int(draw.integers(1, 40))):
            tokens = base.copy()
            changed = int(draw.integers(0, len(base) // 4))
            tokens[draw.choice(len(base), changed, replace=False)] = draw.integers(0, 2**63, changed)
            sets.append(np.unique(tokens))
            group.append(g)
    group, ids = np.array(group), np.arange(len(sets))
    assert len(sets) > jaccard.FANOUT**3
    pairs = [(int(i), int(j)) for g in range(60) for i in ids[group == g] for j in ids[group == g] if j < i and jaccard.linked(sets[i], sets[j])]
    found = jaccard.connecting_links(group, ids, ids, sets)
    assert components(len(sets), found.tolist()) == components(len(sets), pairs)
    assert {tuple(p) for p in found.tolist()} <= set(pairs) and len(found) < len(sets)


def test_traversal_keeps_every_linked_pair():
    """Without labels and neighbourhoods, what the traversal drops are pairs that can't link."""
    draw = np.random.default_rng(6)
    base = draw.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: int(draw.integers(60, 100))], draw.integers(0, 2**63, int(draw.integers(0, 30))).astype(np.uint64)])) for _ in range(700)]
    sizes, nothing = np.array([len(s) for s in sets]), np.zeros(700, np.int64)
    order = np.argsort(sizes, kind="stable")
    tree = jaccard.SignatureTree(jaccard.bitmaps([sets[k] for k in order], 1024), sizes[order], nothing, np.arange(700))
    kept = {(int(i), int(j)) for x, y in jaccard.dual_traversal(tree, tree) for i, j in zip(x, y, strict=True)}
    assert len(tree.levels) == 4
    pairs = {(i, j) for i in range(700) for j in range(i + 1, 700) if jaccard.linked(sets[order[i]], sets[order[j]])}
    assert pairs <= kept and len(kept) < 700 * 699 // 2


def test_a_task_sends_a_sparse_sketch_in_few_bytes(spark):
    """Each task sends its own sketch: whole blocks of zeros and one record batch of 16 MB took the executors' memory."""
    counts = np.zeros(1 << 20, np.int32)
    counts[:: 1 << 9] = 7
    sent = list(blocks_of(counts))
    assert max(b.num_rows for b in sent) <= 256 and sum(b.nbytes for b in sent) < counts.nbytes / 16
    parts = spark.range(3, numPartitions=3).mapInArrow(lambda batches: (out for _ in batches for out in blocks_of(counts)), BLOCKS)
    assert np.array_equal(gathered(parts, len(counts), np.int32, np.add), 3 * counts)


def test_texts_go_to_python_some_rows_at_a_time(spark):
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 2500, numPartitions=1)
    before = spark.conf.get(name)
    with text_batches(spark):
        assert [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()] == [1000, 1000, 500]
    assert spark.conf.get(name) == before
