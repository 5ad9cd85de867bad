from __future__ import annotations

import numpy as np
import pytest
from odd import components
from pyspark.sql import functions as F

from tidemark.llm import embeddings


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 16))
    x[30:45] = x[:15] + rng.normal(size=(15, 16)) * 0.15
    x[45:50] = x[0]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(60, None), (61, [0.0] * 16), (62, [float("nan")] * 16), (63, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = components(64, [tuple(p) for p in np.argwhere(near)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.dedup_embeddings(table).collect()}
    assert got == {k: (int(near[k].sum()) if k < 60 else 0, comp[k], comp[k] == k) for k in range(64)}


def test_embedding_links_at_a_block_bound_count_once(spark):
    """Linked pairs whose distance in one block is within a hair of what a block may find."""
    rng, rows = np.random.default_rng(2), []
    for k in range(80):
        bound, apart = k % 3, rng.normal(size=(4, 4))
        square = np.where(np.arange(4) == bound, 0.025 + rng.uniform(-1.2e-5, 1.2e-5), 0.02)
        apart = (apart / np.linalg.norm(apart, axis=1, keepdims=True) * np.sqrt(square)[:, None]).ravel()
        middle = rng.normal(size=16)
        middle -= apart * (middle @ apart) / (apart @ apart)
        middle *= np.sqrt(1 - apart @ apart / 4) / np.linalg.norm(middle)
        rows += [(middle + apart / 2) @ embeddings.rotation(16).T, (middle - apart / 2) @ embeddings.rotation(16).T]
    x = np.array(rows)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.dedup_embeddings(table).collect()}
    assert got == {k: int(near[k].sum()) for k in range(len(x))}


def test_rotated_vectors_do_not_depend_on_their_task():
    rng = np.random.default_rng(3)
    for width in (7, 64, 300):
        x = rng.normal(size=(500, width))
        whole = embeddings._turned(embeddings._unit(x))
        for size in (1, 2, 13, 257):
            some = rng.choice(500, size, replace=False)
            assert (embeddings._turned(embeddings._unit(x[some])) == whole[some]).all()


def _all_pairs(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    comp = components(len(x), np.argwhere(np.tril(near)).tolist())
    return {k: (int(near[k].sum()), comp[k], comp[k] == k) for k in range(len(x))}


def _found(spark, x):
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.dedup_embeddings(table).collect()}


def test_hundreds_of_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(500, 32))
    side -= base * np.einsum("ij,ij->i", side, base)[:, None]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.97, (500, 1))
    x = np.concatenate([base, base * cosine + side * np.sqrt(1 - cosine**2)])
    assert _found(spark, x) == _all_pairs(x)


@pytest.mark.parametrize("task_rows", [7, 100])
def test_split_cells(spark, task_rows):
    """A dense spot in one cell, cut into many parts and slices."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(60, 16)) * 0.12, rng.normal(size=(60, 16))])
    vectors = spark.createDataFrame([(k, 1, bytearray(r.tobytes())) for k, r in enumerate(x)], "vec_id long, copies long, vector binary")
    rows = embeddings.find_links(vectors, task_rows=task_rows).collect()
    counts, pairs = dict.fromkeys(range(len(x)), 0), []
    for r in rows:
        if r["other"] is None:
            counts[r["vec_id"]] += r["links"]
        else:
            pairs.append((r["vec_id"], r["other"]))
    want, comp = _all_pairs(x), components(len(x), pairs)
    assert {k: (counts[k], comp[k], comp[k] == k) for k in counts} == want


def test_odd_vectors_and_ids(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0]
    rows = [(1, one), (2, [2.0, 0.0, 0.0, 0.0]), (None, one), (3, [None, 1.0, 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0, 0.0]), (5, two), (6, [0.0, 3.0]), (7, one), (7, one), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    got = sorted((tuple(r) for r in embeddings.dedup_embeddings(table).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 3, 1, False), (7, 3, 1, False), (8, 0, 8, True)]
    assert got == sorted(want, key=str)
