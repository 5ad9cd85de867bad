from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd import docs, labels, texts  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import quality_rules, quality_trees, textstats

LABELS = "doc_id long, quality int, toxic int"


def _base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))


def _bucket(x, size):
    return (x % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> (64 - (size.bit_length() - 1))


def _probability(model, t):
    """The model's probability, gram by gram."""
    raw, size = t.encode(), len(model.word)
    words = [xxhash.xxh64_intdigest(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    word = [model.word[_bucket(x, size)] for x in [*words, *(3 * a + b for a, b in zip(words[:-1], words[1:], strict=True))]]
    three = [(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) + 1 for i in range(len(raw) - 2)]
    four = [three[i] << 8 | raw[i + 3] for i in range(len(raw) - 3)]
    char = [model.char[_bucket(x, size)] for x in three + four]
    margin = model.bias + sum(word) / max(len(word), 1) + sum(char) / max(len(char), 1)
    return 1 / (1 + np.exp(-(model.slope * margin + model.shift)))


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def long_texts():
    rnd = random.Random(3)
    return [" ".join(f"w{rnd.randrange(9000)}" for _ in range(50_000)), "ab cd " * 40_000 + "\n" * 500]


def test_base_counts_and_verdicts_equal_slow_ones(spark, given, texts, long_texts):  # noqa: F811
    model = quality_rules.fit_quality_rules(*given)
    assert model.word.any() and len(model.word) == quality_rules.BUCKETS
    some = [*texts, *long_texts, *(r["text"] for r in given[0].orderBy("doc_id").limit(60).collect())]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    for r in quality_rules.judge_quality(frame, model).collect():
        t = some[r["doc_id"]] or ""
        want, p = _base(t), _probability(model, t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert abs(r["probability"] - p) < 1e-9
        if abs(p - quality_rules.KEEP_FROM) > 1e-9:
            assert r["kept"] == (not want[-1] and p >= quality_rules.KEEP_FROM)


def test_fits_do_not_depend_on_partitions_or_repeated_rows(given):
    d, y = given
    one = quality_rules.fit_quality_rules(d, y)
    two = quality_rules.fit_quality_rules(d.union(d).repartition(7), y.union(y))
    assert (one.word == two.word).all() and (one.char == two.char).all() and one.slope == two.slope
    a, b = quality_trees.fit_quality_trees(d, y), quality_trees.fit_quality_trees(d.union(d).repartition(7), y.union(y))
    assert (a.leaf == b.leaf).all() and (a.feature == b.feature).all()


def test_sample_is_bounded_and_chosen_by_hash(spark):
    y = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 - 1).cast("int").alias("quality"))
    y = y.union(spark.createDataFrame([(None, 1), (70_000, None), (70_001, 5)], "doc_id long, quality int"))
    chosen = quality_trees.training_labels(y, 300)
    usable = y.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~quality_trees.held_out(F.col("doc_id")))
    want = sorted(r["doc_id"] for r in usable.orderBy(F.xxhash64("doc_id")).limit(300).collect())
    assert sorted(r["doc_id"] for r in chosen.collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, 0), (None, 1, 0), (2, 7, 0)]])
def test_unusable_labels(spark, docs, rows):  # noqa: F811
    y = spark.createDataFrame(rows, LABELS)
    model = quality_rules.fit_quality_rules(docs, y)
    assert not model.word.any() and model.probability("some text") == 0.5
    scored = quality_trees.quality_scores(docs, y).agg(F.min("score"), F.max("score")).first()
    assert scored[0] == scored[1]


def test_trees_equal_a_walk_row_by_row(given, texts, long_texts, spark):  # noqa: F811
    forest = quality_trees.fit_quality_trees(*given)
    some = [*texts, *long_texts]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in quality_trees.score_quality(frame, forest).collect()}
    for k, t in enumerate(some):
        x, margin = textstats.features(t or ""), forest.base
        for f, cut, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[f[node]] > cut[node] else 1)
            margin += leaf[node - len(f)]
        assert abs(got[k] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_splits_are_the_best_of_all_cuts():
    """One tree of one level against all features and all bin borders."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (400, 5)).astype(float)
    y = ((x[:, 3] > 6) ^ (rng.random(400) < 0.1)).astype(float)
    forest = quality_trees.fit_forest(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, cut):
        left = x[:, f] <= cut
        if h[left].sum() < 1 or h[~left].sum() < 1:
            return 0
        return sum(g[s].sum() ** 2 / (h[s].sum() + quality_trees.L2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality_trees.L2)

    best = max(gain(f, cut) for f in range(5) for cut in range(12))
    assert abs(gain(int(forest.feature[0, 0]), forest.threshold[0, 0]) - best) < 1e-9


def test_held_out_rows(given):
    d, y = given
    scored = quality_trees.quality_scores(d, y).join(y, "doc_id").filter("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    judged = quality_rules.quality_verdicts(d, y).join(y, "doc_id").filter(quality_trees.held_out(F.col("doc_id")))
    assert judged.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.9
    assert judged.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.2


def test_empty_tables(docs, labels):  # noqa: F811
    assert quality_rules.quality_verdicts(docs.filter("false"), labels).count() == 0
    assert quality_trees.quality_scores(docs.filter("false"), labels).count() == 0
