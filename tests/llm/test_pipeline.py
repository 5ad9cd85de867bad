from __future__ import annotations

import duckdb
import pytest
from odd import components, docs, labels, sha, texts  # noqa: F401
from pyspark.sql import functions as F
from test_jaccard import _shingles

from conftest import DATA
from tidemark.llm import bpe, line_dedup, mixing, quality_trees, queries, textstats

SPACE = " \t\n\x0b\x0c\r"


def _low(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def _slow_lines(rows):
    """(doc_id, text) with shared lines dropped, by a dictionary of keys."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_low(line)) >= 40:
                holders.setdefault(_low(line), set()).add(i)
    shared = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len({i for i in ids if i is not None}) >= 5}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if _low(x) not in shared or shared[_low(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def _odd(spark, texts):  # noqa: F811
    """Repeated rows, null ids and null sources beside the usual ones."""
    rows = [(None if k % 9 == 4 else k - k % 2 * (k % 5 == 0), t, ["a", None, "b"][k % 3]) for k, t in enumerate(texts)]
    rows += rows[12:20]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash")).withColumn("size", F.lit("clash"))


def test_line_dedup_equals_a_slow_one(spark, texts):  # noqa: F811
    rows, frame = _odd(spark, texts)
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(frame).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    assert got == sorted(_slow_lines([r[:2] for r in rows]), key=str)
    digests = sorted((tuple(r) for r in line_dedup.line_dedup_digests(frame).collect()), key=str)
    assert digests == sorted(((i, n, d, sha(t)) for i, n, d, t in _slow_lines([r[:2] for r in rows])), key=str)


def test_mix_equals_its_twin_on_odd_rows(spark, texts):  # noqa: F811
    rows, frame = _odd(spark, texts)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    names = ["doc_id", "size", "source_size", "taken", "copies"]
    want = sorted(con.sql(f"select {', '.join(names)} from ({queries.MIX_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in mixing.mixed_sizes(frame).select(*names).collect()), key=str) == want
    copies = mixing.emit_copies(mixing.mix_sources(frame))
    assert copies.count() == sum(r[-1] for r in want) and copies.agg(F.max("copy")).first()[0] <= 2


def test_mix_of_sources_without_words(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, " ", "a")], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.mixed_sizes(frame).collect()} == {0}


def test_pipeline_equals_slow_stages(spark):
    """Each stage by a plain version, on what the stage before it left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{DATA}/documents.parquet")
    forest = quality_trees.fit_quality_trees(given, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [r for r in given.collect() if forest.score(textstats.features(r["text"] or "")[None])[0] >= corpus_pipeline.KEEP_FROM]
    texts_now = {i: t for i, _, _, t in _slow_lines([(r["doc_id"], r["text"]) for r in rows])}
    ids = sorted(texts_now)
    sets = [_shingles(texts_now[i]) for i in ids]
    pairs = [(x, y) for x in range(len(ids)) for y in range(x) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    kept = {ids[k] for k, root in enumerate(components(len(ids), pairs)) if root == k}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], texts_now[r["doc_id"]], r["source"]) for r in rows if r["doc_id"] in kept])
    library, want = Tokenizer.from_file(bpe.default_path()), []
    for i, copies in con.sql(f"select doc_id, copies from ({queries.MIX_SQL})").fetchall():
        tokens = library.encode(texts_now[i], add_special_tokens=False).ids
        want += [(i, len(tokens), tokens, library.decode(tokens, skip_special_tokens=False))] * copies
    got = [(r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert len(kept) < len(ids) < given.count()
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_rows(spark, docs, empty):  # noqa: F811
    import corpus_pipeline

    at = docs.withColumn("_score", F.lit(1)).drop("_score").unionByName(docs.filter("doc_id % 7 = 0")).unionByName(docs.filter("doc_id % 9 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    at = at.filter("false") if empty else at
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DATA).persist()
        assert sorted(at.columns) == sorted(docs.columns), name
        assert (at.count() == 0) == empty, name
    out = corpus_pipeline.STAGES[-1][1](spark, at, DATA)
    assert out.count() == at.count()
