from __future__ import annotations

import random
import sys

import pyarrow as pa
import pytest
from odd import docs, sha, texts  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def _equal(encoder, library, texts):
    ids, size = encoder.encode(texts)
    at = 0
    for text, n, want in zip(texts, size.tolist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == want.ids, ascii(text[:80])
        at += n


def test_digests_equal_the_library(docs, texts, library):  # noqa: F811
    for r in bpe.bpe_digests(docs).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_every_code_point(encoder, library):
    """Each alone between letters and digits, and with marks that compose with it."""
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [*range(0xA640, 0xA7FF), *range(0xFB00, 0xFB50), *range(0x10400, 0x10450), *range(0x1F600, 0x1F640)]
    for at in range(0, len(points), 2000):
        part = [chr(c) for c in points[at : at + 2000]]
        _equal(encoder, library, [f"a{c}B {c}{c}1" for c in part])
        _equal(encoder, library, [f"{c}̸ x{c}́y {c}̣̇" for c in part])


def test_long_texts_and_words(encoder, library):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 30))) for _ in range(3000)]
    _equal(encoder, library, [" ".join(rnd.choices(words, k=200_000)), "ab" * 60_000, "x", "", "Z" * 3000 + "\n" * 5000])


def test_caches_start_afresh(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_NODES", 50)
    rnd = random.Random(2)
    for _ in range(20):
        _equal(encoder, library, [" ".join("".join(rnd.choices("abcde", k=rnd.randint(1, 9))) for _ in range(30))])


def test_both_ways_alike_and_extra_columns(docs):  # noqa: F811
    held = docs.withColumnsRenamed({"size": "ids", "score": "decoded"}).unionByName(docs.withColumnsRenamed({"size": "ids", "score": "decoded"}).withColumn("doc_id", F.lit(None).cast("long")))
    one = bpe.recode_bpe(held)
    two = bpe.decode_bpe(bpe.encode_bpe(held))
    assert one.columns == two.columns == [c for c in held.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one.count() == held.count()
    assert bpe.recode_bpe(held.filter("false")).count() == 0


def test_odd_ids(spark, library):
    rows = [([5, 10**6, 7],), ([],), (None,), ([None, 5],), ([49000, 300],)]
    got = [r["decoded"] for r in bpe.decode_bpe(spark.createDataFrame(rows, "ids array<int>").coalesce(1)).collect()]
    assert got == [library.decode([i for i in ids or [] if i is not None], skip_special_tokens=False) for (ids,) in rows]


def test_portions_cover_all_rows():
    sizes = pa.array([3, bpe.PORTION * 2, 0, bpe.PORTION, 1]).to_numpy()
    cuts = list(bpe._portions(sizes))
    assert [k for c in cuts for k in range(c.start, c.stop)] == list(range(5)) and len(cuts) == 4


def test_new_words_are_coded_together(encoder):
    """The Python calls grow with the depth of the trie, not with the words."""
    rnd = random.Random(3)
    words = {"".join(rnd.choices("abcdefghij", k=rnd.randint(4, 14))) for _ in range(20_000)}
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(0) if event == "call" else None)
    try:
        encoder.trie.insert({w for w in words if w not in encoder.trie.words})
    finally:
        sys.setprofile(None)
    assert len(calls) < len(words) / 2


def test_blocks_equal_the_library(library, monkeypatch):
    """Words around the bound between the two ways, few a block and many pairs a slot, prefixes of each other, with null characters."""
    monkeypatch.setattr(bpe, "SHORT", 12)
    monkeypatch.setattr(bpe, "BLOCK", 64)
    monkeypatch.setattr(bpe, "PAIR_BITS", 4)
    with open(bpe.default_path(), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    rnd = random.Random(4)
    stems = ["".join(rnd.choices(letters, k=14)) for letters in ("aeinrst", "aeinrst", "éßжя你", "\x00!?~", "\x00") for _ in range(40)]
    _equal(encoder, library, [" ".join(s[:k] for s in rnd.sample(stems, 60) for k in range(1, 15)) for _ in range(6)])
    assert max(len(w.encode()) for w in encoder.trie.words) > 12
