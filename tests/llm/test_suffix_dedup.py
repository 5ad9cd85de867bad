from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from compare import rows_of
from odd import docs, sha, texts  # noqa: F401

from tidemark.llm import suffix_dedup


def _want(texts, match=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + match] for b in raw for k in range(len(b) - match + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - match + 1):
            if seen[b[s : s + match]] > 1:
                gone[s : s + match] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b"")))
    return out


def _got(frame):
    rows = suffix_dedup.substring_digests(frame).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str)


def _equal(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert _got(frame) == sorted(((i, *w) for i, w in zip(ids, _want(texts), strict=True)), key=str)


def test_equals_counting(spark, texts):  # noqa: F811
    _equal(spark, texts)


def test_repeated_rows_and_null_ids(spark, texts):  # noqa: F811
    rnd = random.Random(4)
    alone = "".join(rnd.choices("abcdefgh ", k=900))
    some = [alone, alone, texts[12], "z" + texts[12], None, None, "".join(rnd.choices("abcdefgh ", k=700))]
    _equal(spark, some, [1, 1, None, None, None, 5, 5])


def test_texts_above_a_block(spark):
    """A passage across the border at which a long text is cut, in a text of more than BLOCK starts."""
    rnd = random.Random(9)
    filler = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=suffix_dedup.BLOCK + 3000))
    at = suffix_dedup.BLOCK - 150
    passage = filler[at : at + 400]
    texts = [filler, "x" * 50 + passage + "y" * 50, passage[100:320]]
    got = {r["doc_id"]: r for r in suffix_dedup.substring_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_removed"], got[0]["n_spans"]) == (400, 1)
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (400, 1)
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (220, 1)
    assert got[0]["kept_sha256"] == sha(filler[:at] + filler[at + 400 :])


def test_many_unlike_pieces_of_one_passage(spark):
    """One passage with other bytes around it and within it in many texts, in one group."""
    rnd = random.Random(11)
    passage = "".join(rnd.choices("abcdefgh ", k=330))
    texts = []
    for k in range(120):
        body = list(passage)
        for _ in range(k % 3):
            body[rnd.randrange(len(body))] = "#"
        texts.append("".join(rnd.choices("ijklmnop", k=100)) + "".join(body) + "".join(rnd.choices("ijklmnop", k=100)))
    _equal(spark, texts)


def test_large_groups_are_counted_alike(docs):  # noqa: F811
    usual = rows_of(suffix_dedup.dedup_substrings(docs).drop("text").toArrow())
    assert rows_of(suffix_dedup.dedup_substrings(docs, group_pieces=2).drop("text").toArrow()) == usual


def test_given_table_equals_counting(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    _equal(spark, [r["text"] for r in rows], [r["doc_id"] for r in rows])


@pytest.mark.parametrize("match", [1, 4, 9])
def test_collection_suffix_array(match):
    rnd = random.Random(match)
    for _ in range(15):
        base = bytes(rnd.choice(b"abc") for _ in range(50))
        pieces = [base[rnd.randrange(25) : rnd.randrange(25, 50)] for _ in range(rnd.randrange(1, 9))]
        seen = Counter(p[k : k + match] for p in pieces for k in range(len(p) - match + 1))
        for p, marks in zip(pieces, suffix_dedup.repeated_starts(pieces, match), strict=True):
            assert marks.tolist() == [seen[p[k : k + match]] > 1 for k in range(len(p) - match + 1)]
