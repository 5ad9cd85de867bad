"""Helpers of the tests of the training-data operators."""

from __future__ import annotations

import hashlib
import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, text_hash string"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.fixture(scope="session")
def texts():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choices(words, k=120)) for _ in range(6)]
    out = [None, "", " \n\t ", "one two", "One TWO", "x" * 5000, "ab" * 900, "é😀 " * 300, "<|endoftext|> a", "a\nb\n\n" + "line " * 20 + "\nz"]
    for k in range(40):
        w = base[k % 6].split()
        for _ in range(k % 5 * 3):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append(" ".join(w) + "\n" + "This is a line that very many of these documents have in common." + f"\nend {k % 7}")
    return out + out[10:14]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", ["a", None, "b"][k % 3], 0, "clash", "clash", "clash") for k, t in enumerate(texts)], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
