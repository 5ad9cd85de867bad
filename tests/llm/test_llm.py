from __future__ import annotations

import pytest
from compare import duck, rows_of

from conftest import DATA
from odd import docs, labels, texts  # noqa: F401
from tidemark.llm import bpe, embeddings, jaccard, line_dedup, mixing, quality_trees, queries, suffix_dedup


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, name):
    assert rows_of(queries.queries()[name](spark, DATA).toArrow()) == rows_of(duck(queries.oracle_sql()[name]))


def test_empty_tables(spark, docs, labels):
    none = docs.filter("false")
    assert jaccard.jaccard_components(none).count() == 0
    assert suffix_dedup.dedup_substrings(none).count() == 0
    assert bpe.bpe_digests(none).count() == 0
    assert quality_trees.quality_scores(none, labels).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert embeddings.dedup_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
