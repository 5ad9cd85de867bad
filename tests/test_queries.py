from __future__ import annotations

import pytest
from compare import duck, rows_of
from pyspark.sql import functions as F

from conftest import DATA
from tidemark import queries as core

QUERIES, ORACLES = core.queries(), core.oracle_sql()
#: Queries that find nothing in the smallest tables are compared on larger ones.
LARGER, SPARSE = "/root/testdata/sf0.01", ("re5_reconcile", "sa3_lasso", "sa5_refines")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, name):
    folder = LARGER if name in SPARSE else DATA
    got = QUERIES[name](spark, folder).toArrow()
    assert got.num_rows
    if name in ORACLES:
        want = duck(ORACLES[name], folder)
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows_of(got) == rows_of(want)


def test_approximate_counts_are_near(spark):
    got = {r["event_type"]: r["users"]["value"] for r in QUERIES["ag13_approx_distinct"](spark, DATA).collect()}
    want = {r["event_type"]: r["n"] for r in spark.read.parquet(f"{DATA}/events.parquet").groupBy("event_type").agg(F.count_distinct("user_id").alias("n")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 0.06 * want[k] + 1 for k in want)


def test_clusters_are_those_of_the_nearest_centres(spark):
    got = {r["prediction"]: r["n"] for r in QUERIES["ml2_cluster"](spark, DATA).collect()}
    assert sum(got.values()) == spark.read.parquet(f"{DATA}/part.parquet").count() and len(got) == 4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_custkey", "n_orders", "total_cents", "max_cents"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
