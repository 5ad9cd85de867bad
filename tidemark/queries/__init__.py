"""The operators as queries over the synthetic tables, each with a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import assurance, evaluation, learning, ledger, recursion, relational, revisions, scalars, settlement, summaries

GROUPS = (relational, summaries, scalars, recursion, settlement, revisions, evaluation, ledger, assurance, learning)


def _bound(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(lambda name: read_table(spark, folder, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(build) for group in GROUPS for name, (build, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
