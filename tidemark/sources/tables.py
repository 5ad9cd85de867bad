"""Table sources, an ingestion contract with quarantine, and tables in the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a task that holds what it is dealt, as a set or sorted.
TASK_ROWS = 1 << 19


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_files(spark: SparkSession, path: str, kind: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON lines, CSV, XML or text. Row formats need a schema: nothing is inferred by a second pass."""
    if kind in ("json", "csv", "xml") and schema is None:
        raise ValueError(f"{kind} is read with a declared schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def ingest(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): quarantined rows carry the names of the checks they fail in ``findings``.

    A check that is NULL counts as failed. Of rows that agree in everything one is accepted; rows
    that share a key but differ are all quarantined, so that no value wins silently.
    """
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    judged = rows.distinct().withColumn("findings", failed)
    clash = judged.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    clash = clash.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.lit(True).alias("_clash"))
    joined = judged.join(clash, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    joined = joined.withColumn("findings", F.when(F.col("_clash"), F.array_append("findings", F.lit("key_conflict"))).otherwise(F.col("findings")))
    joined = joined.select(*rows.columns, "findings")
    return joined.filter(F.size("findings") == 0).drop("findings"), joined.filter(F.size("findings") > 0)


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of this machine only in local mode with none set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write and reread: cuts the lineage, survives lost executors and tells Catalyst the true size."""
    path = f"{scratch_folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in tasks of about TASK_ROWS, if there are ``count``: more rows make more tasks, not larger ones.

    Rows that are mostly distinct should be dealt before they are grouped. Else Spark first groups
    what each task reads; a split of narrow Parquet rows has many millions, all of them held.
    """
    return rows.repartition(max(1, -(-count // TASK_ROWS)), *keys)
