"""Watches over streams: windows with watermarks, idempotent events, and one delta per revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.incremental import apply_delta


def event_time(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """Watermarks need a TIMESTAMP; zone-less times are taken in the session's zone."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed(events: DataFrame, column: str, size: str, slide: str | None = None, *by: str) -> DataFrame:
    """Counts and exact sums per window. Works on a stream with a watermark and on a table alike."""
    window = F.window(column, size, slide) if slide else F.window(column, size)
    out = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def once_per_event(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events by id; on a stream the ids are forgotten once the watermark has passed."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def on_time(events: DataFrame, column: str, horizon) -> tuple[DataFrame, DataFrame]:
    """(rows, late rows) against a declared horizon; late rows are kept apart and never dropped silently."""
    late = F.col(column) < F.lit(horizon)
    return events.filter(~late), events.filter(late)


def watch(changes: DataFrame, folder: str, publish, initial: DataFrame, every: int = 16) -> StreamingQuery:
    """One delta per revision: each micro-batch of signed rows (with ``n``) is a revision.

    ``publish(revision, delta, view)`` gets the net change and the view after it; folding the deltas
    gives the view. A revision writes its delta only. Each ``every`` revisions the view is written
    out, and later views start there; so a restarted stream goes on from what is written, and a
    repeated batch writes the same again.
    """

    def step(batch: DataFrame, revision: int) -> None:
        spark = batch.sparkSession
        keys = [c for c in batch.columns if c != "n"]
        delta = batch.groupBy(*keys).agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")
        delta.write.mode("overwrite").parquet(f"{folder}/delta-{revision}")
        since = revision - revision % every
        before = spark.read.parquet(f"{folder}/view-{since}") if since else initial
        deltas = spark.read.schema(delta.schema).parquet(*[f"{folder}/delta-{k}" for k in range(since, revision + 1)])
        view = apply_delta(before, deltas)
        if (revision + 1) % every == 0:
            view.write.mode("overwrite").parquet(f"{folder}/view-{revision + 1}")
        publish(revision, spark.read.schema(delta.schema).parquet(f"{folder}/delta-{revision}"), view)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
