"""Line dedup across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, store, text_or_empty

MIN_CHARS = 40
MIN_DOCS = 5


def _lines(column: str = "text") -> Column:
    return F.split(text_or_empty(column), "\n")


def _row_key(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and text; rows that agree in both get the same decisions."""
    return docs.withColumn("_text_hash", F.xxhash64(text_or_empty()))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: doc_id, _text_hash, pos and 128 bits of the key."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(ASCII_SPACE)))
    return (
        _row_key(docs.select("doc_id", "text"))
        .select("doc_id", "_text_hash", F.posexplode(_lines()).alias("pos", "line"))
        .select("doc_id", "_text_hash", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "_text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(31), "key").alias("h2"))
    )


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of the keys that at least ``min_docs`` documents hold, with the largest such doc_id."""
    return (
        _keyed_lines(docs, min_chars)
        .groupBy("h1", "h2")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keep_id"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keep_id")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop shared lines from ``text`` except in the largest doc_id; adds n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Only
    positions and hashes are shuffled by key; the texts move once, by document. Null or empty texts
    are one empty line and become empty; a document whose lines all go becomes empty. A null doc_id
    counts as no document and never keeps a line. Repeated rows count as one document. Other columns
    stay as they are; input columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    hot, _ = store(shared_lines(docs, min_chars, min_docs), "shared-lines")
    gone = (
        _keyed_lines(docs, min_chars)
        .join(hot, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("doc_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash"))
        .agg(F.collect_set("pos").alias("_gone"))
    )
    held = _row_key(docs)
    same = held["doc_id"].eqNullSafe(gone["_gone_id"]) & (held["_text_hash"] == gone["_gone_hash"])
    lines, n_gone = _lines(), F.coalesce(F.size("_gone"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    return (
        held.join(gone, same, "left")
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(n_gone).cast("long"))
        .withColumn("text", F.when(F.col("_gone").isNull(), text_or_empty()).otherwise(kept))
        .drop("_lines", "_gone", "_gone_id", "_gone_hash", "_text_hash")
    )


def line_dedup_digests(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )
