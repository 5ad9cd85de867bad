"""The corpus pipeline: documents that are good, without shared lines and near copies, mixed and coded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import recode_bpe
from tidemark.llm.common import store, table
from tidemark.llm.jaccard import one_of_each
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import emit_copies, mix_sources
from tidemark.llm.quality_trees import fit_quality_trees, score_quality

#: Documents scored below this are rejected.
KEEP_FROM = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labels of ``sf_dir``.

    Null and empty texts are judged like any text; without usable labels every score is 0.5 and all
    documents stay. Rows are judged one by one, so repeated rows share their fate. The columns stay
    as they are; only ``_score`` may not be one of them.
    """
    forest = fit_quality_trees(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, forest, "_score").filter(F.col("_score") >= KEEP_FROM).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text.

    A document whose lines all go stays with an empty text, as do null texts. Repeated rows count as
    one document; of documents with a line, the largest doc_id keeps it, and a null id never does.
    """
    left = dedup_lines(docs).select(*docs.columns)
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else left


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Documents without words, and rows with a null id, are like no other and stay; of rows that
    repeat a doc_id one stays.
    """
    return one_of_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate grants, from not at all to twice.

    A null source is a source of its own; a document without words is taken like the others of its
    source, and not at all if the source has no words. Rows with equal ids share their draw.
    """
    return emit_copies(mix_sources(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the text that they decode to; one row per row.

    Null texts count as empty, and empty ones have no ids and decode to ''. Repeated rows (copies of
    the mix) are coded alike.
    """
    coded = recode_bpe(docs.select("doc_id", "source", "lang", "text"), keep=False).withColumn("n_tokens", F.size("ids").cast("long"))
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", "decoded")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near copies", near_copies), ("mix", mix), ("tokens", tokens)]

#: The first and third stage are a fitted model and a graph search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``; each is written and read again.

    An empty table goes through all stages and gives no row. Columns beside those of documents pass
    through all stages but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = store(docs, f"stage-{k}")
    return docs
