"""The corpus pipeline: documents in, encoded documents out.

Each stage works on all rows that the stage before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from athletrack.llm import neardup, phrases, pieces, pii, quality
from athletrack.llm.base import read, without, written
from athletrack.llm.registry import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts get the score of a text without features; repeated rows and null ids are each judged by their
    own text. An empty table stays empty.
    """
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels"), F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, 0.8).

    Null and empty texts and rows with a null doc_id are in no group and stay. Rows that repeat a doc_id are one
    document: they stay or go together.
    """
    return without(docs, neardup.near_duplicates(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts and null ids match nothing and stay; rows that repeat a doc_id go together if one of them has a
    passage; null and empty items have none.
    """
    return without(docs, phrases.contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by their kind; n_chars follows the text, null for a null text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the documents as token ids, none for null and empty texts; each row by itself, null ids too."""
    return pieces.encode(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal-data", redact), ("pieces", encode)]
ORACLE_SQL = None  # classifiers, redaction and segmentation are no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
