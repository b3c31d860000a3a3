"""What the operators of this subpackage share: written tables, label folds, filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from athletrack.sources.shared import new_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices: Python objects are made for a few hundred texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


RING = 1 << 30


def hash_sample(df: DataFrame, key: Column, limit: int, n: int | None = None) -> DataFrame:
    """The ``limit`` rows that come first by the hash ``key``, or all if there are fewer.

    Only rows that may be among them leave their tasks, whatever the number of partitions. ``n``: rows, if known.
    """
    n = df.count() if n is None else n
    place = F.pmod(key, F.lit(RING))
    df = df if n <= limit else df.where(place < int(min(1.0, (1.2 * limit + 200) / n) * RING))
    return df.orderBy(place, key).limit(limit)


def distinct_sample(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(h, column): at most ``limit`` distinct values of a text column, chosen by their hash ``h``; copies meet before they leave their tasks."""
    hashed = df.select(F.xxhash64(column).alias("h"), column)
    n = hashed.select("h").distinct().count()
    few = hashed if n <= limit else hashed.where(F.pmod("h", F.lit(RING)) < int(min(1.0, (1.2 * limit + 200) / n) * RING))
    return hash_sample(few.groupBy("h").agg(F.min(column).alias(column)), F.col("h"), limit, 0)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int):
    """At most ``limit`` labelled (doc_id, text, label) rows, chosen by the hash of doc_id.

    One label per doc_id (the largest where rows repeat); null labels and rows outside ``keep`` are left out.
    The bound is on what the driver fits on; scoring always reads every row.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.coalesce(keep, F.lit(False)))
    chosen = hash_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), F.xxhash64("doc_id"), limit)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # limit rows at most
        .groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    return sorted(rows.collect(), key=lambda r: r["doc_id"])


def without(docs: DataFrame, ids: DataFrame, limit: int = 500_000) -> DataFrame:
    """Rows of ``docs`` whose doc_id (null included) is not in ``ids``: texts are shuffled only where more than ``limit`` ids go."""
    ids = written(ids.select(F.col("doc_id").alias("_gone_doc_id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_gone_doc_id")), "left_anti")
