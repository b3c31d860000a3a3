"""Reports of sessions that have ended on a stream, each written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from athletrack.operators.reports import session_report

LEDGER = "session_id bigint, feed string, batch bigint"


def reports_from(frame_log: DataFrame, sessions: DataFrame, requests: DataFrame | None = None, assessed: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Assembles ``session_report`` of the given session_ids from stored tables."""

    def assemble(ids: DataFrame) -> DataFrame:
        of = lambda df: None if df is None else df.join(ids, "session_id", "left_semi")
        return session_report(of(frame_log), of(sessions), of(requests), of(assessed))

    return assemble


def write_reports_stream(closed: DataFrame, assemble: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, fmt: str = "parquet") -> DataStreamWriter:
    """Writes ``assemble``'s reports of the sessions that ``closed`` names (such as ``stream_session_summary`` in append mode).

    A batch has a folder by the feed's id and its number, and what it has written stands in a ledger afterwards. A batch
    that is run again replaces its own folder; a session that another batch or feed has in the ledger is not written
    again, so it is reported once even if the stream starts anew without its checkpoint. Rows without a session_id have no report.
    """
    if fmt not in ("parquet", "json"):
        raise ValueError("reports are written as parquet or json")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        feed = spark.read.json(f"{checkpoint}/metadata").first()["id"]  # stays the same as long as the checkpoint does
        spark.createDataFrame([], "session_id bigint").write.mode("ignore").parquet(f"{path}/ledger/feed=none/batch=-1")
        own = (F.col("feed") == feed) & (F.col("batch") == number)
        known = spark.read.schema(LEDGER).parquet(f"{path}/ledger").where(~own)
        ids = batch.select(F.col("session_id").cast("bigint")).where("session_id is not null").distinct().join(known, "session_id", "left_anti")
        report, place = assemble(ids), f"feed={feed}/batch={number}"
        report.write.mode("overwrite").format(fmt).save(f"{path}/reports/{place}")
        done = spark.read.format(fmt).schema(report.schema).load(f"{path}/reports/{place}")
        done.select("session_id").write.mode("overwrite").parquet(f"{path}/ledger/{place}")

    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)


def read_reports(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The reports that stand in the ledger; folders of batches that have not finished are left out."""
    reports = spark.read.format(fmt).schema(f"{schema}, feed string, batch bigint").load(f"{path}/reports")
    ledger = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    return reports.join(ledger, ["session_id", "feed", "batch"], "left_semi").drop("feed", "batch")
