"""The whole report of a session against its parts, and reports that a stream writes once."""

import pytest
from pyspark.sql import functions as F

from athletrack.operators import metrics
from athletrack.operators.reports import session_report
from athletrack.plans import fixtures as fx
from athletrack.plans.queries import _assessed
from athletrack.streaming import reports


def test_the_report_has_the_figures_of_its_parts(spark, sf_dir):
    log, sessions, requests = fx.taken_log(spark, sf_dir), fx.sessions(spark, sf_dir), fx.requests(spark, sf_dir)
    assessed = _assessed(spark, sf_dir)
    report = {r["session_id"]: r for r in session_report(log, sessions, requests, assessed).collect()}
    assert len(report) == sessions.count()
    assert all(report[r["session_id"]]["throughput"].asDict() == {k: v for k, v in r.asDict().items() if k != "session_id"} for r in metrics.session_throughput(log, sessions).collect())
    for name, key, part in (
        ("freshness", "scope", metrics.session_freshness(log, sessions)), ("classes", "frame_stage", metrics.frame_class_latency(log, sessions)), ("detectors", "scope", metrics.detector_worker_stats(requests, sessions)),
    ):
        rows = part.collect()
        assert sum(len(r[name] or {}) for r in report.values()) == len(rows)
        for r in rows:
            assert report[r["session_id"]][name][r[key]].asDict() == {k: v for k, v in r.asDict().items() if k not in ("session_id", key)}
    for r in metrics.detector_reason_counts(requests, sessions).collect():
        assert report[r["session_id"]]["reasons"][f"{r['scope']}:{r['reason']}"] == r["n"]
    edges = {r["session_id"]: r for r in metrics.edge_actionable_split(assessed).collect()}
    assert any(i in report for i in edges)
    for i, r in report.items():
        assert (r["edges"] is None) == (i not in edges) and (i not in edges or r["edges"]["actionable"] == edges[i]["actionable"])


def test_sessions_without_rows_and_empty_tables(spark, sf_dir):
    log, requests = fx.taken_log(spark, sf_dir).limit(0), fx.requests(spark, sf_dir).limit(0)
    sessions = spark.createDataFrame([(1, 0.0, 5.0, 3.0), (None, 0.0, 5.0, 3.0)], "session_id long, started_at double, ended_at double, warmup_seconds double")
    rows = sorted(session_report(log, sessions, requests).collect(), key=str)
    assert [r["session_id"] for r in rows] == [1, None] or [r["session_id"] for r in rows] == [None, 1]
    assert all(r["throughput"] is None and r["freshness"] is None and r["detectors"] is None for r in rows)
    assert session_report(log, sessions.limit(0), requests).count() == 0


def _run(spark, folder, assemble, tmp_path, checkpoint):
    stream = spark.readStream.schema("session_id bigint").option("maxFilesPerTrigger", 1).parquet(folder)
    query = reports.write_reports_stream(stream, assemble, str(tmp_path / "out"), str(tmp_path / checkpoint), "json").trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_batch_that_runs_again_writes_each_session_once(spark, tmp_path):
    folder = str(tmp_path / "closed")
    spark.createDataFrame([(1,), (2,), (None,)], "session_id long").coalesce(1).write.parquet(folder)
    calls = []

    def assemble(ids):
        calls.append(sorted(r[0] for r in ids.collect()))
        return ids.withColumn("n", F.col("session_id") * 10)

    def fails_after_writing(ids):
        out = assemble(ids)
        out.write.mode("overwrite").json(str(tmp_path / "out" / "reports" / "feed=lost" / "batch=0"))  # a feed that stopped before its ledger
        raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        _run(spark, folder, fails_after_writing, tmp_path, "c")
    _run(spark, folder, assemble, tmp_path, "c")  # the same batch again
    spark.createDataFrame([(2,), (3,)], "session_id long").coalesce(1).write.mode("append").parquet(folder)
    _run(spark, folder, assemble, tmp_path, "c")  # 2 has been reported
    _run(spark, folder, assemble, tmp_path, "other")  # without the checkpoint: nothing is new
    assert calls == [[1, 2], [1, 2], [3], [], []]
    got = sorted((r["session_id"], r["n"]) for r in reports.read_reports(spark, str(tmp_path / "out"), "session_id bigint, n bigint", "json").collect())
    assert got == [(1, 10), (2, 20), (3, 30)]
    with pytest.raises(ValueError):
        reports.write_reports_stream(spark.readStream.schema("session_id bigint").parquet(folder), assemble, "x", "y", "csv")
