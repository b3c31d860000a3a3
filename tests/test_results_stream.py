"""Detector results on a live feed against the batch form, what comes late, and what is left in state."""

import random

import pytest
from pyspark.sql import functions as F

from athletrack.operators.timeline import apply_detector_results
from athletrack.streaming import results

FEED = "session_id long, request_id long, completed_at double", "session_id long, frame_index long, sequence long, loop_started_at double"


def _drain(spark, tmp_path, batches, **options):
    path = str(tmp_path / "in")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = results.apply_results_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect(), run


def _end(spark, schema, seconds):
    plain = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "event_ts"]
    return spark.range(1).select(*plain, F.timestamp_seconds(F.lit(seconds)).alias("event_ts")).select(*(f.name for f in schema))


@pytest.mark.parametrize("seed,delay", [(1, "20 seconds"), (2, "1 hour")])
def test_random_batches_give_the_batch_rows(spark, tmp_path, seed, delay):
    r = random.Random(seed)
    frames = [(s, k, 2 * k, k / 3 + r.random() / 4) for s in (1, 2, 3) for k in range(100)]
    found = [(s, 100 * s + k, r.choice([k / 1.5 + r.random(), frames[k][3]])) for s in (1, 2, 4) for k in range(50)] + [(1, 7, 5.0)] * 2
    f, d = spark.createDataFrame(frames, FEED[1]), spark.createDataFrame(found, FEED[0])
    rows = results.result_rows(d, f)
    dealt = {}
    for row in rows.collect():  # up to 15 seconds of time apart from its own
        dealt.setdefault(int((row["at"] + r.random() * 15) // 8), []).append(row)
    batches = [spark.createDataFrame(dealt[k], rows.schema) for k in sorted(dealt)] + [_end(spark, rows.schema, 1e5)]
    got, run = _drain(spark, tmp_path, batches, delay=delay)
    want = apply_detector_results(d, f).collect()
    assert sorted(tuple(x)[:5] for x in got if x["applied_frame"] is not None) == sorted(tuple(x) for x in want if x["applied_frame"] is not None)
    assert sorted(x["request_id"] for x in got if x["outcome"] == "no_frame") == sorted(x["request_id"] for x in want if x["applied_frame"] is None)
    assert {x["outcome"] for x in got} == {"applied", "no_frame"}
    kept = [s["numRowsTotal"] for p in run.recentProgress[-1:] for s in p["stateOperators"]]
    assert kept == [0]


def test_what_misses_the_watermark_says_so(spark, tmp_path):
    f = spark.createDataFrame([(1, k, k, float(k)) for k in (10, 20, 30)], FEED[1])
    d = spark.createDataFrame([(1, 1, 15.0), (1, 2, None), (1, 3, float("nan")), (None, 4, 12.0)], FEED[0])
    rows = results.result_rows(d, f)
    late = results.result_rows(spark.createDataFrame([(1, 5, 16.0), (1, 6, 95.0)], FEED[0]), spark.createDataFrame([(1, 16, 16, 16.0), (1, 99, 99, 99.0)], FEED[1]))
    got, _ = _drain(spark, tmp_path, [rows, _end(spark, rows.schema, 50), late, _end(spark, rows.schema, 1e5)], delay="1 second")
    said = {x["request_id"]: (x["session_id"], x["applied_frame"], x["outcome"]) for x in got}
    assert said == {1: (1, 20, "applied"), 2: (1, None, "no_time"), 3: (1, None, "no_time"), 4: (-1, None, "no_frame"), 5: (1, None, "late"), 6: (1, 99, "applied")}
    with pytest.raises(ValueError):
        results.apply_results_stream(rows, wait=-1)


def test_many_short_sessions_share_their_state(spark, tmp_path):
    frames = spark.range(3_000).selectExpr("id div 2 as session_id", "id % 2 as frame_index", "id as sequence", "cast(id % 2 as double) as loop_started_at")
    found = spark.range(1_500).selectExpr("id as session_id", "id as request_id", "0.25 + id % 2 as completed_at")
    rows = results.result_rows(found, frames)
    got, run = _drain(spark, tmp_path, [rows, _end(spark, rows.schema, 1e5)], buckets=3)
    want = apply_detector_results(found, frames).collect()
    assert sorted((x["session_id"], x["request_id"], x["applied_sequence"] or -1) for x in got) == sorted((x["session_id"], x["request_id"], x["applied_sequence"] or -1) for x in want)
    most = max(s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"])
    assert 0 < most < 100  # not one for each of 4,500 rows
    with pytest.raises(ValueError):
        results.apply_results_stream(rows, buckets=0)
