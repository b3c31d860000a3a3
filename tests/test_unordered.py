"""The tracker on a feed in any order, and null times and durations in the folds."""

import random

import pytest
from pyspark.sql import functions as F
from test_loops import CONFIGS, FRAMES, H, W, _tables

from athletrack.operators import tracking
from athletrack.schemas import DETECTIONS, POSES, TrackConfig
from athletrack.sources import io
from athletrack.streaming import waiting

TIMED = "frame_index / 30"


def _drain(spark, tmp_path, batches, config, **options):
    """Micro-batches, one after the other, through the stream."""
    path = str(tmp_path / "in")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = waiting.track_unordered(stream, config, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")), run.lastProgress


def _closing(spark, schema, seconds):
    plain = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "event_ts"]
    return spark.range(1).select(*plain, F.timestamp_seconds(F.lit(seconds)).alias("event_ts")).select(*(f.name for f in schema))


@pytest.mark.parametrize("k", [0, 1])
def test_any_order_gives_the_batch_tracks(spark, tmp_path, k):
    f, d, p, _ = _tables(spark, 20 + k, 6)
    rows = tracking.fold_rows(f, d, p, CONFIGS[k]).withColumn("event_ts", F.timestamp_seconds(F.expr(TIMED)))
    table = rows.collect()
    rng = random.Random(k)
    dealt = [[] for _ in range(4)]
    for row in table:
        rng.choice(dealt).append(row)
    batches = [spark.createDataFrame(part, rows.schema) for part in dealt] + [_closing(spark, rows.schema, 1e6)]
    out, progress = _drain(spark, tmp_path, batches, CONFIGS[k], delay="1 hour", idle=60_000)
    assert sorted(map(str, out.collect())) == sorted(map(str, tracking.track_sessions(f, d, p, CONFIGS[k]).collect()))


def test_what_misses_the_watermark_says_so(spark, tmp_path):
    f = spark.createDataFrame([(1, k, k, k / 30, 0.0, W, H) for k in (0, 1, 2, 300, 301)], FRAMES)
    d = spark.createDataFrame([(1, k, 0, 100.0, 100.0, 200.0, 300.0, 0.9, 0, W, H) for k in (0, 1, 150)], DETECTIONS)
    p = spark.createDataFrame([(1, 2, 0, [(float(x), 200.0) for x in range(17)], [0.9] * 17, None)], POSES)
    config = TrackConfig()
    rows = tracking.fold_rows(f, d, p, config).withColumn("event_ts", F.timestamp_seconds(F.expr(TIMED)))
    late = F.col("frame_index").isin(1, 2) & (F.col("rank").isNotNull() | F.col("person").isNotNull()) | (F.col("frame_index") == 0) & F.col("loop_started_at").isNotNull()
    late = late & ~((F.col("frame_index") == 0) & F.col("rank").isNotNull())
    batches = [rows.where(~late), _closing(spark, rows.schema, 1000), rows.where(late), _closing(spark, rows.schema, 2000)]
    out, _ = _drain(spark, tmp_path, batches, config, delay="1 second", idle=None)
    got = sorted((r["frame_index"], r["frame_stage"]) for r in out.collect())
    said = [g for g in got if g[1] in ("late", "late_box", "late_pose", "no_frame")]
    assert said == [(0, "late"), (0, "no_frame"), (1, "late_box"), (2, "late_pose"), (150, "no_frame")]
    assert [g[0] for g in got if g not in said] == [1, 2, 300, 301]


# --- nulls in the folds


def test_a_request_without_a_duration_stays_outstanding(spark):
    requests = spark.createDataFrame([(1, 1, 0.0, 0.1), (1, 2, 1.0, None), (1, 3, 2.0, 0.1), (1, 4, None, 0.1), (2, 5, 0.0, float("nan")), (2, 6, 3.0, 0.1), (3, 7, 0.0, 0.2)], "session_id long, request_id long, requested_at double, inference_seconds double")
    frames = spark.createDataFrame([(s, k / 2) for s in (1, 2) for k in range(9)] + [(3, None), (3, 0.3)], "session_id long, loop_started_at double")
    got = {r["request_id"]: (r["requested_at"], r["accepted"], r["consumed_at"]) for r in tracking.single_flight(requests, frames).collect()}
    assert got == {1: (0.0, True, 0.5), 2: (1.0, True, None), 3: (2.0, False, None), 4: (None, False, None), 5: (0.0, True, None), 6: (3.0, False, None), 7: (0.0, True, 0.3)}


def test_a_frame_without_an_end_never_ticks(spark):
    times = [None, 1.0, None, 2.5, float("nan"), 5.0, None]
    log = spark.createDataFrame([(s, k, t, True, "pose") for s in (1, 2) for k, t in enumerate(times)] + [(3, 0, None, True, "pose")], "session_id long, frame_index long, completed_at double, has_player boolean, frame_stage string")
    sessions = spark.createDataFrame([(1, 0.0), (2, None), (3, 0.0)], "session_id long, started_at double")
    got = sorted((r["session_id"], r["frame_index"], r["tick_at"], r["poses"], r["processed"]) for r in tracking.status_ticks(log, sessions, 2.0).collect())
    assert got == [(1, 3, 2.5, 4, 4), (1, 5, 5.0, 2, 6)]


def test_a_frame_without_a_time_is_not_due(spark):
    rows = spark.createDataFrame([(1, 0, None, True, None, True), (1, 1, 1.0, True, None, True), (1, 2, None, None, None, True), (1, 3, 2.0, True, None, True), (1, 4, None, True, "edge", False), (1, None, 9.0, True, None, True)], "session_id long, frame_index long, checked_at double, has_crop boolean, pending string, accepts boolean")
    by_time = {r["frame_index"]: r["detection_reason"] for r in tracking.detection_schedule(rows, None, 1.0).collect()}
    assert by_time == {None: "scheduled_interval", 0: None, 1: None, 2: "missing_crop", 3: None, 4: "edge"}
    by_frame = {r["frame_index"]: r["detection_reason"] for r in tracking.detection_schedule(rows, 2).collect()}
    assert by_frame == {None: None, 0: "scheduled_interval", 1: None, 2: "missing_crop", 3: None, 4: "edge"}


def test_poses_of_a_stream_are_written_in_buckets(spark, tmp_path):
    _, _, p, _ = _tables(spark, 4, 3)
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        io.write_poses_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert "session_bucket" in back.columns
    assert sorted(map(str, back.select(*p.columns).collect())) == sorted(map(str, p.collect()))


def test_what_waits_is_few_values_of_the_state(spark, tmp_path):
    f = spark.range(3_000).selectExpr("1L as session_id", "id as frame_index", "id as sequence", "id / 30 as loop_started_at", "0D as detector_seconds", f"{W} as frame_width", f"{H} as frame_height")
    d, p = spark.createDataFrame([], DETECTIONS), spark.createDataFrame([], POSES)
    rows = tracking.fold_rows(f, d, p, TrackConfig()).withColumn("event_ts", F.timestamp_seconds(F.expr(TIMED)))
    early = F.col("frame_index") % 2 == 0
    out, progress = _drain(spark, tmp_path, [rows.where(early), rows.where(~early), _closing(spark, rows.schema, 1e6)], TrackConfig(), delay="1 hour", idle=None)
    assert out.count() == 3_000 and out.where("frame_stage like 'late%'").isEmpty()
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) < 10
