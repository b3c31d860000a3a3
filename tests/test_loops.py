"""Operators against plain loops over random sessions."""

import math
import random

import numpy as np

from athletrack.operators import timeline, tracking
from athletrack.schemas import DETECTIONS, POSES, TrackConfig
from athletrack.streaming import streams

W, H = 1280, 720


def _clip(x1, y1, x2, y2, m):
    w, h = max(x2 - x1, 1.0), max(y2 - y1, 1.0)
    c = [max(0, math.floor(x1 - w * m)), max(0, math.floor(y1 - h * m)), min(W, math.ceil(x2 + w * m)), min(H, math.ceil(y2 + h * m))]
    return c if c[2] > c[0] and c[3] > c[1] else None


def replay(frames, boxes, people, c):
    """The survey's order of steps, one frame after the other. Coordinates are whole numbers, so types don't matter."""
    crop, pending, last_f, last_t, out_for, out = None, None, -(c.detector_interval or 0), -math.inf, None, []
    for f, t, secs in frames:
        before = crop
        if out_for and out_for[0] <= t:
            if out_for[1]:
                crop, pending = out_for[1], None
            elif crop is None:
                pending = "missing_crop"
            out_for = None
        if f % c.infer_every:
            out.append((f, None, False, before, crop, None, "reuse"))
            continue
        due = t - last_t >= c.detector_interval_seconds if c.detector_interval_seconds else f - last_f >= c.detector_interval
        reason = "missing_crop" if crop is None else pending or ("scheduled_interval" if due else None)
        sent, stage = False, "reuse"
        if reason:
            box = boxes.get(f)
            found = _clip(*box, c.crop_margin) if box else None
            if not c.async_detector:
                sent, stage = True, "detector"
                if found:
                    crop, pending = found, None
            elif out_for is None:
                sent, out_for = True, (t + secs, found)
            if sent:
                last_f, last_t = f, t
        if crop is None:
            pending = "missing_crop"
            out.append((f, reason, sent, before, None, pending, stage))
            continue
        stage = "detector" if stage == "detector" else "pose"
        pts = people.get(f)
        if pts is None:
            pending = "missing_pose"
        else:
            seen = [(x, y) for x, y, s in pts if s]
            if len(seen) >= 4:
                xs, ys = [p[0] for p in seen], [p[1] for p in seen]
                t_ = _clip(min(xs), min(ys), max(xs), max(ys), c.crop_margin)
                if t_:
                    new = []
                    for k in (0, 1):
                        cw, tw = crop[k + 2] - crop[k], t_[k + 2] - t_[k]
                        tw = min(max(tw, cw * 0.85), cw * 1.2)
                        size = (1 - c.tracking_alpha) * cw + c.tracking_alpha * tw
                        mid = (1 - c.tracking_alpha) * ((crop[k] + crop[k + 2]) / 2) + c.tracking_alpha * ((t_[k] + t_[k + 2]) / 2)
                        new.append((mid - size / 2, mid + size / 2))
                    crop = _clip(new[0][0], new[1][0], new[0][1], new[1][1], 0.0) or crop
            if len(seen) < c.tracking_min_keypoints:
                pending = "low_keypoints"
            else:
                ex, ey = (crop[2] - crop[0]) * c.redetect_edge, (crop[3] - crop[1]) * c.redetect_edge
                hit = any(x <= crop[0] + ex and crop[0] > 0 or x >= crop[2] - ex and crop[2] < W or y <= crop[1] + ey and crop[1] > 0 or y >= crop[3] - ey and crop[3] < H for x, y in seen)
                pending = "crop_edge" if hit else None
        out.append((f, reason, sent, before, crop, pending, stage))
    return out


def _sessions(seed, n):
    rng = random.Random(seed)
    frames, detections, poses, plain = [], [], [], {}
    for s in range(n):
        x, y, fps, t = rng.randrange(100, 1100), rng.randrange(100, 600), rng.choice((25, 30, 60)), 0.0
        rows, boxes, people = [], {}, {}
        for f in range(rng.choice((1, 5, 40, 120))):
            x, y = x + rng.randrange(-25, 26), y + rng.randrange(-15, 16)
            t += (1 + rng.random()) / fps
            secs = rng.uniform(0.02, 0.4)
            rows.append((f, t, secs))
            frames.append((s, f, f, t, secs, W, H))
            if rng.random() < 0.85:
                boxes[f] = (float(x - 60), float(y - 100), float(x + 60), float(y + 100))
                detections.append((s, f, 0, *boxes[f], 0.9, 0, W, H))
            if rng.random() < 0.9:
                many = rng.random() < 0.8
                pts = [(float(x + rng.randrange(-70, 71)), float(y + rng.randrange(-110, 111)), many or rng.random() < 0.4) for _ in range(17)]
                people[f] = pts
                poses.append((s, f, 0, [p[:2] for p in pts], [0.9 if p[2] else 0.25 for p in pts], None))
        plain[s] = rows, boxes, people
    return frames, detections, poses, plain


CONFIGS = [
    TrackConfig(detector_interval=10),
    TrackConfig(detector_interval=None, detector_interval_seconds=0.5, async_detector=True, infer_every=2),
    TrackConfig(detector_interval=15, async_detector=True, infer_every=3, tracking_alpha=1.0, crop_margin=0.0),
    TrackConfig(detector_interval=20, tracking_alpha=0.0, tracking_min_keypoints=18, crop_margin=0.35),
]
FRAMES = "session_id bigint, frame_index bigint, sequence bigint, loop_started_at double, detector_seconds double, frame_width int, frame_height int"


def _tables(spark, seed, n):
    frames, detections, poses, plain = _sessions(seed, n)
    return spark.createDataFrame(frames, FRAMES), spark.createDataFrame(detections, DETECTIONS), spark.createDataFrame(poses, POSES), plain


def _got(rows):
    out = {}
    crop = lambda c: None if c is None else list(c)
    for r in rows:
        out.setdefault(r["session_id"], []).append((r["frame_index"], r["detection_reason"], r["submitted"], crop(r["crop_before"]), crop(r["crop_after"]), r["assess_reason"], r["frame_stage"]))
    return {s: sorted(v, key=lambda x: x[0]) for s, v in out.items()}


def test_track_sessions(spark):
    for k, config in enumerate(CONFIGS):
        f, d, p, plain = _tables(spark, k, 12)
        got = _got(tracking.track_sessions(f, d, p, config).collect())
        for s, (rows, boxes, people) in plain.items():
            assert got[s] == replay(rows, boxes, people, config), (k, s)


def test_each_session_has_its_configuration(spark):
    f, d, p, plain = _tables(spark, 11, 12)
    fields = ("detector_interval", "detector_interval_seconds", "async_detector", "infer_every", "tracking_alpha", "crop_margin", "tracking_min_keypoints")
    own = {s: CONFIGS[s % 4] for s in plain if s < 10}  # the others are not in the table
    sessions = spark.createDataFrame([(s, *(getattr(c, k) for k in fields)) for s, c in own.items()], "session_id bigint, detector_interval bigint, detector_interval_seconds double, async_detector boolean, infer_every bigint, tracking_alpha double, crop_margin double, tracking_min_keypoints bigint")
    default = TrackConfig(detector_interval=7)
    got = _got(tracking.track_sessions(f, d, p, default, sessions).collect())
    for s, (rows, boxes, people) in plain.items():
        assert got[s] == replay(rows, boxes, people, own.get(s, default)), s


def test_thresholds_of_a_session(spark):
    frames = spark.createDataFrame([(s, 0, 0, 0.0, 0.1, W, H) for s in (1, 2, 3)], FRAMES)
    boxes = spark.createDataFrame([(s, 0, 0, 100.0, 100.0, 200.0, 300.0, 0.5, 0, W, H) for s in (1, 2, 3)], DETECTIONS)
    sessions = spark.createDataFrame([(1, 0.6), (2, 0.5), (3, None)], "session_id bigint, detector_score_threshold double")
    rows = tracking.track_sessions(frames, boxes, spark.createDataFrame([], POSES), TrackConfig(), sessions).collect()
    assert {r["session_id"]: r["crop_after"] is not None for r in rows} == {1: False, 2: True, 3: True}


def test_failed_detections_end_a_session(spark):
    frames = spark.createDataFrame([(s, k, k, k / 10, 0.25, W, H, "broken" if k == 3 else None) for s in (1, 2) for k in range(8)], FRAMES + ", detector_error string")
    boxes = spark.createDataFrame([(1, 0, 0, 100.0, 100.0, 200.0, 300.0, 0.5, 0, W, H)], DETECTIONS)
    none = spark.createDataFrame([], POSES)
    for config, last in ((TrackConfig(detector_interval=3), 3), (TrackConfig(detector_interval=3, async_detector=True), 6)):
        rows = sorted(tracking.track_sessions(frames, boxes, none, config).collect(), key=lambda r: (r["session_id"], r["frame_index"]))
        mine = [r for r in rows if r["session_id"] == 1]
        assert mine[-1]["frame_stage"] == "failed" and mine[-1]["error"] == "broken" and mine[-1]["frame_index"] == last, config
        assert all(r["error"] is None and r["frame_stage"] != "failed" for r in mine[:-1])


def test_modes_without_a_crop(spark):
    frames = spark.createDataFrame([(1, k, k, k / 10, 0.1, W, H) for k in range(4)], FRAMES)
    at = lambda x, y: [(x - 10.0, y - 10.0), (x + 10.0, y + 10.0)]
    poses = spark.createDataFrame([(1, 0, 0, at(100, 100), [0.9, 0.9], None), (1, 0, 1, at(640, 360), [0.9, 0.9], None), (1, 2, 5, at(5, 5), [0.9, 0.9], None)], POSES)
    for mode, stage in (("whole_image", "pose"), ("detector", "detector")):
        rows = tracking.track_sessions(frames, spark.createDataFrame([], DETECTIONS), poses, TrackConfig(mode=mode, infer_every=2)).collect()
        got = {r["frame_index"]: (r["frame_stage"], r["instance_index"], r["submitted"]) for r in rows}
        assert got == {0: (stage, 1, mode == "detector"), 1: ("reuse", None, False), 2: (stage, 5, mode == "detector"), 3: ("reuse", None, False)}
        assert all(r["crop_after"] is None and r["detection_reason"] is None for r in rows)


def test_one_exchange_by_session(spark):
    f, d, p, _ = _tables(spark, 1, 3)
    plan = tracking.track_sessions(f, d, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_single_flight(spark):
    rng = random.Random(12)
    requests, frames, expected = [], [], {}
    for s in range(40):
        polls = sorted(round(rng.random() * 10, 1) for _ in range(rng.randrange(0, 40)))
        asked = sorted((round(rng.random() * 10, 1), i, rng.choice((0.0, 0.1, 1.5))) for i in range(rng.randrange(1, 25)))
        frames += [(s, k, t) for k, t in enumerate(polls)]
        free = -1.0
        for t, i, secs in asked:
            requests.append((s, 100 * s + i, t, secs))
            taken = next((q for q in polls if q >= t + secs), None) if t >= free else None
            expected[s, 100 * s + i] = (t >= free, taken)
            if t >= free:
                free = math.inf if taken is None else taken
    r = spark.createDataFrame(requests, "session_id bigint, request_id bigint, requested_at double, inference_seconds double")
    f = spark.createDataFrame(frames, "session_id bigint, frame_index bigint, loop_started_at double")
    got = {(x["session_id"], x["request_id"]): (x["accepted"], x["consumed_at"]) for x in tracking.single_flight(r, f).collect()}
    # a result that takes no time may be taken by a poll at the same moment, and the next request of that moment is then admitted
    assert got == expected


def test_status_ticks(spark):
    rng = random.Random(13)
    rows, expected = [], []
    for s in range(30):
        t, last, seen, posed, gone, ages, times = 0.0, 0.0, 0, 0, 0, [], []
        every = rng.choice((0.5, 2.0))
        for k in range(rng.randrange(1, 200)):
            t += rng.uniform(-0.02, 0.2)
            has, stage, dropped, pose, seq = rng.random() < 0.8, rng.choice(("pose", "reuse")), rng.randrange(3), rng.choice((None, 0.01, 0.03)), 2 * k
            rows.append((s, k, t, has, stage, k / 100, pose, seq, seq + k % 3, dropped))
            posed += has and stage != "reuse"
            gone += dropped
            ages.append(k / 100)
            times += [pose] if pose is not None else []
            if t - last >= every:
                captured = seq + k % 3 + 1
                skipped = max(gone, captured - k - 1)
                recent = times[-60:]
                expected.append((s, k, posed - seen, k + 1, captured, skipped, k % 3, round((posed - seen) / (t - last), 6), round(float(np.percentile(ages[-120:], 95)), 6), round(sum(recent) / len(recent), 6) if recent else None))
                last, seen = t, posed
    log = spark.createDataFrame(rows, "session_id bigint, frame_index bigint, completed_at double, has_player boolean, frame_stage string, frame_age double, pose_seconds double, sequence bigint, latest_sequence bigint, dropped bigint")
    rng = random.Random(13)
    sessions = []
    for s in range(30):  # the same choices again, for the intervals
        every = rng.choice((0.5, 2.0))
        for k in range(rng.randrange(1, 200)):
            rng.uniform(-0.02, 0.2), rng.random(), rng.choice("ab"), rng.randrange(3), rng.choice("abc")
        sessions.append((s, 0.0, every))
    table = spark.createDataFrame(sessions, "session_id bigint, started_at double, status_interval double")
    got = tracking.status_ticks(log, table).orderBy("session_id", "frame_index").collect()
    near = lambda x: None if x is None else round(x, 6)
    assert [(r["session_id"], r["frame_index"], r["poses"], r["processed"], r["captured"], r["skipped"], r["lag"], near(r["pose_fps"]), near(r["age_p95"]), near(r["pose_mean"])) for r in got] == expected


def test_sessions_across_batches(spark):
    """Folded sessions don't depend on how Arrow cuts them."""
    f, d, p, _ = _tables(spark, 3, 12)
    whole = _got(tracking.track_sessions(f, d, p, CONFIGS[1]).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _got(tracking.track_sessions(f, d, p, CONFIGS[1]).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_late_frames_are_shown(spark, tmp_path):
    f, d, p, _ = _tables(spark, 8, 2)
    rows = tracking.fold_rows(f, d, p, CONFIGS[0]).where("session_id = 0").cache()
    for cut in ("frame_index >= 2", "frame_index < 2"):
        rows.where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.track_stream(stream, CONFIGS[0], idle=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    stages = {r["frame_index"]: r["frame_stage"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(stages) == rows.where("loop_started_at is not null").count() and (max(stages) < 2 or {k for k, v in stages.items() if v == "late"} == {0, 1})


def test_sessions_end_on_a_stream(spark, tmp_path):
    """Append mode: a session's figures come once, after its gap and the watermark have passed."""
    schema = "session_id bigint, captured_ts timestamp, frame_age double, frame_stage string, has_player boolean, sequence bigint, latest_sequence bigint"
    stamp = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    for batch in ([(1, s, 0.1, "detector" if s == 0 else "pose", True, s, s) for s in range(5)], [(1, 6, 0.3, "reuse", True, 7, 9), (2, 50, 0.2, "pose", True, 0, 0)], [(2, 200, 0.2, "pose", True, 1, 1)], [(3, 400, 0.2, "pose", True, 0, 0)]):
        df = spark.createDataFrame([(r[0], stamp(r[1]), *r[2:]) for r in batch], schema.replace("timestamp", "string"))
        df.selectExpr("session_id", "cast(captured_ts as timestamp) captured_ts", *(c.split()[0] for c in schema.split(", ")[2:])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.stream_session_summary(stream, "30 seconds", "10 seconds")
    out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r["session_id"], r["processed"], r["captured"], r["skipped"], r["inferred"], r["refreshes"], r["max_lag"], r["max_age"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(1, 6, 10, 4, 5, 1, 2, 0.3), (2, 1, 1, 0, 1, 0, 0, 0.2), (2, 1, 2, 1, 1, 0, 0, 0.2)]


def test_stream_in_pieces_is_the_batch(spark, tmp_path):
    f, d, p, _ = _tables(spark, 7, 6)
    config = CONFIGS[1]
    rows = tracking.fold_rows(f, d, p, config).cache()
    for i in range(4):  # as four files, one micro-batch each
        rows.where(f"frame_index >= {30 * i} and frame_index < {30 * (i + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.track_stream(stream, config, idle=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert _got(spark.read.parquet(str(tmp_path / "out")).collect()) == _got(tracking.track_sessions(f, d, p, config).collect())


def test_latest_only_stream_ignores_stale_frames(spark, tmp_path):
    for batch in ([(1, 0), (1, 3), (2, 1)], [(1, 2), (2, 4)], [(1, 7), (2, 4)]):
        spark.createDataFrame([(s, q, q / 10) for s, q in batch], "session_id bigint, sequence bigint, captured_at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id bigint, sequence bigint, captured_at double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.latest_only_stream(stream, idle=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = sorted((r["session_id"], r["sequence"], r["dropped"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(1, 3, 3), (1, 7, 3), (2, 1, 1), (2, 4, 2)]


def test_latest_frame_feed(spark):
    rng = random.Random(5)
    frames, polls, expected = [], [], []
    for s in range(40):
        captured = sorted(rng.random() * 10 for _ in range(rng.randrange(1, 20)))
        asked = sorted(rng.random() * 11 for _ in range(rng.randrange(1, 15)))
        frames += [(s, k, t) for k, t in enumerate(captured)]
        polls += [(s, t) for t in asked]
        last = -1
        for i, t in enumerate(asked):
            newest = sum(x <= t for x in captured) - 1
            take = newest if newest > last else last + 1
            if take >= len(captured):
                break
            expected.append((s, i, take, take - last - 1))
            last = take
    f = spark.createDataFrame(frames, "session_id bigint, sequence bigint, captured_at double")
    p = spark.createDataFrame(polls, "session_id bigint, polled_at double")
    assert sorted((r["session_id"], r["poll_index"], r["sequence"], r["dropped"]) for r in timeline.latest_frame_feed(p, f).collect()) == expected


def test_paced_capture_times(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for s in range(30):
        at = 0.0
        for n in range(rng.randrange(1, 30)):
            d = rng.random() * 0.2
            rows.append((s, n, d))
            at += d
            at = max(at, n / 10)
            expected[s, n] = at
    df = spark.createDataFrame(rows, "session_id bigint, frame_index bigint, decode_seconds double")
    for r in timeline.paced_capture_times(df, 10.0).collect():
        assert abs(r["released_at"] - expected[r["session_id"], r["frame_index"]]) < 1e-9


def test_a_long_session_flows_through_its_fold(spark):
    rows = spark.range(2_000).selectExpr("id % 2 as session_id", "id div 2 as frame_index")

    def fold(parts):
        taken = 0
        for part in parts:
            taken += 1
            yield from ((s, f, len(part["frame_index"]), taken) for s, f in zip(part["session_id"], part["frame_index"]))

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = tracking.flowing(rows, ["frame_index"], fold, "session_id bigint, frame_index bigint, held bigint, taken bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["session_id"], r["frame_index"]) for r in got) == [(s, f) for s in (0, 1) for f in range(1_000)]
    assert max(r["held"] for r in got) <= 100 and max(r["taken"] for r in got) >= 10
