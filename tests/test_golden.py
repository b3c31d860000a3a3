"""Hand-computed rows."""

import pytest

from athletrack.operators import geometry, metrics, select, timeline, tracking, windows
from athletrack.sources import io
from athletrack.schemas import DETECTIONS, POSES, TrackConfig

FRAME = (1280, 720)


@pytest.mark.parametrize(
    "box, margin, expected",
    [
        ((100, 100, 200, 300), 0.2, (80, 60, 220, 340)),
        ((-50, 10, 30, 700), 0.35, (0, 0, 58, 720)),
        ((50, 50, 50, 50), 0.2, (49, 49, 51, 51)),
        ((1300, 10, 1350, 90), 0.0, None),
        ((200, 100, 100, 300), 0.2, None),
        ((None, 1, 2, 3), 0.2, None),
    ],
)
def test_crop_around_bbox(spark, box, margin, expected):
    df = spark.createDataFrame([(*[None if v is None else float(v) for v in box], *FRAME)], "x1 float, y1 float, x2 float, y2 float, frame_width int, frame_height int")
    crop = geometry.crop_around_bbox(df, margin).first()["crop"]
    assert (None if crop is None else tuple(crop)) == expected


def _pose(spark, points, scores, crop=(100, 100, 300, 500), bbox=None):
    schema = f"{POSES}, crop struct<x1:int,y1:int,x2:int,y2:int>, frame_width int, frame_height int"
    return spark.createDataFrame([(1, 0, 0, points, scores, bbox, crop, *FRAME)], schema)


def test_update_crop_step(spark):
    corners = [(150.0, 150.0), (250.0, 150.0), (150.0, 450.0), (250.0, 450.0)]
    step = geometry.update_crop_step(_pose(spark, corners, [0.9] * 4), 0.3, 0.0, 0.5).first()["new_crop"]
    assert tuple(step) == (107, 115, 293, 485)
    assert tuple(geometry.update_crop_step(_pose(spark, corners, [0.9] * 3 + [0.1]), 0.3, 0.0, 0.5).first()["new_crop"]) == (100, 100, 300, 500)


def _assess(spark, points, crop, scores=None):
    row = geometry.assess_redetection(_pose(spark, points, scores or [0.9] * len(points or ()), crop), 0.3, 8, 0.06).first()["assessment"]
    return row["reason"], [(h["joint"], h["edge"]) for h in row["edge_hits"]], row["clamped_only_suppressed"]


def test_assess(spark):
    middle = [(500.0, 300.0)] * 8
    assert _assess(spark, middle[:6] + [(1.0, 300.0)], (0, 100, 900, 600)) == ("low_keypoints", [], False)
    left = [(1.0, 300.0)] + middle[:7]
    assert _assess(spark, left, (0, 100, 900, 600)) == (None, [("nose", "left")], True)
    both = [(1.0, 300.0), (899.0, 300.0)] + middle[:6]
    assert _assess(spark, both, (0, 100, 900, 600)) == ("crop_edge", [("nose", "left"), ("left_eye", "right")], False)
    assert _assess(spark, None, (0, 100, 900, 600), [])[0] == "missing_pose"


def test_select_player_bbox(spark):
    rows = [
        (1, 0, 0, 600.0, 300.0, 620.0, 400.0, 0.9, 0, *FRAME), (1, 0, 1, 660.0, 300.0, 680.0, 400.0, 0.9, 0, *FRAME),  # mirrored: the first
        (1, 1, 0, 0.0, 0.0, 900.0, 700.0, 0.9, 1, *FRAME), (1, 1, 1, 600.0, 300.0, 610.0, 310.0, 0.5, 0, *FRAME),  # a big box that is no person
        (1, 2, 0, 200.0, 100.0, 100.0, 300.0, 0.9, 0, *FRAME),  # negative width: rank 0, still there
        (1, 3, 0, 600.0, 300.0, 610.0, 310.0, 0.2, 0, *FRAME),  # nobody
    ]
    got = {r["frame_index"]: (r["det_index"], r["rank"]) for r in select.select_player_bbox(spark.createDataFrame(rows, DETECTIONS)).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 1: 1, 2: 0} and got[2][1] == 0
    frames = spark.createDataFrame([(1, k) for k in range(4)], "session_id bigint, frame_index bigint")
    assert select.select_player_bbox(spark.createDataFrame(rows, DETECTIONS), frames=frames).count() == 4


def test_thresholds_by_type(spark):
    pose = geometry.visible_keypoints(_pose(spark, [(1.0, 1.0)], [0.7]), 0.7).first()
    assert len(pose["visible"]) == 1
    box = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 2.0, 2.0, 0.7, 0, *FRAME)], DETECTIONS)
    assert select.person_filter(box, 0.7).count() == 0


def test_latest_frame_feed(spark):
    frames = spark.createDataFrame([(1, k, float(k)) for k in range(6)], "session_id bigint, sequence bigint, captured_at double")
    polls = spark.createDataFrame([(1, t) for t in (0.5, 2.5, 2.6, 4.2)], "session_id bigint, polled_at double")
    rows = timeline.latest_frame_feed(polls, frames).orderBy("poll_index").collect()
    assert [(r["sequence"], r["dropped"]) for r in rows] == [(0, 0), (2, 1), (3, 0), (4, 0)]


def test_dropped_frames(spark):
    taken = spark.createDataFrame([(1, s) for s in (2, 3, 7)], "session_id bigint, sequence bigint")
    assert [r["dropped"] for r in timeline.dropped_frames(taken).orderBy("sequence").collect()] == [2, 0, 3]


def _observations(spark, sets, clamped=()):
    rows = [(1, k, (None, [(j, e, 0.5) for j, e in hits], list(clamped), False)) for k, hits in enumerate(sets)]
    return spark.createDataFrame(rows, "session_id bigint, frame_index bigint, assessment struct<reason:string,edge_hits:array<struct<joint:string,edge:string,confidence:double>>,clamped_edges:array<string>,clamped_only_suppressed:boolean>")


def test_streaks(spark):
    a, b, c = ("nose", "left"), ("nose", "top"), ("left_eye", "left")
    row = windows.edge_repeat_streaks(_observations(spark, [[a], [a, b], [], [a], [a], [c]])).first()
    assert (row["repeated"], row["max_streak"]) == (2, 2)
    assert metrics.edge_event_counts(_observations(spark, [[a], [a, b], [], [a], [a], [c]])).first()["events"] == 5


def test_clamp_counts(spark):
    a, b = ("nose", "left"), ("nose", "top")
    assert [tuple(r) for r in metrics.edge_clamp_counts(_observations(spark, [[a, b]], ["left"])).collect()] == [(1, "left", 1)]
    assert [tuple(r) for r in metrics.edge_clamp_counts(_observations(spark, [[b]], ["left"])).collect()] == [(1, "not_clamped", 1)]


def test_percentiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)] + [(2, None)], "k int, v double")
    rows = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in metrics.latency_percentiles(df, ["k"], "v").collect()}
    assert rows[1][0] == 4 and rows[1][1] == 2.5 and rows[1][2] == pytest.approx(3.85) and rows[2] == (0, None, None)


def test_status_ticks(spark):
    log = spark.createDataFrame([(1, k, t, True, "pose") for k, t in enumerate((0.5, 1.9, 2.1, 3.9, 4.2, 6.3))], "session_id bigint, frame_index bigint, completed_at double, has_player boolean, frame_stage string")
    sessions = spark.createDataFrame([(1, 0.0)], "session_id bigint, started_at double")
    rows = tracking.status_ticks(log, sessions, 2.0).orderBy("frame_index").collect()
    assert [(r["tick_at"], r["poses"]) for r in rows] == [(2.1, 3), (4.2, 2), (6.3, 1)]


def test_single_flight(spark):
    requests = spark.createDataFrame([(1, k, float(k), 1.5) for k in range(4)], "session_id bigint, request_id bigint, requested_at double, inference_seconds double")
    frames = spark.createDataFrame([(1, float(k)) for k in range(4)], "session_id bigint, loop_started_at double")
    rows = tracking.single_flight(requests, frames).orderBy("request_id").collect()
    assert [(r["accepted"], r["consumed_at"]) for r in rows] == [(True, 2.0), (False, None), (True, None), (False, None)]


def test_paced_capture_times(spark):
    frames = spark.createDataFrame([(1, k, d) for k, d in enumerate((0.1, 1.0, 0.1))], "session_id bigint, frame_index bigint, decode_seconds double")
    rows = timeline.paced_capture_times(frames, 2.0).orderBy("frame_index").collect()
    assert [round(r["released_at"], 9) for r in rows] == [0.1, 1.1, 1.2]


def test_pose_reuse_carries_null(spark):
    frames = spark.createDataFrame([(1, k) for k in range(6)], "session_id bigint, frame_index bigint")
    poses = spark.createDataFrame([(1, 0, "a"), (1, 1, "never")], "session_id bigint, frame_index bigint, pose string")
    rows = timeline.pose_reuse(frames, poses, 3).orderBy("frame_index").collect()
    assert [r["pose"] for r in rows] == ["a", "a", "a", None, None, None]


def test_compare_runs_recomputes_published_gains(spark):
    schema = "video string, fps double, drop_pct double, age_p95 double, max_age double, refreshes bigint"
    before = spark.createDataFrame([("pro", 25.1, 59.4, 139.4, 241.7, None), ("wnn", 25.3, 17.5, 59.2, 282.7, 25), ("gone", 1.0, None, None, None, None)], schema)
    after = spark.createDataFrame([("pro", 31.3, 48.1, 51.3, 75.0, None), ("wnn", 30.0, 1.4, 51.9, 87.7, None)], schema)
    got = {r["video"]: r["gain_pct"] and round(r["gain_pct"], 1) for r in timeline.compare_runs(before, after).collect()}
    assert got == {"pro": 24.7, "wnn": 18.6, "gone": None}


def test_frame_budget(spark):
    means = spark.createDataFrame([(0.204, 0.0172, 0.0126, 0.0015)], "detector_mean double, pose_mean double, display_mean double, decode_mean double")
    row = metrics.frame_budget(means, 30).first()
    assert row["budget_ms"] == pytest.approx(38.1) and 26 < row["expected_fps"] < 27


@pytest.mark.parametrize("bad", [{"infer_every": 0}, {"detector_interval": None}, {"detector_interval_seconds": 1.0}, {"tracking_alpha": -0.1}, {"redetect_edge": 0.5}, {"score_threshold": 1.1}, {"tracking_min_keypoints": 0}, {"mode": "none"}, {"status_interval": 0}, {"metrics_warmup_seconds": -1}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        TrackConfig(**bad)
    assert TrackConfig(tracking_alpha=0).crop_margin == 0.2 and TrackConfig(tracking_min_keypoints=18)


def test_one_frame_session_has_zero_rates(spark):
    log = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, "pose", 0)], "session_id bigint, frame_index bigint, sequence bigint, captured_at double, completed_at double, frame_stage string, dropped bigint")
    sessions = spark.createDataFrame([(1, 0.0, 0.0, 3.0)], "session_id bigint, started_at double, ended_at double, warmup_seconds double")
    row = metrics.session_throughput(log, sessions).first()
    assert (row["capture_fps"], row["processed_fps"], row["skipped"], row["drop_pct"]) == (0.0, 0.0, 0, 0.0)


def test_flatten_detections_stops_at_the_shortest(spark):
    raw = spark.createDataFrame([(1, 0, ([[1.0, 2.0, 3.0, 4.0]] * 3, [0.5, 0.6], [0, 0, 1])), (1, 1, None)], "session_id bigint, frame_index bigint, prediction struct<bboxes:array<array<float>>,scores:array<float>,labels:array<bigint>>")
    assert select.flatten_detections(raw).count() == 2


def test_marker_rounds_half_to_even(spark):
    rows = geometry.joint_markers(_pose(spark, [(0.5, 1.5), (2.5, 3.4)], [0.9, 0.9])).orderBy("kp_index").collect()
    assert [(r["mx"], r["my"]) for r in rows] == [(0, 2), (2, 3)]


def test_lag_of_results_that_were_not_taken(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 5, 8), (2, 0.0, 1.0, 9, 8), (3, 0.0, None, 5, None)], "request_id bigint, requested_at double, consumed_at double, sequence bigint, consumed_sequence bigint")
    assert {r["request_id"]: (r["result_latency"], r["result_lag"]) for r in timeline.detector_latency(rows).collect()} == {1: (1.0, 3), 2: (1.0, 0), 3: (None, None)}


def test_edge_reports_of_both_scopes(spark):
    hit = [("nose", "left", 0.9)]
    assessment = "assessment struct<reason:string,edge_hits:array<struct<joint:string,edge:string,confidence:double>>,clamped_edges:array<string>,clamped_only_suppressed:boolean>"
    rows = [(1, f, float(f), ("crop_edge", hit, [], False)) for f in range(4)]
    log = spark.createDataFrame(rows, f"session_id bigint, frame_index bigint, at double, {assessment}")
    sessions = spark.createDataFrame([(1, 0.0, 2.0)], "session_id bigint, started_at double, warmup_seconds double")
    both = timeline.scoped(log, sessions, "at")
    of = lambda df, *names: {(r["scope"], *(r[n] for n in names)) for r in df.collect()}
    assert of(metrics.edge_event_counts(both), "events") == {("all", 4), ("steady", 2)}
    assert of(metrics.edge_side_counts(metrics.edge_hit_rows(both)), "edge", "n") == {("all", "left", 4), ("steady", "left", 2)}
    assert of(metrics.edge_clamp_counts(both), "side", "n") == {("all", "not_clamped", 4), ("steady", "not_clamped", 2)}
    assert of(windows.edge_repeat_streaks(both), "repeated", "max_streak") == {("all", 3, 4), ("steady", 1, 2)}


def test_frames_of_extracted_images(spark, tmp_path):
    for name in ("7/3.jpg", "7/12.jpg", "8/0.png", "8/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {(r["session_id"], r["frame_index"]): r for r in io.read_frames(spark, str(tmp_path / "*"), "binaryFile").collect()}
    assert {k: r["sequence"] for k, r in got.items()} == {(7, 3): 0, (7, 12): 1, (8, 0): 0}
    assert got[7, 12]["content"] == b"7/12.jpg" and got[8, 0]["captured_at"] > 1e9 and got[8, 0]["decode_seconds"] is None
