"""Long sessions folded in pieces against the fold of whole sessions."""

import random

import pyarrow as pa
import pytest
from test_loops import CONFIGS, FRAMES, H, W, _tables

from athletrack.operators import long_sessions, tracking
from athletrack.schemas import DETECTIONS, POSES, TrackConfig


def _rows(df):
    return sorted(map(str, df.collect()))


def _calm(spark, n, fail_at=None):
    """One person who walks, seen in nearly every frame."""
    rng = random.Random(n)
    frames, boxes, poses = [], [], []
    for k in range(n):
        x, y = 300 + k % 600, 360 + rng.randrange(-3, 4)
        frames.append((1, k, k, k / 30, 0.05, W, H, "broken" if k == fail_at else None))
        if rng.random() < 0.95:
            boxes.append((1, k, 0, x - 60.0, y - 120.0, x + 60.0, y + 120.0, 0.9, 0, W, H))
        if rng.random() < 0.999:
            poses.append((1, k, 0, [(float(x + rng.randrange(-50, 51)), float(y + rng.randrange(-100, 101))) for _ in range(17)], [0.9] * 17, None))
    return spark.createDataFrame(frames, FRAMES + ", detector_error string"), spark.createDataFrame(boxes, DETECTIONS), spark.createDataFrame(poses, POSES)


@pytest.mark.parametrize("config", CONFIGS)
def test_pieces_give_the_rows_of_the_whole(spark, config):
    f, d, p, _ = _tables(spark, 5, 12)
    fold = long_sessions.track_long_sessions(f, d, p, config, piece=16)
    assert _rows(fold.tracks) == _rows(tracking.track_sessions(f, d, p, config))
    report = {r["session_id"]: r for r in fold.report().collect()}
    assert sum(r["frames"] for r in report.values()) == f.count()
    assert all(r["refolded"] == 0 for r in report.values() if r["pieces"] == 1)


@pytest.mark.parametrize("config", [TrackConfig(), TrackConfig(async_detector=True, infer_every=2), TrackConfig(detector_interval=None, detector_interval_seconds=1.0)])
def test_a_calm_session_is_hardly_folded_again(spark, config):
    tables = _calm(spark, 8_000)
    fold = long_sessions.track_long_sessions(*tables, config, piece=1_000)
    assert _rows(fold.tracks) == _rows(tracking.track_sessions(*tables, config))
    report = fold.report().first()
    assert report["pieces"] == 8 and report["frames"] == 8_000
    assert report["refolded"] < report["frames"] / 2 and report["rounds"] <= 3, report


def test_a_failure_ends_all_later_pieces(spark):
    for config in (TrackConfig(detector_interval=10), TrackConfig(detector_interval=10, async_detector=True)):
        tables = _calm(spark, 200, fail_at=60)
        fold = long_sessions.track_long_sessions(*tables, config, piece=20)
        got = fold.tracks.orderBy("frame_index").collect()
        assert list(map(str, got)) == sorted(map(str, tracking.track_sessions(*tables, config).collect()), key=lambda r: int(r.split("frame_index=")[1].split(",")[0]))


def test_empty_tables_and_gaps(spark):
    none = [spark.createDataFrame([], s) for s in (FRAMES, DETECTIONS, POSES)]
    assert long_sessions.track_long_sessions(*none).tracks.count() == 0
    frames = spark.createDataFrame([(1, k, k, k / 30, 0.0, W, H) for k in (3, 4, 900, 901, 5_000)], FRAMES)
    boxes = spark.createDataFrame([(1, k, 0, 100.0, 100.0, 200.0, 300.0, 0.9, 0, W, H) for k in (3, 700, 901)], DETECTIONS)
    got = long_sessions.track_long_sessions(frames, boxes, none[2], piece=10)
    assert _rows(got.tracks) == _rows(tracking.track_sessions(frames, boxes, none[2]))
    with pytest.raises(ValueError):
        long_sessions.track_long_sessions(*none, piece=0)


def test_sessions_have_their_configuration(spark):
    f, d, p, plain = _tables(spark, 11, 12)
    sessions = spark.createDataFrame([(s, 5 + s, s % 2 == 0, ("hybrid", "hybrid", "whole_image", "detector")[s % 4]) for s in list(plain)[:10]], "session_id bigint, detector_interval bigint, async_detector boolean, mode string")
    fold = long_sessions.track_long_sessions(f, d, p, TrackConfig(detector_interval=7), sessions, piece=13)
    assert _rows(fold.tracks) == _rows(tracking.track_sessions(f, d, p, TrackConfig(detector_interval=7), sessions))


def test_a_hand_over_reads_the_first_frames_only(spark, monkeypatch):
    config, read = TrackConfig(detector_interval=10, infer_every=2), []

    def counted(df, *args, made=long_sessions.folded):
        read.append(df.count())
        return made(df, *args)

    monkeypatch.setattr(long_sessions, "folded", counted)
    tables = _calm(spark, 4_000)
    fold = long_sessions.track_long_sessions(*tables, config, piece=400)
    assert _rows(fold.tracks) == _rows(tracking.track_sessions(*tables, config))
    assert read[0] < 4_000 * 2.2 and read[1] < read[0] / 4, read  # boxes and poses of every second frame; an eighth of a piece


def test_a_pose_without_keypoints_is_nobody(spark):
    frames = spark.createDataFrame([(1, k, k, k / 30, 0.0, W, H) for k in range(4)], FRAMES)
    boxes = spark.createDataFrame([(1, k, 0, 100.0, 100.0, 200.0, 300.0, 0.9, 0, W, H) for k in range(4)], DETECTIONS)
    there = ([(100.0 + 5 * i, 120.0 + 8 * i) for i in range(17)], [0.9] * 17)
    poses = spark.createDataFrame([(1, k, i, *p, box) for k in range(4) for i, p, box in ((0, ([], []), (0.0, 0.0, 500.0, 500.0)), (1, there, None), (2, ([], [0.9]), (0.0, 0.0, 500.0, 500.0)))], POSES)
    config = TrackConfig(infer_every=2)
    got = [r["instance_index"] for r in tracking.track_sessions(frames, boxes, poses, config).orderBy("frame_index").collect()]
    assert got == [1, None, 1, None]
    assert got == [r["instance_index"] for r in long_sessions.track_long_sessions(frames, boxes, poses, config, piece=2).tracks.orderBy("frame_index").collect()]
    assert tracking.fold_rows(frames, boxes, poses, config, inferred=True).where("person is not null").count() == 2


def test_lists_of_numbers_as_arrow_gives_them():
    for values, kind in (
        ([1, None, 3], pa.int64()), ([None, None], pa.float64()), ([], pa.int32()), ([1.5, -0.0, None], pa.float64()), ([True, None], pa.bool_()), (["a", None], pa.string()),
        ([[1, 2], None, [], [None, 4]], pa.list_(pa.int32())), ([None, [0.5]], pa.list_(pa.float64())), ([[[1], []], None, [None]], pa.list_(pa.list_(pa.int64()))),
    ):
        for column in (pa.array(values, kind), pa.array([*values, *values], kind).slice(1, len(values))):
            got = tracking.listed(column)
            assert got == column.to_pylist() and list(map(type, got)) == list(map(type, column.to_pylist()))
    assert str(tracking.listed(pa.array([float("nan"), None]))) == "[nan, None]"
