"""Schemas, constants and checked parameters."""

from __future__ import annotations

from dataclasses import dataclass

# The 17 keypoints of the COCO person layout, and the pairs that make its skeleton.
JOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
BONES = (
    (0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16),
)
SIDES = ("left", "right", "top", "bottom")

POINTS = "array<struct<x:float,y:float>>"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
CROP = "struct<x1:int,y1:int,x2:int,y2:int>"
FRAMES = "session_id bigint, frame_index bigint, sequence bigint, captured_at double, decode_seconds double, frame_width int, frame_height int"
DETECTIONS = "session_id bigint, frame_index bigint, det_index bigint, x1 float, y1 float, x2 float, y2 float, score float, label bigint, frame_width int, frame_height int"
POSES = f"session_id bigint, frame_index bigint, instance_index bigint, keypoints {POINTS}, scores array<float>, bbox {BOX}"
DETECTOR_PREDICTION = "struct<bboxes:array<array<float>>,scores:array<float>,labels:array<bigint>>"
POSE_PREDICTION = "array<array<struct<keypoints:array<array<float>>,keypoint_scores:array<float>,bbox:array<array<double>>,bboxes:array<array<double>>>>>"


def _within(name: str, value: float, low: float, high: float, open_high: bool = False) -> None:
    if value < low or not (value < high if open_high else value <= high):
        raise ValueError(f"{name} must be between {low} and {high}")


MODES = ("hybrid", "whole_image", "detector")  # detections now and then, none, on every inferred frame
#: the fields of TrackConfig as columns of a table of sessions
CONFIG = {
    "mode": "string", "infer_every": "bigint", "detector_interval": "bigint", "detector_interval_seconds": "double", "async_detector": "boolean", "crop_margin": "double", "tracking_alpha": "double",
    "tracking_min_keypoints": "bigint", "redetect_edge": "double", "score_threshold": "double", "detector_score_threshold": "double", "metrics_warmup_seconds": "double", "status_interval": "double",
}


@dataclass(frozen=True)
class TrackConfig:
    """Parameters of a tracked session; ValueError for values outside their range.

    ``metrics_warmup_seconds`` and ``status_interval`` are for the reports: ``sessions`` tables carry them as
    warmup_seconds and status_interval.
    """

    mode: str = "hybrid"
    infer_every: int = 1
    detector_interval: int | None = 30
    detector_interval_seconds: float | None = None
    async_detector: bool = False
    crop_margin: float = 0.2
    tracking_alpha: float = 0.35
    tracking_min_keypoints: int = 8
    redetect_edge: float = 0.06
    score_threshold: float = 0.3
    detector_score_threshold: float = 0.3
    metrics_warmup_seconds: float = 3.0
    status_interval: float = 2.0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.infer_every < 1:
            raise ValueError("infer_every must be at least 1")
        if (self.detector_interval is None) == (self.detector_interval_seconds is None):
            raise ValueError("exactly one of detector_interval and detector_interval_seconds is needed")
        if self.detector_interval is not None and self.detector_interval < 1:
            raise ValueError("detector_interval must be at least 1")
        if self.detector_interval_seconds is not None and self.detector_interval_seconds <= 0:
            raise ValueError("detector_interval_seconds must be positive")
        _within("crop_margin", self.crop_margin, 0, float("inf"))
        _within("tracking_alpha", self.tracking_alpha, 0, 1)
        _within("tracking_min_keypoints", self.tracking_min_keypoints, 1, float("inf"))
        _within("redetect_edge", self.redetect_edge, 0, 0.5, open_high=True)
        _within("score_threshold", self.score_threshold, 0, 1)
        _within("detector_score_threshold", self.detector_score_threshold, 0, 1)
        _within("metrics_warmup_seconds", self.metrics_warmup_seconds, 0, float("inf"))
        if self.status_interval <= 0:
            raise ValueError("status_interval must be positive")
