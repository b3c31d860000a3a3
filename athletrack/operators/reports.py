"""The whole report of a session, put together from its parts: one row by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.operators import metrics, windows


def _one(part: DataFrame, name: str) -> DataFrame:
    """A part with one row by session, as a struct."""
    return part.select("session_id", F.struct(*(c for c in part.columns if c != "session_id")).alias(name))


def _by(part: DataFrame, key: str, name: str) -> DataFrame:
    """A part with some rows by session, as a map by ``key``: of its one figure, or of a struct of them."""
    figures = [c for c in part.columns if c not in ("session_id", key)]
    value = F.col(figures[0]) if len(figures) == 1 else F.struct(*figures)
    rows = part.where(F.col(key).isNotNull()).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(F.col(key), value.alias("v")))).alias("e"))
    return rows.select("session_id", F.map_from_entries("e").alias(name))


def _edges(assessed: DataFrame) -> list[DataFrame]:
    hits = metrics.edge_hit_rows(assessed)
    return [
        _one(metrics.edge_actionable_split(assessed), "edges"), _by(metrics.edge_side_counts(hits), "edge", "edge_sides"), _by(metrics.edge_joint_counts(hits), "joint", "edge_joints"),
        _by(metrics.edge_landmark_histogram(assessed), "joints", "edge_landmarks"), _by(metrics.edge_clamp_counts(assessed), "side", "edge_clamps"),
        _one(metrics.edge_confidence(hits), "edge_confidence"), _one(windows.edge_repeat_streaks(assessed), "edge_streaks"),
    ]


def session_report(frame_log: DataFrame, sessions: DataFrame, requests: DataFrame | None = None, assessed: DataFrame | None = None, detector_interval: int = 30, exact: bool = True) -> DataFrame:
    """One row for each row of ``sessions``: its throughput, freshness and poses by scope, latency by kind of frame, means of stages and budget;
    with ``requests`` the detector's work and reasons by scope, with ``assessed`` all figures of landmarks at crop edges.

    ``frame_log`` has ``dropped``. A part of which a session has no rows is null, and so are all parts of a session
    without an id. Parts are combined before their shuffles; what is joined has a row for each session.
    """
    parts = [
        _one(metrics.session_throughput(frame_log, sessions), "throughput"), _by(metrics.session_freshness(frame_log, sessions, exact), "scope", "freshness"),
        _by(metrics.frame_class_latency(frame_log, sessions, exact), "frame_stage", "classes"), _by(metrics.pose_output_rate(frame_log, sessions, exact), "scope", "poses"),
        _one(metrics.frame_budget(metrics.stage_means(frame_log), detector_interval), "stages"),
    ]
    if requests is not None:
        parts += [_by(metrics.detector_worker_stats(requests, sessions, exact), "scope", "detectors"), _reasons(requests, sessions), _one(metrics.detector_rate(requests, sessions), "refreshes")]
    if assessed is not None:
        parts += _edges(assessed)
    out = sessions.select("session_id")
    for part in parts:
        out = out.join(part, "session_id", "left")
    return out


def _reasons(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, reasons): counts of a session by scope:reason."""
    counts = metrics.detector_reason_counts(requests, sessions)
    return _by(counts.select("session_id", F.concat_ws(":", "scope", F.coalesce("reason", F.lit(""))).alias("reason"), "n"), "reason", "reasons")
