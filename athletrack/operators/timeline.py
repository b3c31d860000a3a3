"""Latencies, as-of matches and the clocks of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag(latest: str, sequence: str = "sequence") -> Column:
    """How far ``sequence`` is behind, 0 at least; null where either is not known."""
    behind = F.col(latest) - F.col(sequence)
    return F.when(behind.isNotNull(), F.greatest(F.lit(0), behind))


def frame_latency(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "frame_age": F.col("completed_at") - F.col("captured_at"),
        "inference_wait": F.col("inference_started_at") - F.col("captured_at"),
        "sequence_lag": lag("latest_sequence"),
    })


def detector_latency(df: DataFrame) -> DataFrame:
    return df.withColumns({"result_latency": F.col("consumed_at") - F.col("requested_at"), "result_lag": lag("consumed_sequence")})


def infer_sample(df: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.where(F.col("frame_index") % n == 0)


def frame_stage(df: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Adds ``frame_stage`` from inferred, detector_ran and has_crop; ``mode``: hybrid, whole_image or detector."""
    if mode == "hybrid":
        stage = F.when(F.col("inferred") & F.col("detector_ran"), "detector").when(F.col("inferred") & F.col("has_crop"), "pose")
    elif mode in ("whole_image", "detector"):
        stage = F.when(F.col("inferred"), "pose" if mode == "whole_image" else "detector")
    else:
        raise ValueError("mode must be hybrid, whole_image or detector")
    return df.withColumn("frame_stage", stage.otherwise("reuse"))


def scoped(df: DataFrame, sessions: DataFrame, clock: str) -> DataFrame:
    """Rows under the scope all, and again under steady if ``clock`` is not before the end of the warm-up."""
    limits = sessions.select("session_id", (F.col("started_at") + F.col("warmup_seconds")).alias("_steady_from"))
    steady = F.col(clock) >= F.col("_steady_from")
    scopes = F.when(steady, F.array(F.lit("all"), F.lit("steady"))).otherwise(F.array(F.lit("all")))
    return df.join(limits, "session_id").withColumn("scope", F.explode(scopes)).drop("_steady_from")


def steady_filter(df: DataFrame, sessions: DataFrame, clock: str) -> DataFrame:
    limits = sessions.select("session_id", (F.col("started_at") + F.col("warmup_seconds")).alias("_steady_from"))
    return df.join(limits, "session_id").where(F.col(clock) >= F.col("_steady_from")).drop("_steady_from")


def dropped_frames(taken: DataFrame) -> DataFrame:
    """Adds ``dropped``: sequence numbers left out since the frame taken before."""
    order = Window.partitionBy("session_id").orderBy("sequence")
    return taken.withColumn("dropped", F.greatest(F.lit(0), F.col("sequence") - F.lag("sequence", 1, -1).over(order) - 1))


def latest_frame_feed(polls: DataFrame, frames: DataFrame) -> DataFrame:
    """(session_id, poll_index, polled_at, sequence, dropped): each poll takes the newest captured frame, or waits for the next.

    ``polls``: session_id, polled_at. ``frames``: session_id, sequence, captured_at. No range join: polls and frames
    are sorted together, and what was taken before is a running maximum.
    """
    both = polls.select("session_id", F.col("polled_at").alias("at"), F.lit(None).cast("bigint").alias("seq"), F.lit(1).alias("kind")).unionByName(
        frames.select("session_id", F.col("captured_at").alias("at"), F.col("sequence").alias("seq"), F.lit(0).alias("kind"))
    )
    until_now = Window.partitionBy("session_id").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("newest", F.coalesce(F.max("seq").over(until_now), F.lit(-1))).withColumn("last", F.max("seq").over(Window.partitionBy("session_id")))
    i = F.row_number().over(Window.partitionBy("session_id").orderBy("at")).cast("bigint")
    asked = met.where("kind = 1").withColumn("i", i)
    so_far = Window.partitionBy("session_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    taken = asked.withColumn("sequence", F.col("i") + F.greatest(F.lit(-1), F.max(F.col("newest") - F.col("i")).over(so_far))).where(F.col("sequence") <= F.col("last"))
    before = F.lag("sequence", 1, -1).over(Window.partitionBy("session_id").orderBy("i"))
    return taken.select("session_id", (F.col("i") - 1).alias("poll_index"), F.col("at").alias("polled_at"), "sequence", (F.col("sequence") - before - 1).alias("dropped"))


def apply_detector_results(results: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``applied_frame`` and ``applied_sequence``: the first frame whose loop starts when the result is there; null if none.

    ``results``: session_id, request_id, completed_at. ``frames``: session_id, frame_index, sequence, loop_started_at.
    """
    none = F.lit(None).cast("bigint")
    both = results.select("session_id", F.col("completed_at").alias("at"), F.lit(0).alias("kind"), "request_id", none.alias("frame_index"), none.alias("sequence")).unionByName(
        frames.select("session_id", F.col("loop_started_at").alias("at"), F.lit(1).alias("kind"), none.alias("request_id"), "frame_index", "sequence")
    )
    ahead = Window.partitionBy("session_id").orderBy("at", "kind", "frame_index").rowsBetween(0, Window.unboundedFollowing)
    first = both.withColumns({"applied_frame": F.first("frame_index", ignorenulls=True).over(ahead), "applied_sequence": F.first("sequence", ignorenulls=True).over(ahead)})
    return first.where("kind = 0").select("session_id", "request_id", F.col("at").alias("completed_at"), "applied_frame", "applied_sequence")


def pose_reuse(frames: DataFrame, poses: DataFrame, n: int) -> DataFrame:
    """Each frame with the pose of the last inferred one, null if that had none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    shown = frames.withColumn("source_frame", F.col("frame_index") - F.col("frame_index") % n)
    return shown.join(poses.withColumnRenamed("frame_index", "source_frame"), ["session_id", "source_frame"], "left")


def paced_capture_times(frames: DataFrame, fps: float, start: float = 0.0) -> DataFrame:
    """Adds ``released_at``: frame n not before start + n / fps, nor before it and all earlier ones are decoded."""
    so_far = Window.partitionBy("session_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("frame_index")) - 1
    ready = frames.withColumn("_d", F.sum("decode_seconds").over(so_far)).withColumn("_slack", F.lit(float(start)) + n.cast("double") / F.lit(float(fps)) - F.col("_d"))
    return ready.withColumn("released_at", F.col("_d") + F.greatest(F.lit(float(start)), F.max("_slack").over(so_far))).drop("_d", "_slack")


def compare_runs(a: DataFrame, b: DataFrame, on: str = "video") -> DataFrame:
    """One row for each video of either run: gain in FPS, drop, ages and refreshes of both; null where not measured."""
    measures = ("fps", "drop_pct", "age_p95", "max_age", "refreshes")
    left = a.select(on, *(F.col(m).alias(f"{m}_before") for m in measures))
    right = b.select(on, *(F.col(m).alias(f"{m}_after") for m in measures))
    gain = F.when(F.col("fps_before") > 0, 100 * (F.col("fps_after") - F.col("fps_before")) / F.col("fps_before"))
    return left.join(right, on, "full").withColumn("gain_pct", gain)
