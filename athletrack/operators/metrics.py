"""Counts, rates and percentiles of sessions. Sums and counts are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athletrack.operators.timeline import lag, scoped


def rate(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def percentile(value: Column | str, p: float, exact: bool = True) -> Column:
    return F.percentile(value, F.lit(p)) if exact else F.percentile_approx(value, F.lit(p))


def steady_seconds() -> Column:
    return F.greatest(F.lit(0.0), F.col("ended_at") - F.greatest(F.col("started_at"), F.col("started_at") + F.col("warmup_seconds")))


def seconds_of_scope() -> Column:
    return F.when(F.col("scope") == "steady", steady_seconds()).otherwise(F.col("ended_at") - F.col("started_at"))


def session_throughput(frame_log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Duration, frames captured, processed, inferred, refreshed and skipped, with their rates.

    ``frame_log`` has ``dropped``. Captured frames are the last sequence number plus one.
    """
    counts = frame_log.groupBy("session_id").agg(
        (F.max("sequence") + 1).alias("captured"),
        F.min("captured_at").alias("_first"),
        F.max("captured_at").alias("_last"),
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("frame_stage") != "reuse").alias("inferred"),
        F.count_if(F.col("frame_stage") == "detector").alias("refreshes"),
        F.sum("dropped").alias("_dropped"),
    )
    rows = counts.join(sessions, "session_id").withColumn("duration", F.col("ended_at") - F.col("started_at"))
    skipped = F.greatest(F.col("_dropped"), F.col("captured") - F.col("processed"))
    return rows.select(
        "session_id", "duration", "captured", "processed", "inferred", "refreshes", skipped.alias("skipped"),
        rate(F.greatest(F.lit(0), F.col("captured") - 1), F.col("_last") - F.col("_first")).alias("capture_fps"),
        rate(F.col("processed"), F.col("duration")).alias("processed_fps"),
        rate(F.col("inferred"), F.col("duration")).alias("inferred_fps"),
        (100.0 * skipped / F.greatest(F.col("captured"), F.lit(1))).alias("drop_pct"),
    )


def session_freshness(frame_log: DataFrame, sessions: DataFrame, exact: bool = True) -> DataFrame:
    """Ages, waits and lag of each session and scope, with the scope's length and rate."""
    rows = scoped(frame_log, sessions, "completed_at").groupBy("session_id", "scope").agg(
        F.count(F.lit(1)).alias("processed"),
        percentile("frame_age", 0.5, exact).alias("age_p50"),
        percentile("frame_age", 0.95, exact).alias("age_p95"),
        F.max("frame_age").alias("max_age"),
        percentile("inference_wait", 0.95, exact).alias("wait_p95"),
        F.max(lag("latest_sequence")).alias("max_lag"),
    )
    rows = rows.join(sessions, "session_id").withColumn("seconds", seconds_of_scope())
    return rows.select("session_id", "scope", "processed", "age_p50", "age_p95", "max_age", "wait_p95", "max_lag", "seconds", rate(F.col("processed"), F.col("seconds")).alias("fps"))


def frame_class_latency(frame_log: DataFrame, sessions: DataFrame, exact: bool = True) -> DataFrame:
    """Steady ages of pose and detector frames; the detector's count is the steady number of refreshes."""
    steady = scoped(frame_log.where(F.col("frame_stage").isin("pose", "detector")), sessions, "completed_at").where("scope = 'steady'")
    return steady.groupBy("session_id", "frame_stage").agg(F.count(F.lit(1)).alias("n"), percentile("frame_age", 0.5, exact).alias("age_p50"), percentile("frame_age", 0.95, exact).alias("age_p95"))


def pose_output_rate(frame_log: DataFrame, sessions: DataFrame, exact: bool = True) -> DataFrame:
    """Inferred frames with a player, per second, and the time a pose takes; clock: ``pose_ended_at``."""
    inferred = scoped(frame_log.where("frame_stage <> 'reuse'"), sessions, "pose_ended_at")
    rows = inferred.groupBy("session_id", "scope").agg(
        F.count_if("has_player").alias("poses"), percentile("pose_seconds", 0.5, exact).alias("pose_p50"), percentile("pose_seconds", 0.95, exact).alias("pose_p95")
    )
    return rows.join(sessions, "session_id").select("session_id", "scope", "poses", "pose_p50", "pose_p95", rate(F.col("poses"), seconds_of_scope()).alias("poses_per_second"))


def detector_worker_stats(requests: DataFrame, sessions: DataFrame, exact: bool = True) -> DataFrame:
    """Submitted requests by the time of the request, consumed ones by the time of consumption."""
    sent = scoped(requests.where("accepted"), sessions, "requested_at").groupBy("session_id", "scope").agg(F.count(F.lit(1)).alias("submitted"))
    latency, behind = F.col("consumed_at") - F.col("requested_at"), lag("consumed_sequence").cast("double")
    done = scoped(requests.where("accepted and consumed_at is not null"), sessions, "consumed_at").groupBy("session_id", "scope").agg(
        F.count(F.lit(1)).alias("completed"),
        *(percentile(v, p, exact).alias(f"{name}_p{round(100 * p)}") for name, v in (("latency", latency), ("lag", behind)) for p in (0.5, 0.95)),
    )
    return sent.join(done, ["session_id", "scope"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("submitted", "completed")})


def detector_reason_counts(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    return scoped(requests.where("accepted"), sessions, "requested_at").groupBy("session_id", "scope", "reason").agg(F.count(F.lit(1)).alias("n"))


def detector_rate(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Steady refreshes for each second of steady time, for every session."""
    n = scoped(requests.where("accepted"), sessions, "requested_at").where("scope = 'steady'").groupBy("session_id").agg(F.count(F.lit(1)).alias("refreshes"))
    rows = sessions.join(n, "session_id", "left").withColumn("refreshes", F.coalesce("refreshes", F.lit(0)))
    return rows.select("session_id", "refreshes", rate(F.col("refreshes"), steady_seconds()).alias("per_second"))


def keys(df: DataFrame, *more: str) -> list[str]:
    """session_id, and scope where rows have one (``scoped``): edge reports then cover all scopes at once."""
    return ["session_id", *(["scope"] if "scope" in df.columns else []), *more]


def edge_event_counts(assessed: DataFrame) -> DataFrame:
    """Observations with a hit, and those with hits on clamped sides only."""
    return assessed.groupBy(*keys(assessed)).agg(
        F.count_if(F.size("assessment.edge_hits") > 0).alias("events"), F.count_if("assessment.clamped_only_suppressed").alias("suppressed")
    )


def edge_actionable_split(assessed: DataFrame) -> DataFrame:
    rows = edge_event_counts(assessed)
    return rows.select(*keys(rows), "events", "suppressed", (F.col("events") - F.col("suppressed")).alias("actionable"))


def edge_hit_rows(assessed: DataFrame) -> DataFrame:
    return assessed.select(*keys(assessed, "frame_index"), F.explode("assessment.edge_hits").alias("h")).select(*keys(assessed, "frame_index"), "h.*")


def edge_side_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*keys(hits, "edge")).agg(F.count(F.lit(1)).alias("n"))


def edge_joint_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*keys(hits, "joint")).agg(F.count(F.lit(1)).alias("n"))


def edge_landmark_histogram(assessed: DataFrame) -> DataFrame:
    """Events by their number of distinct joints; counted in the row, without a shuffle by event."""
    joints = F.size(F.array_distinct(F.transform("assessment.edge_hits", lambda h: h["joint"]))).cast("bigint")
    return assessed.withColumn("joints", joints).where("joints > 0").groupBy(*keys(assessed, "joints")).agg(F.count(F.lit(1)).alias("n"))


def edge_clamp_counts(assessed: DataFrame) -> DataFrame:
    """Events by side that is both hit and clamped; not_clamped where there is none."""
    both = F.array_intersect(F.transform("assessment.edge_hits", lambda h: h["edge"]), F.col("assessment.clamped_edges"))
    sides = F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("not_clamped")))
    rows = assessed.where(F.size("assessment.edge_hits") > 0).select(*keys(assessed), F.explode(sides).alias("side"))
    return rows.groupBy(*keys(rows, "side")).agg(F.count(F.lit(1)).alias("n"))


def edge_confidence(hits: DataFrame, exact: bool = True) -> DataFrame:
    return hits.groupBy(*keys(hits)).agg(F.count(F.lit(1)).alias("n"), percentile("confidence", 0.5, exact).alias("p50"), percentile("confidence", 0.95, exact).alias("p95"))


STAGES = ("decode_seconds", "detector_seconds", "pose_seconds", "display_seconds")


def stage_means(frame_log: DataFrame) -> DataFrame:
    return frame_log.groupBy("session_id").agg(*(F.avg(s).alias(s.replace("_seconds", "_mean")) for s in STAGES))


def frame_budget(means: DataFrame, interval: int) -> DataFrame:
    """Milliseconds a frame should take with a detection every ``interval`` frames, and the rate that follows."""
    if interval < 1:
        raise ValueError("interval must be at least 1")
    zero = F.lit(0.0)
    parts = [F.coalesce("detector_mean", zero) / interval, *(F.coalesce(c, zero) for c in ("pose_mean", "display_mean", "decode_mean"))]
    total = 1000 * (parts[0] + parts[1] + parts[2] + parts[3])
    return means.withColumn("budget_ms", total).withColumn("expected_fps", F.when(F.col("budget_ms") > 0, 1000 / F.col("budget_ms")))


def latency_percentiles(df: DataFrame, by: list[str], col: str, ps: tuple[float, ...] = (0.5, 0.95), exact: bool = True) -> DataFrame:
    return df.groupBy(*by).agg(F.count(col).alias("n"), *(percentile(col, p, exact).alias(f"p{round(100 * p)}") for p in ps), F.max(col).alias("max"))
