"""Detector results applied on a live feed: a stream-stream as-of join with both sides in state up to the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from athletrack.streaming.waiting import Chunks, use_rocksdb

APPLIED = "session_id bigint, request_id bigint, completed_at double, applied_frame bigint, applied_sequence bigint, outcome string"
_COLUMNS = [c.split()[0] for c in APPLIED.split(", ")]
_WAITING = pa.schema([("session_id", pa.int64()), ("kind", pa.int8()), ("at", pa.float64()), ("ms", pa.int64()), ("request_id", pa.int64()), ("frame_index", pa.int64()), ("sequence", pa.int64())])
BUCKETS = 1_024


class WaitingResults(StatefulProcessor):
    """State of a bucket of sessions: results that wait, frames whose time the watermark has not passed, and the time of its timer.

    Sessions share a bucket so that a call to the state and a table of numbers serve many of them, short as they may be.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Chunks(handle, _WAITING)
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, wake = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            pdf = pdf[pdf["kind"].notna()]  # others only move the watermark
            timed = pdf["at"].notna()
            asked, early = pdf["kind"] == 0, timed & ~(pdf["ms"] < now)
            gone = pdf[asked & ~early]
            if len(gone):
                yield _given(gone["session_id"], gone["request_id"], gone["at"].where(gone["at"].notna()), None, None, np.where(timed[gone.index], "late", "no_time"))
            kept = pdf[early]
            if len(kept):
                self.waiting.add(kept)
                wake.append(int((kept["ms"] + np.where(kept["kind"] == 0, self.wait, 0)).min()) + 1)
        if wake:
            self._wake(min(wake))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.timer.exists() or expiredTimerInfo.getExpiryTimeInMs() != self.timer.get()[0]:
            return  # replaced by an earlier one
        self.timer.clear()
        rows = self.waiting.all()
        session, kind, at, ms, frame = (rows[c].to_numpy() for c in ("session_id", "kind", "at", "ms", "frame_index"))
        asked, passed = kind == 0, (kind == 1) & (ms < now)
        # by session and time, a result before the frames of its time, of a frame that repeats the last first: the next passed frame releases
        order = np.lexsort((-np.arange(len(at)), frame, ~asked, at, session))
        order = order[(asked | passed)[order]]
        place = np.where(passed[order], np.arange(len(order)), len(order))
        following = np.append(order, -1)[np.minimum.accumulate(place[::-1])[::-1]] if len(order) else order
        released = asked[order] & (following >= 0) & (session[order] == session[following])
        over = asked[order] & ~released & (ms[order] + self.wait < now)
        for picked, by, outcome in ((order[released], following[released], "applied"), (order[over], None, "no_frame")):
            if len(picked):
                of = rows.take(picked)
                frames = (None, None) if by is None else (frame[by], rows["sequence"].take(by).to_pylist())
                yield _given(of["session_id"].to_numpy(), of["request_id"].to_numpy(), of["at"].to_numpy(), *frames, outcome)
        rest = ~passed  # results that are still to come are later than frames that have passed
        rest[order[released | over]] = False
        if not rest.all():
            self.waiting.keep(rows.filter(pa.array(rest)))
        if rest.any():
            self._wake(max(int((ms + np.where(asked, self.wait, 0))[rest].min()) + 1, now + 1))

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        known = self.timer.get()[0] if self.timer.exists() else None
        if known is not None and known <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.timer.update((at,))


def _given(session, request, at, frame, sequence, outcome) -> pd.DataFrame:
    out = pd.DataFrame({"session_id": np.asarray(session), "request_id": np.asarray(request), "completed_at": np.asarray(at)})
    whole = lambda values: pd.array([None] * len(out) if values is None else values, dtype="Int64")
    return out.assign(applied_frame=whole(frame), applied_sequence=whole(sequence), outcome=outcome)[_COLUMNS]


def result_rows(results: DataFrame, frames: DataFrame) -> DataFrame:
    """Results (session_id, request_id, completed_at) and frames (session_id, frame_index, sequence, loop_started_at) as one feed, each with its time as ``event_ts``."""
    none = F.lit(None).cast("bigint")
    both = results.select("session_id", F.lit(0).alias("kind"), F.col("completed_at").alias("at"), "request_id", none.alias("frame_index"), none.alias("sequence")).unionByName(
        frames.select("session_id", F.lit(1).alias("kind"), F.col("loop_started_at").alias("at"), none.alias("request_id"), "frame_index", "sequence")
    )
    return both.withColumn("event_ts", F.when(~F.isnan("at"), F.timestamp_millis(F.floor(F.col("at") * 1000))))


def apply_results_stream(rows: DataFrame, delay: str = "10 seconds", wait: int = 60_000, buckets: int = BUCKETS) -> DataFrame:
    """``apply_detector_results`` on a stream of ``result_rows`` in any order.

    A result is released by the first frame whose loop starts when it is there, once the watermark (``delay`` behind the
    newest time of all sessions) has passed that frame's start, so that no earlier frame can come. ``outcome``: applied;
    no_frame, if the watermark is ``wait`` milliseconds past the result and no frame has come; late, if the result comes
    after the watermark has passed it; no_time for one without a time. Frames leave the state as the watermark passes them,
    results as they are released, so an ended session keeps nothing. Rows that repeat give as many rows; frames that come
    too late release nothing; rows without a kind only move the watermark. Rows without a session_id are the session -1.
    The state is kept by ``buckets`` of sessions; a checkpoint goes with their number.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    if wait < 0:
        raise ValueError("wait must not be negative")
    use_rocksdb(rows.sparkSession)
    watched = rows.withWatermark("event_ts", delay)
    # the time as a number: Spark leaves out late rows of the watermark's own column, and here they are shown
    plain = watched.select(F.coalesce("session_id", F.lit(-1)).alias("session_id"), "kind", "at", F.unix_millis("event_ts").alias("ms"), F.coalesce("request_id", F.lit(-1)).alias("request_id"), F.coalesce("frame_index", F.lit(-1)).alias("frame_index"), "sequence")
    return plain.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(WaitingResults(wait), APPLIED, "append", "eventTime")
