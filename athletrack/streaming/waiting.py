"""The tracker on a feed whose frames, boxes and poses come in any order.

What arrives waits in the session's state, as it came, until the watermark has passed the frame's time; then frames are
tracked in order and what still waits is written back. One timer by session stands at the first frame that waits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from athletrack.operators.tracking import BOX, FLAT, FRAME, NUMBERS, Tracker, _config, flat_rows, frames_from, stepped, tracks
from athletrack.schemas import TrackConfig
from athletrack.streaming.streams import _NAMES, _STATE, IDLE, PART, _number, _own, _pack, _unpack

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = pa.schema([("frame_index", pa.int64()), ("kind", pa.int8()), ("detector_error", pa.string()), *((c, pa.float64()) for c in NUMBERS), ("event_ms", pa.int64())])
FOREVER = 1 << 62


class Chunks:
    """Rows that wait in a list state, a chunk for each time that some came: one call to the state, however many rows."""

    def __init__(self, handle: StatefulProcessorHandle, schema: pa.Schema):
        self.schema, self.held = schema, handle.getListState("waiting", "rows binary")

    def add(self, pdf: pd.DataFrame) -> None:
        self.held.appendValue((self._bytes(pa.table([pa.array(pdf[f.name], f.type, from_pandas=True) for f in self.schema], schema=self.schema)),))

    def all(self) -> pa.Table:
        chunks = [pa.ipc.open_stream(bytes(c[0])).read_all() for c in self.held.get()] if self.held.exists() else []
        return pa.concat_tables([self.schema.empty_table(), *chunks])

    def keep(self, rows: pa.Table) -> None:
        """Only ``rows`` from now on."""
        self.held.clear()
        for at in range(0, len(rows), 10_000):
            self.held.appendValue((self._bytes(rows.slice(at, 10_000)),))

    def _bytes(self, rows: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:  # not all numbers of a row are there
            out.write_table(rows)
        return sink.getvalue().to_pybytes()


class WaitingTracker(StatefulProcessor):
    """State of a session: the tracker (with the last frame tracked), the rows that wait, and the time of its timer."""

    def __init__(self, config: TrackConfig, idle: int | None):
        self.config, self.idle = config, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", _STATE)
        self.frames = Chunks(handle, _WAITING)
        self.clock = handle.getValueState("clock", "timer bigint, newest bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.tracker.get() if self.tracker.exists() else None
        last, chosen, new, due, newest = known[8] if known else -1, known[9] if known else None, known is None, [], []
        for pdf in rows:
            pdf = pdf[pdf["frame_index"].notna() & pdf["event_ms"].notna()]  # a row without either only moves the watermark
            if not len(pdf):
                continue
            if new or chosen is None and last == -1 and _own(pdf["config"]) is not None:  # boxes may come before the frame that has the configuration
                chosen, new = chosen or _own(pdf["config"]), False
                self.tracker.update(_pack(Tracker(self.config if chosen is None else _config(chosen)), -1, chosen))
            missed = pdf["frame_index"] <= last
            if missed.any():
                yield _said(_number(key), ((int(f), "late" if k == FRAME else "late_box" if k == BOX else "late_pose") for f, k in zip(pdf.loc[missed, "frame_index"], pdf.loc[missed, "kind"])))
                pdf = pdf[~missed]
            if len(pdf):
                self.frames.add(pdf)
                due.append(int(_due(*(pdf[c].to_numpy().astype(np.int64) for c in ("frame_index", "event_ms")))[2].min()))
                newest.append(int(pdf["event_ms"].max()))
        if due:
            self._wake(min(due) + 1, max(newest))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, newest = self.clock.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return  # replaced by an earlier one
        waiting = self.frames.all()
        order, starts, due = _due(waiting["frame_index"].to_numpy(), waiting["event_ms"].to_numpy())
        # in order of the frames: one whose time is not there yet holds the later ones; a watermark that only reached it may still be the one before all rows, 0
        held = np.flatnonzero(due >= now)
        cut = int(starts[held[0]]) if len(held) else len(order)
        if not len(order) and self.idle is not None and newest + self.idle <= now:
            self.tracker.clear()
            self.clock.clear()
            return
        if cut:
            ready = waiting.take(order[:cut])
            yield from self._track(_number(key), {c: ready[c].to_numpy() for c in ready.column_names})
            self.frames.keep(waiting.take(order[cut:]))
        self.clock.update((-1, newest))
        if len(held):
            self._wake(max(int(due[held[0]]), now) + 1, newest)
        elif self.idle is not None:
            self._wake(max(newest + self.idle, now + 1), newest)

    def close(self) -> None:
        pass

    def _wake(self, at: int, newest: int) -> None:
        """The timer at ``at``, unless it stands earlier."""
        timer, known = self.clock.get() if self.clock.exists() else (-1, -1)
        if timer == -1 or at < timer:
            if timer != -1:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.clock.update((timer, max(known, newest)))

    def _track(self, session: int | None, rows: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        known = self.tracker.get()
        tracker = _unpack(self.config if known[9] is None else _config(known[9]), known[:8])
        out = []
        for frame in frames_from(rows, session, PART):
            if tracker.failed:
                break
            out.append(stepped(tracker, *frame))
            if len(out) >= PART:
                yield pd.DataFrame(out, columns=_NAMES, dtype=object)
                out = []
        self.tracker.update(_pack(tracker, int(rows["frame_index"].max()), known[9]))
        if out:
            yield pd.DataFrame(out, columns=_NAMES, dtype=object)
        lost = np.setdiff1d(rows["frame_index"], rows["frame_index"][rows["kind"] == FRAME])  # told even after a failure
        if len(lost):
            yield _said(session, ((f, "no_frame") for f in lost.tolist()))


def _due(frames: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places by frame, where each frame starts in them, when it is due): a frame is due when the last of its rows is."""
    order = np.argsort(frames, kind="stable")
    starts = np.flatnonzero(np.diff(frames[order], prepend=-1 << 62))
    return order, starts, np.maximum.reduceat(times[order], starts) if len(starts) else starts


def _said(session: int, what) -> pd.DataFrame:
    return pd.DataFrame([(session, frame, *[None] * 11, stage, None, None) for frame, stage in what], columns=_NAMES, dtype=object)


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and maps need the state store that is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def track_unordered(rows: DataFrame, config: TrackConfig | None = None, event_time: str = "event_ts", delay: str = "10 seconds", idle: int | None = IDLE) -> DataFrame:
    """``track_sessions`` on a stream of ``fold_rows`` in any order, each with the time of its frame in ``event_time``.

    A frame is tracked once the watermark (``delay`` behind the newest time of all sessions) has passed its time, with all
    boxes and poses that are there by then; frames go in order of frame_index, and one whose time has not come holds the
    later ones of its session. What comes after its frame has been tracked, or after a later one, gives a row with the
    stage late, late_box or late_pose; boxes and poses whose frame never came give one with no_frame. Rows without a
    frame_index only move the watermark: a feed that ends sends one of a later time. Times before 1970 are always past. A session is forgotten
    ``idle`` milliseconds of event time after its newest frame; None keeps all.
    """
    config = config or TrackConfig()
    use_rocksdb(rows.sparkSession)
    watched = rows.withWatermark(event_time, delay)
    # as a number: Spark leaves out late rows of the watermark's own column, and here they are shown
    plain = flat_rows(watched, F.unix_millis(event_time).alias("event_ms")).withColumn("session_id", F.coalesce("session_id", F.lit(-1)))
    return tracks(plain.groupBy("session_id").transformWithStateInPandas(WaitingTracker(config, idle), FLAT, "append", "eventTime"))
