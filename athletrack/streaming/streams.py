"""Operators on unbounded feeds. Watermark delays are parameters of the library."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from athletrack.operators.timeline import lag
from athletrack.operators.tracking import FLAT, FLOWING, FRAME, Tracker, _config, flat_rows, frames_from, stepped, tracks
from athletrack.schemas import TrackConfig

_STATE = (
    "crop array<int>, pending string, last_frame double, last_at double, waiting_at double, waiting_crop array<int>, waiting_error string, failed boolean, frame bigint, config string"
)
IDLE = 3_600_000  # milliseconds after which a silent session is forgotten
PART = 5_000  # rows that are Python values at once
_NAMES = [c.split()[0] for c in FLAT.split(", ")]


def _pack(t: Tracker, frame: int, config: str | None) -> tuple:
    waiting_at, found, error = t.waiting or (None, None, None)
    return (list(t.crop) if t.crop else None, t.pending, float(t.last_frame), float(t.last_at), waiting_at, list(found) if found else None, error, t.failed, frame, config)


def _unpack(config: TrackConfig, state: tuple) -> Tracker:
    crop, pending, last_frame, last_at, waiting_at, found, error, failed = state
    waiting = None if waiting_at is None or math.isnan(waiting_at) else (waiting_at, tuple(found) if found is not None else None, error)
    return Tracker(config, (tuple(crop) if crop is not None else None, pending, last_frame, last_at, waiting, bool(failed)))


def _timeout(idle: int | str | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def _number(key: tuple) -> int | None:
    return None if key[0] is None or key[0] != key[0] else int(key[0])


def _own(config: pd.Series) -> str | None:
    """The session's configuration, where a row has one."""
    return next(iter(config.dropna()), None)


def _arrays(parts: list[pd.DataFrame], columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in columns}


def track_stream(rows: DataFrame, config: TrackConfig | None = None, idle: int | str | None = IDLE) -> DataFrame:
    """``track_sessions`` on a stream of ``fold_rows``: the state of a session is one small row.

    A session's rows of a micro-batch are in memory together, so a backlog is best read in several (``maxFilesPerTrigger``
    or the like). A frame's rows must come in one micro-batch, and frames of a session must arrive in order of frame_index between micro-batches; inside one they are sorted, so
    how a session is cut does not change its tracks. A frame that comes after a later one is not tracked: its row has
    the stage late. A session without a frame for ``idle`` milliseconds is forgotten; None keeps all, for a feed that
    is drained once (with a timeout such a query would wait for ever).
    """
    config = config or TrackConfig()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [pdf[pdf["frame_index"].notna()] for pdf in batches]
        known = state.get if state.exists else None
        chosen, last = (known[9], known[8]) if known else (next((c for c in map(_own, (p["config"] for p in parts)) if c is not None), None), -1)
        own = config if chosen is None else _config(chosen)
        tracker = _unpack(own, known[:8]) if known else Tracker(own)
        held = _arrays(parts, FLOWING[1:])  # arrays of numbers, which become Python values part by part
        held["frame_index"] = held["frame_index"].astype(np.int64)
        late, session = held["frame_index"] <= last, _number(key)
        out = [(session, frame, *[None] * 11, "late", None, None) for frame in np.sort(held["frame_index"][late & (held["kind"] == FRAME)]).tolist()]
        if late.any():
            held = {c: v[~late] for c, v in held.items()}
        for frame in frames_from(held, session, PART):
            if tracker.failed:
                break
            out.append(stepped(tracker, *frame))
            if len(out) >= PART:
                yield pd.DataFrame(out, columns=_NAMES, dtype=object)
                out = []
        state.update(_pack(tracker, int(held["frame_index"].max(initial=last)), chosen))
        if idle is not None:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=_NAMES, dtype=object)

    return tracks(flat_rows(rows).groupBy("session_id").applyInPandasWithState(run, FLAT, _STATE, "append", _timeout(idle)))


def latest_only_stream(stream: DataFrame, idle: int | str | None = IDLE) -> DataFrame:
    """(session_id, sequence, captured_at, dropped): for each session and micro-batch the newest unseen frame.

    Frames it replaces are counted as dropped; frames that are not newer than the last one are ignored. A session
    without a frame for ``idle`` milliseconds is forgotten; None keeps all, as in ``track_stream``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches))
        rows = rows[rows["sequence"] > last]
        if len(rows):
            newest = rows.loc[rows["sequence"] == rows["sequence"].max()].iloc[0]
            state.update((int(newest["sequence"]),))
            yield pd.DataFrame({"session_id": [key[0]], "sequence": [int(newest["sequence"])], "captured_at": [float(newest["captured_at"])], "dropped": [int(newest["sequence"]) - last - 1]})
        if idle is not None:
            state.setTimeoutDuration(int(idle))

    rows = stream.select("session_id", "sequence", "captured_at")
    schema = "session_id bigint, sequence bigint, captured_at double, dropped bigint"
    return rows.groupBy("session_id").applyInPandasWithState(run, schema, "last bigint", "append", _timeout(idle))


def _measures() -> list:
    return [
        F.count(F.lit(1)).alias("processed"),
        (F.max("latest_sequence") + 1).alias("captured"),
        F.count_if(F.col("frame_stage") == "detector").alias("refreshes"),
        F.count_if(F.col("frame_stage") != "reuse").alias("inferred"),
        F.count_if(F.col("has_player") & (F.col("frame_stage") != "reuse")).alias("poses"),
        F.max("frame_age").alias("max_age"),
        F.percentile_approx("frame_age", F.lit(0.95)).alias("age_p95"),
        F.max(lag("latest_sequence")).alias("max_lag"),
    ]


_FIGURES = ("processed", "captured", "skipped", "drop_pct", "inferred", "refreshes", "poses", "max_age", "age_p95", "max_lag")


def _figures(df: DataFrame, *keys: Column) -> DataFrame:
    skipped = F.greatest(F.lit(0), F.col("captured") - F.col("processed"))
    return df.withColumn("skipped", skipped).withColumn("drop_pct", 100.0 * F.col("skipped") / F.greatest(F.col("captured"), F.lit(1))).select("session_id", *keys, *_FIGURES)


def stream_session_summary(stream: DataFrame, gap: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """Final figures of a session once ``gap`` has passed without a frame (``captured_ts``).

    In append mode a session's row comes once the watermark has passed its end, and its state is dropped; frames that
    come later than ``delay`` are left out.
    """
    ended = stream.withWatermark("captured_ts", delay).groupBy(F.session_window("captured_ts", gap).alias("w"), "session_id").agg(*_measures())
    return _figures(ended, F.col("w.start").alias("started"), F.col("w.end").alias("ended"))


def stream_status(stream: DataFrame, every: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Figures of each session in aligned ticks of ``every``: the cheap form of ``status_ticks``.

    ``captured`` is the newest sequence number plus one, ``processed`` the frames of the tick.
    """
    ticks = stream.withWatermark("captured_ts", delay).groupBy(F.window("captured_ts", every).alias("w"), "session_id").agg(*_measures())
    return ticks.select("session_id", F.col("w.start").alias("tick"), "processed", "captured", "inferred", "refreshes", "poses", "max_age", "age_p95", "max_lag")
