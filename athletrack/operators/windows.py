"""Rolling and running values of a session, in frame order."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from athletrack.operators.metrics import keys
from athletrack.operators.timeline import lag

SIZES = {"decode_seconds": 60, "detector_seconds": 20, "pose_seconds": 60, "display_seconds": 60}


def _last(k: int, include_current: bool = True, order: str = "frame_index") -> WindowSpec:
    if k < 1:
        raise ValueError("a window has at least one row")
    end = 0 if include_current else -1
    return Window.partitionBy("session_id").orderBy(order).rowsBetween(end - k + 1, end)


def _samples(name: str, k: int) -> Column:
    """The last k samples of a kind: frames without one don't count."""
    nth = Window.partitionBy("session_id", F.col(name).isNotNull()).orderBy("frame_index")
    return F.when(F.col(name).isNotNull(), F.avg(name).over(nth.rowsBetween(-(k - 1), 0)))


def rolling_stage_means(frame_log: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Adds the mean of the last samples of each kind, as known at the frame; null before the first."""
    so_far = Window.partitionBy("session_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    out = frame_log
    for name, k in (sizes or SIZES).items():
        mean = name.replace("_seconds", "_rolling")
        out = out.withColumn(mean, _samples(name, k)).withColumn(mean, F.last(mean, ignorenulls=True).over(so_far))
    return out


def rolling_fps(frame_log: DataFrame, model_k: int = 30, output_k: int = 60, include_current: bool = True) -> DataFrame:
    """Adds ``model_fps`` over the last inference times and ``output_fps`` over the last loop times."""

    def fps(name: str, w: WindowSpec) -> Column:
        return F.count(name).over(w) / F.greatest(F.coalesce(F.sum(name).over(w), F.lit(0.0)), F.lit(1e-6))

    nth = Window.partitionBy("session_id", F.col("pose_seconds").isNotNull()).orderBy("frame_index").rowsBetween(-(model_k - 1), 0)
    so_far = Window.partitionBy("session_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    model = F.when(F.col("pose_seconds").isNotNull(), fps("pose_seconds", nth))
    out = frame_log.withColumn("model_fps", model).withColumn("model_fps", F.coalesce(F.last("model_fps", ignorenulls=True).over(so_far), F.lit(0.0)))
    return out.withColumn("output_fps", fps("loop_seconds", _last(output_k, include_current)))


class _Recent:
    """The last k values of a session and, beside them, the same in order; nulls take a place and no rank, NaN come last."""

    def __init__(self, k: int):
        self.last: deque[float | None] = deque()
        self.k, self.sorted, self.nans = k, [], 0

    def add(self, value: float | None) -> None:
        if len(self.last) == self.k:
            gone = self.last.popleft()
            if gone is not None:
                if gone != gone:
                    self.nans -= 1
                else:
                    del self.sorted[bisect_left(self.sorted, gone)]
        self.last.append(value)
        if value is not None:
            if value != value:
                self.nans += 1
            else:
                insort(self.sorted, value)

    def percentile(self, p: float) -> float | None:
        n = len(self.sorted) + self.nans
        if not n:
            return None
        place = (n - 1) * p
        low = int(place)
        if place == low:
            return self._at(low)
        return (low + 1 - place) * self._at(low) + (place - low) * self._at(low + 1)

    def _at(self, i: int) -> float:
        return self.sorted[i] if i < len(self.sorted) else math.nan


def rolling_age_percentiles(frame_log: DataFrame, k: int = 120, include_current: bool = True) -> DataFrame:
    """Adds the median and the 95th percentile of the last ages, and the latter of the last waits.

    Rows pass through their session's last k values, which stay sorted as one comes and one goes; other columns pass as
    they are. A task holds 2 k values at a time, so a session may have any length.
    """
    if k < 1:
        raise ValueError("a window has at least one row")
    names = ("age_p50", "age_p95", "wait_p95")
    rows = frame_log.drop(*names)
    schema = StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ages, waits = object(), _Recent(k), _Recent(k)
        for batch in batches:
            out = []
            for session, age, wait in zip(*(batch.column(c).to_pylist() for c in ("session_id", "frame_age", "inference_wait"))):
                if session != held:
                    held, ages, waits = session, _Recent(k), _Recent(k)
                if include_current:
                    ages.add(age)
                    waits.add(wait)
                out.append((ages.percentile(0.5), ages.percentile(0.95), waits.percentile(0.95)))
                if not include_current:
                    ages.add(age)
                    waits.add(wait)
            made = [pa.array(c, pa.float64()) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return rows.repartition("session_id").sortWithinPartitions("session_id", "frame_index").mapInArrow(run, schema)


def rolling_max_lag(frame_log: DataFrame, k: int = 120, include_current: bool = True) -> DataFrame:
    return frame_log.withColumn("max_lag", F.coalesce(F.max(lag("latest_sequence")).over(_last(k, include_current)), F.lit(0)))


def live_totals(frame_log: DataFrame) -> DataFrame:
    """Adds running captured, processed and skipped frames and the drop in percent."""
    so_far = Window.partitionBy("session_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    counted = frame_log.withColumns({"captured": F.max("latest_sequence").over(so_far) + 1, "processed": F.count(F.lit(1)).over(so_far), "_dropped": F.sum("dropped").over(so_far)})
    skipped = counted.withColumn("skipped", F.greatest(F.col("_dropped"), F.col("captured") - F.col("processed")))
    return skipped.withColumn("drop_pct", 100.0 * F.col("skipped") / F.greatest(F.col("captured"), F.lit(1))).drop("_dropped")


def edge_repeat_streaks(assessed: DataFrame) -> DataFrame:
    """(session_id, repeated, max_streak): events that share a joint and side with the observation just before.

    Rows with a scope (``scoped``) give a row for each scope, whose memory starts empty.
    """
    marks = F.array_distinct(F.transform("assessment.edge_hits", lambda h: F.concat_ws("|", h["joint"], h["edge"])))
    by = keys(assessed)
    order = Window.partitionBy(*by).orderBy("frame_index")
    rows = assessed.select(*by, "frame_index", marks.alias("marks"))
    rows = rows.withColumn("again", F.coalesce(F.arrays_overlap("marks", F.lag("marks").over(order)), F.lit(False)))
    rows = rows.withColumn("island", F.sum((~F.col("again")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.when(F.size("marks") > 0, F.row_number().over(Window.partitionBy(*by, "island").orderBy("frame_index"))).otherwise(0)
    return rows.withColumn("streak", streak).groupBy(*by).agg(F.count_if("again").alias("repeated"), F.max("streak").cast("bigint").alias("max_streak"))
