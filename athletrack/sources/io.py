"""Frames, model scores, poses and reports: in and out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from athletrack.schemas import FRAMES
from athletrack.sources.shared import stored

BUCKETS = 256


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recorded frames in order; ``sequence`` counts from 0 by captured_at and nothing is dropped.

    ``parquet``: a frame index with the columns of FRAMES (without sequence). ``binaryFile``: extracted images named
    <session>/<frame>.<ext>, with their bytes, in order of their number; they are captured when the file was written, and nothing is known
    of the time it takes to decode them.
    """
    if fmt == "binaryFile":
        files = spark.read.format("binaryFile").load(path)
        parts = F.regexp_extract("path", r"(\d+)/(\d+)\.\w+$", 1), F.regexp_extract("path", r"(\d+)/(\d+)\.\w+$", 2)
        frames = files.where(F.length(parts[1]) > 0).select(
            parts[0].cast("bigint").alias("session_id"), parts[1].cast("bigint").alias("frame_index"), F.unix_micros("modificationTime").cast("double").alias("captured_at"), F.lit(None).cast("double").alias("decode_seconds"), "content"
        )
        return in_order(frames.withColumn("captured_at", F.col("captured_at") / 1e6), "frame_index")
    frames = spark.read.format(fmt).load(path)
    return in_order(frames)


def in_order(frames: DataFrame, *by: str) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(*(by or ("captured_at", "frame_index")))
    return frames.withColumn("sequence", (F.row_number().over(order) - 1).cast("bigint"))


def read_frame_stream(spark: SparkSession, path: str, schema: str = FRAMES, fmt: str = "parquet", **options: str) -> DataFrame:
    """An unbounded feed of frames: files that arrive in a folder, or another streaming source by its name and options."""
    reader = spark.readStream.format(fmt).schema(schema) if fmt in ("parquet", "json", "csv", "orc") else spark.readStream.format(fmt)
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


WAITING_SIZES = 64
HANDED_BACK = 512  # rows of short calls that go back to Spark together


def crop_size(df: DataFrame, crop: str = "crop") -> DataFrame:
    """Adds ``crop_width`` and ``crop_height``, null without a crop."""
    return df.withColumns({"crop_width": F.col(f"{crop}.x2") - F.col(f"{crop}.x1"), "crop_height": F.col(f"{crop}.y2") - F.col(f"{crop}.y1")})


def dealt(df: DataFrame, same: list[str], least: int = 1) -> DataFrame:
    """Rows that are equal in ``same`` next to each other in one task; where they are more than two tasks' share (and twice ``least``), in several.

    The rows are counted by ``same`` before; fewer than half as many values as there are tasks have so many, and only these
    reach the driver. The counts decide where a row goes, nothing else.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(df.groupBy(*same).agg(F.count("*").alias("rows")), "sizes")
    share = max((counts.agg(F.sum("rows")).first()[0] or 0) / n, least)
    parts = F.ceil(F.least(F.col("rows") * 16 / share, F.col("rows") / (4 * least)))  # more than one for each share, as a hash deals few parts unevenly
    many = dict(map(tuple, counts.where(F.col("rows") > 2 * share).select(F.xxhash64(*same), parts).collect()))
    salt = F.lit(0).cast("bigint")
    if many:
        part = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in many.items() for v in pair)), F.xxhash64(*same)), F.lit(1))
        salt = F.pmod(F.xxhash64(*(c for c in ("session_id", "frame_index") if c in df.columns)), part)
    return df.repartition(n, F.xxhash64(*same), salt).sortWithinPartitions(*same)


def joined(parts: list[pd.DataFrame], **options: bool) -> pd.DataFrame:
    return pd.concat(parts, **options) if len(parts) > 1 else parts[0]


def alike(batch: pd.DataFrame, same: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The values of ``same``, None for null, each with its rows. Rows are moved only where equal ones are not next to each other."""
    code = batch.groupby(same, dropna=False, sort=False).ngroup().to_numpy()
    if (code[1:] < code[:-1]).any():
        order = np.argsort(code, kind="stable")
        batch, code = batch.iloc[order], code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    keys = batch[same].iloc[starts].itertuples(index=False, name=None)
    for key, lo, hi in zip(keys, starts, [*starts[1:], len(batch)]):
        yield tuple(None if pd.isna(v) else v for v in key), batch.iloc[lo:hi]


def score_frames(
    df: DataFrame, model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], out_schema: str, infer_every: int = 1,
    batch_size: int | None = None, same: list[str] | None = None, seconds: str | None = None,
) -> DataFrame:
    """Predictions for every ``infer_every``-th frame. The model is built once for each task and takes batches.

    Its result has the columns of ``out_schema``. Frames are scored where they are read, without a shuffle, unless there
    is ``same``. With ``batch_size`` a call gets so many rows, carried over from one Arrow batch to the next, and fewer
    only at the end of a partition; with ``same`` (such as the columns of ``crop_size``) its rows are equal in these
    columns, nulls among themselves, and rows are dealt to tasks by them (``dealt``; not on a stream), so that there is
    about one short call for each value. A task holds fewer than ``batch_size`` rows for each of at most 64 groups; beyond that the group that has waited longest is
    scored as it is. ``seconds`` names a column, added to the result: the time of a call, dealt evenly to its rows.
    """
    if infer_every < 1:
        raise ValueError("infer_every must be at least 1")
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if same and batch_size is None:
        raise ValueError("same needs a batch_size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, float]]:
        """Results of the calls, each with the seconds of one of its rows."""
        model = None

        def call(rows: pd.DataFrame) -> tuple[pd.DataFrame, float]:
            nonlocal model
            model = model or model_factory()
            began = time.perf_counter()
            out = model(rows.reset_index(drop=True))
            return out, (time.perf_counter() - began) / max(len(rows), 1)

        if batch_size is None:
            yield from map(call, batches)
            return
        waiting: dict[tuple, list[pd.DataFrame]] = {}  # what has waited longest comes first
        for batch in batches:
            fresh = []
            for key, part in alike(batch, same) if same else [((), batch)]:
                held = [*waiting.pop(key, []), part]
                n = sum(map(len, held))
                if n >= batch_size:
                    rows, whole = joined(held), n - n % batch_size
                    for at in range(0, whole, batch_size):
                        yield call(rows.iloc[at : at + batch_size])
                    held = [rows.iloc[whole:]]
                if n % batch_size:
                    waiting[key] = held
                    fresh.append(key)
            while len(waiting) > WAITING_SIZES:
                yield call(joined(waiting.pop(next(iter(waiting)))))
            for held in (waiting[key] for key in fresh if key in waiting):
                held[-1] = held[-1].copy()  # a slice would keep the rest of its batch in memory
        for held in waiting.values():
            yield call(joined(held))

    def handed_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Results of short calls in frames of some hundred rows; those of other types, such as a column of nulls, stay apart."""
        outs, spent, rows, kind = [], [], 0, None

        def together() -> pd.DataFrame:
            out = joined(outs, ignore_index=True)
            return out if seconds is None else out.assign(**{seconds: np.repeat(spent, [len(o) for o in outs])})

        for out, by_row in run(batches):
            now = (out.columns.tolist(), out.dtypes.tolist()) if same else None
            if outs and now != kind:
                yield together()
                outs, spent, rows = [], [], 0
            outs.append(out)
            spent.append(by_row)
            rows, kind = rows + len(out), now
            if rows >= HANDED_BACK or not same:
                yield together()
                outs, spent, rows = [], [], 0
        if outs:
            yield together()

    schema = out_schema if seconds is None else f"{out_schema}, {seconds} double"
    rows = df.where(F.col("frame_index") % infer_every == 0)
    if same and not df.isStreaming:
        rows = dealt(rows, same, batch_size)
    return rows.mapInPandas(handed_back, schema)


def bucketed(df: DataFrame) -> DataFrame:
    """Adds ``session_bucket``: sessions dealt to a fixed number of folders."""
    return df.withColumn("session_bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int"))


def write_poses(df: DataFrame, path: str, mode: str = "append") -> None:
    """Poses as Parquet in folders by session bucket, each file in the order of session and frame."""
    dealt = bucketed(df).repartition("session_bucket").sortWithinPartitions("session_bucket", "session_id", "frame_index")
    dealt.write.partitionBy("session_bucket").mode(mode).parquet(path)


def write_poses_stream(df: DataFrame, path: str, checkpoint: str):
    return bucketed(df).writeStream.partitionBy("session_bucket").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def write_session_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt not in ("parquet", "json"):
        raise ValueError("reports are written as parquet or json")
    df.write.format(fmt).mode(mode).save(path)
