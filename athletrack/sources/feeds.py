"""Feeds whose values must be decoded, a log of values as a streaming source, and clips of frames as a source.

Sources read through Arrow's file systems, so paths may be local or URIs that Arrow knows.
"""

from __future__ import annotations

import io
import re
import tarfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

_TAIL = 1 << 16
_ROWS = 10_000
_BYTES = 16 << 20


def decoded(feed: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The columns of ``schema`` from a feed's JSON values, ``malformed``, and the feed's other columns in the struct ``source``.

    ``malformed`` is the value itself where it is no object of the schema; its columns are null then, all of them. A
    null value has neither. Works on streams and tables alike, without a shuffle.
    """
    fields = StructType.fromDDL(schema).names
    if {"malformed", "source"} & set(fields) or "_unread" in fields:
        raise ValueError("malformed, source and _unread can't be columns of the schema")
    text = F.col(value).cast("string")
    parsed = F.from_json(text, f"{schema}, _unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    others = [c for c in feed.columns if c != value]
    source = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    rows = feed.select(parsed.alias("_parsed"), text.alias("_text"), source.alias("source"))
    # an empty value has no object and no error either
    bad = F.col("_text").isNotNull() & (F.col("_parsed").isNull() | F.col("_parsed._unread").isNotNull() | (F.trim("_text") == ""))
    return rows.select(*(F.when(~bad, F.col("_parsed").getField(f)).alias(f) for f in fields), F.when(bad, F.col("_text")).alias("malformed"), "source")


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


# --- a log of values


@dataclass
class Span(InputPartition):
    name: str
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    """Offsets are bytes by file, always at the end of a line: a value is read once it is whole."""

    def __init__(self, path: str, span: int):
        self.path, self.span = path, span

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = _opened(self.path)
        found = files.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        sized = {f.base_name: (f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and f.base_name[0] not in "._"}
        ends = {name: self._whole(files, path, size) for name, (path, size) in sorted(sized.items())}
        return {name: end for name, end in ends.items() if end}

    def _whole(self, files: arrow_fs.FileSystem, path: str, size: int) -> int:
        """The end of the last whole line."""
        with files.open_input_file(path) as f:
            end = size
            while end > 0:
                start = max(0, end - _TAIL)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Span]:
        for name, at in start.items():
            if end.get(name, 0) < at:
                raise ValueError(f"{name} is shorter than what has been read of it: a log only grows")
        return [Span(name, at, min(at + self.span, stop)) for name, stop in end.items() for at in range(start.get(name, 0), stop, self.span)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        """Lines that begin within the span, wherever they end."""
        files, root = _opened(self.path)
        with files.open_input_file(f"{root}/{partition.name}") as raw:
            at = max(0, partition.start - 1)
            raw.seek(at)
            lines = io.BufferedReader(_Raw(raw), 1 << 20)
            if partition.start:
                at += len(lines.readline())  # of the span before, or the line's end alone
            offsets, values = [], []
            while at < partition.end:
                line = lines.readline()
                if not line:
                    break
                offsets.append(at)
                values.append(line.rstrip(b"\r\n"))
                at += len(line)
                if len(values) == _ROWS:
                    yield self._batch(partition.name, offsets, values)
                    offsets, values = [], []
            if values:
                yield self._batch(partition.name, offsets, values)

    def _batch(self, name: str, offsets: list[int], values: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(offsets, pa.int64()), pa.array(values, pa.binary())], ["log", "offset", "value"])

    def commit(self, end: dict) -> None:
        pass


class _Raw(io.RawIOBase):
    """An Arrow file as a raw stream for buffered lines."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.file.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


class LogFolder(DataSource):
    """A folder of logs that grow by lines, such as the segments that a broker mirrors: (log, offset, value)."""

    @classmethod
    def name(cls) -> str:
        return "log_folder"

    def schema(self) -> str:
        return "log string, offset bigint, value binary"

    def streamReader(self, schema: StructType) -> LogReader:
        span = int(self.options.get("spanBytes", 64 << 20))
        if span < 1:
            raise ValueError("spanBytes must be at least 1")
        return LogReader(self.options["path"], span)


def read_log_stream(spark: SparkSession, path: str, span_bytes: int = 64 << 20) -> DataFrame:
    """(log, offset, value): lines of a folder of growing logs, each once, from where the checkpoint left off.

    A line without its end waits for it. Long logs are cut into spans of ``span_bytes`` for as many tasks. An empty or
    missing folder has no rows; a log that has become shorter stops the stream.
    """
    spark.dataSource.register(LogFolder)
    return spark.readStream.format("log_folder").option("path", path).option("spanBytes", str(span_bytes)).load()


# --- clips of frames

CLIPS = "session_id bigint, clip string, first_sequence bigint, started_at double, fps double"
FRAMES_OF_CLIPS = "session_id bigint, frame_index bigint, sequence bigint, captured_at double, decode_seconds double, content binary"
_FRAME = re.compile(r"(\d+)\.\w+$")


@dataclass
class Clips(InputPartition):
    rows: list[tuple]  # of the index, as in CLIPS


class ClipReader(DataSourceReader):
    """The clips of the index, dealt evenly to ``tasks`` partitions at most; sessions that a filter leaves out are not planned."""

    def __init__(self, path: str, tasks: int):
        self.path, self.tasks, self.sessions = path, tasks, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("session_id",):
                self.sessions = wanted if self.sessions is None else self.sessions & wanted
            else:
                yield f

    def partitions(self) -> list[Clips]:
        files, root = _opened(self.path)
        keep = None if self.sessions is None else ds.field("session_id").isin([s for s in self.sessions if s is not None])
        names = [c.split()[0] for c in CLIPS.split(", ")]
        table = ds.dataset(f"{root}/index", filesystem=files, format="parquet").to_table(columns=names, filter=keep)
        rows = [r for r in zip(*(c.to_pylist() for c in table.columns)) if r[1]]
        n = min(self.tasks, len(rows))
        return [Clips(rows[k * len(rows) // n : (k + 1) * len(rows) // n]) for k in range(n)] or [Clips([])]  # an index without clips

    def read(self, partition: Clips) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.path)
        held, size = [], 0
        for session, clip, first, started_at, fps in partition.rows:
            with files.open_input_stream(f"{root}/{clip}") as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                began, n = time.perf_counter(), 0
                for member in tar:
                    tar.members = []  # it would keep all that it has passed
                    number = _FRAME.search(member.name)
                    if not member.isfile() or not number:
                        continue
                    content = tar.extractfile(member).read()
                    seconds = time.perf_counter() - began
                    at = started_at + n / fps if started_at is not None and fps else None
                    held.append((session, int(number[1]), (first or 0) + n, at, seconds, content))
                    size += len(content)
                    if len(held) == _ROWS or size >= _BYTES:
                        yield self._batch(held)
                        held, size = [], 0
                    began, n = time.perf_counter(), n + 1
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in FRAMES_OF_CLIPS.split(", ")])


class ClipFolder(DataSource):
    """Clips of extracted frames: tar archives of <frame>.<ext>, and a table ``index`` of CLIPS."""

    @classmethod
    def name(cls) -> str:
        return "clip_folder"

    def schema(self) -> str:
        return FRAMES_OF_CLIPS

    def reader(self, schema: StructType) -> ClipReader:
        tasks = int(self.options.get("tasks", 200))
        if tasks < 1:
            raise ValueError("tasks must be at least 1")
        return ClipReader(self.options["path"], tasks)


def read_clips(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Frames of all clips, each with its bytes and the seconds it took to read it; a task reads its clips one after the other as streams, a frame at a time.

    Clips are dealt to ``tasks`` tasks at most (None: as many as a shuffle has partitions), so that many short clips cost no task each.

    ``sequence`` counts on from the clip's ``first_sequence`` (null: 0), captured_at from ``started_at`` by ``fps``, null where either is
    missing. A filter by session_id (``=`` or ``in``) reaches the index: clips of other sessions are never opened. Members that
    are no frames are passed over; an index without rows gives no frames. Only the clips of the index are known to
    the driver, a few numbers each.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClipFolder)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if tasks is None else tasks
    return spark.read.format("clip_folder").option("path", path).option("tasks", str(tasks)).load()


def write_clips(frames: DataFrame, path: str, fps: float) -> None:
    """(session_id, frame_index, content) as clips: one archive by session in order of frame_index, and their index.

    Each session's frames pass through one task as a stream; rows without a session, frame or content are left out. A
    task that runs again writes its archives anew, so speculative execution must be off.
    """
    rows = frames.where("session_id is not null and frame_index is not null and content is not null").select("session_id", "frame_index", "content")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(path)
        files.create_dir(root, recursive=True)
        held = tar = out = None
        made = []
        for batch in batches:
            for session, frame, content in zip(*(c.to_pylist() for c in batch.columns)):
                if session != held:
                    if tar is not None:
                        tar.close()
                        out.close()
                    held, clip = session, f"{session}.tar"
                    out = files.open_output_stream(f"{root}/{clip}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                    made.append((session, clip, 0, 0.0, float(fps)))
                info = tarfile.TarInfo(f"{frame}.bin")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
                tar.members = []  # it would keep all of them
        if tar is not None:
            tar.close()
            out.close()
        types = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64())
        columns = zip(*made) if made else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in CLIPS.split(", ")])

    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small partitions are not put together: the work is in the archives
    dealt = rows.repartition(n, "session_id").sortWithinPartitions("session_id", "frame_index")
    dealt.mapInArrow(put, CLIPS).write.mode("overwrite").parquet(f"{path}/index")


def values(df: DataFrame) -> DataFrame:
    """(value): rows as JSON, as a broker would carry them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
