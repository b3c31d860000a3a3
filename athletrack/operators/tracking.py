"""Replay of the tracker, and the greedy schedules of a session.

What happens next depends on what was accepted before, so these are folds: one narrow row for each frame, one small
loop for each session. Everything that needs keypoints or boxes is reduced to a few numbers by columns first, and
reports join the keypoints back afterwards. Sessions are dealt to partitions and sorted once; a task folds its
sessions one after the other as Arrow batches come in. The tracker's fold holds a frame and the state of its session,
however long it is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from athletrack.functions import geometry as g
from athletrack.operators.select import KEY, detection_rank, person_filter
from athletrack.schemas import CONFIG, CROP, TrackConfig

#: what the fold needs of a pose, as doubles in one array: plain numbers cross to Python fastest
INSTANCE = ("index", "area", "cx", "cy", "visible", "x1", "y1", "x2", "y2")
SIDES = ("x1", "y1", "x2", "y2")
TRACKS = f"session_id bigint, frame_index bigint, detection_reason string, submitted boolean, crop_before {CROP}, crop_after {CROP}, assess_reason string, frame_stage string, instance_index bigint, error string"
FLAT = "session_id bigint, frame_index bigint, detection_reason string, submitted boolean, " + ", ".join(f"{c}_{k} int" for c in ("before", "after") for k in SIDES) + ", assess_reason string, frame_stage string, instance_index bigint, error string"
FOLDED = ("session_id", "frame_index", "loop_started_at", "detector_seconds", "frame_width", "frame_height", "detector_error", "config", "rank", "det_index", "found", "person")
Crop = tuple[int, int, int, int]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def config_columns(config: TrackConfig, sessions: DataFrame) -> DataFrame:
    """(session_id, config): the fields of ``TrackConfig`` that ``sessions`` has as columns, the others from ``config``.

    A null takes the value of ``config``; a session with either of the two detector intervals has no other.
    """
    own = {f: F.col(f).cast(kind) if f in sessions.columns else F.lit(None).cast(kind) for f, kind in CONFIG.items()}
    scheduled = own["detector_interval"].isNotNull() | own["detector_interval_seconds"].isNotNull()
    values = {f: F.coalesce(c, F.lit(getattr(config, f)).cast(CONFIG[f])) for f, c in own.items()}
    for f in ("detector_interval", "detector_interval_seconds"):
        values[f] = F.when(scheduled, own[f]).otherwise(values[f])
    return sessions.select("session_id", F.struct(*(c.alias(f) for f, c in values.items())).alias("config"))


def fold_rows(frames: DataFrame, detections: DataFrame, poses: DataFrame, config: TrackConfig | None = None, sessions: DataFrame | None = None, inferred: bool = False) -> DataFrame:
    """What the fold needs: a row for each frame with its times, for each person's box with its rank and the crop around it, and for each pose with a few numbers.

    ``frames``: session_id, frame_index, loop_started_at, detector_seconds, frame_width, frame_height, and
    detector_error (optional): what a detection of this frame fails with. ``sessions`` may give a session its own
    configuration (``config_columns``). Nothing is shuffled here: the three inputs meet in the fold's one exchange.
    With ``inferred`` the boxes and poses of frames that ``infer_every`` passes over are not prepared: no fold looks at them.
    """
    config = config or TrackConfig()
    if sessions is None:
        setting: Callable[[str], object] = lambda f: getattr(config, f)
    else:
        of_session = config_columns(config, sessions)
        none = F.struct(*(F.lit(getattr(config, f)).cast(kind).alias(f) for f, kind in CONFIG.items()))
        frames, detections, poses = (df.join(of_session, "session_id", "left").withColumn("config", F.coalesce("config", none)) for df in (frames, detections, poses))
        setting = lambda f: F.col(f"config.{f}")
    if inferred:
        detections, poses = (df.where(F.col("frame_index") % setting("infer_every") == 0) for df in (detections, poses))
    error = F.col("detector_error") if "detector_error" in frames.columns else F.lit(None).cast("string")
    chosen = F.to_json("config") if sessions is not None else F.lit(None).cast("string")
    ranked = detection_rank(person_filter(detections, setting("detector_score_threshold"))).where(~F.isnan("rank"))
    crop = g.crop(*map(F.col, SIDES), F.col("frame_width"), F.col("frame_height"), setting("crop_margin"))
    found = F.when(F.col("crop").isNotNull(), F.array(*(F.col(f"crop.{k}") for k in SIDES))).alias("found")

    has, every, seen = F.col("bbox").isNotNull(), F.col("every"), F.col("seen")
    a = {k: F.when(has, F.col(f"bbox.{k}")).otherwise(every[k].cast("double")) for k in SIDES}
    w, h = a["x2"] - a["x1"], a["y2"] - a["y1"]
    area = F.when(has, F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))).otherwise(w * h)
    numbers = (F.col("instance_index"), area, (a["x1"] + a["x2"]) / 2, (a["y1"] + a["y2"]) / 2, seen["n"], *(seen[k] for k in SIDES))
    person = F.when((F.col("points") > 0) & (has | (every["n"] > 0)), F.array(*(c.cast("double") for c in numbers))).alias("person")

    def shown(least: Callable[[Column], Column]) -> Column:
        return F.filter("pairs", lambda p: least(p["scores"])).getField("keypoints")

    def measured(poses: DataFrame) -> DataFrame:
        kept = (*KEY, "instance_index", "bbox")
        paired = poses.select(*kept, F.size("keypoints").alias("points"), F.size("scores").alias("scored"), g.as_float(setting("score_threshold")).alias("least"), F.arrays_zip("keypoints", "scores").alias("pairs"))
        prominent = F.when(F.col("scored") == 0, F.col("pairs.keypoints")).otherwise(shown(lambda s: s.cast("double") > g.POSE_VISIBLE))
        parts = paired.select(*kept, "points", prominent.alias("prominent"), shown(lambda s: s >= F.col("least")).alias("seen"))
        return parts.select(*kept, "points", g.bounds(F.col("prominent")).alias("every"), g.bounds(F.col("seen")).alias("seen"))

    times = frames.select(*KEY, "loop_started_at", "detector_seconds", "frame_width", "frame_height", error.alias("detector_error"), chosen.alias("config"))
    # step by step, here and for poses: one expression with all uses of its parts makes code too large to be compiled
    boxes = ranked.select(*KEY, "rank", "det_index", crop.alias("crop")).select(*KEY, "rank", "det_index", found)
    if not inferred:  # a filter makes the keypoints once more where they are an expression; the batch folds pass over rows of nobody
        poses = poses.where(F.size("keypoints") > 0)
    people = measured(poses).select(*KEY, person)
    return times.unionByName(boxes, allowMissingColumns=True).unionByName(people, allowMissingColumns=True).select(*FOLDED)


def _crop(x1: float, y1: float, x2: float, y2: float, width: int, height: int, margin: float, size: tuple[float, float] | None = None) -> Crop | None:
    w, h = size or (x2 - x1, y2 - y1)
    mx, my = max(w, 1.0) * margin, max(h, 1.0) * margin
    made = max(0, math.floor(x1 - mx)), max(0, math.floor(y1 - my)), min(width, math.ceil(x2 + mx)), min(height, math.ceil(y2 + my))
    return made if made[2] > made[0] and made[3] > made[1] else None


class Tracker:
    """State of one session; ``step`` takes a frame and returns what was decided."""

    FIELDS = ("crop", "pending", "last_frame", "last_at", "waiting", "failed")

    def __init__(self, config: TrackConfig, state: tuple | None = None):
        self.config = config
        self.crop: Crop | None = None
        self.pending: str | None = None
        self.last_frame: float = -(config.detector_interval or 0)
        self.last_at = -math.inf
        self.waiting: tuple[float, Crop | None, str | None] | None = None  # when the outstanding result is there, its crop, its error
        self.failed = False  # nothing follows a failed detection
        if state is not None:
            self.crop, self.pending, self.last_frame, self.last_at, self.waiting, self.failed = state

    def state(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def _reason(self, frame: int, now: float) -> str | None:
        c = self.config
        if self.crop is None:
            return "missing_crop"
        if self.pending is not None:
            return self.pending
        due = now - self.last_at >= c.detector_interval_seconds if c.detector_interval_seconds else frame - self.last_frame >= c.detector_interval
        return "scheduled_interval" if due else None

    def _take(self, found: Crop | None) -> None:
        if found is not None:
            self.crop, self.pending = found, None

    @staticmethod
    def _person(people, box: Crop):
        """The most prominent person, seen from the middle of ``box``; the first wins ties."""
        x1, y1, x2, y2 = box
        best = None
        for p in people:
            away = math.hypot(p[2] - (x1 + x2) / 2, p[3] - (y1 + y2) / 2) / max(x2 - x1, y2 - y1)
            rank = p[1] / (1.0 + away)
            if not math.isnan(rank) and (best is None or rank > best[0]):
                best = rank, p
        return best and best[1]

    def _follow(self, p, width: int, height: int) -> None:
        c = self.config
        if p[4] < g.MIN_CROP_POINTS:
            return
        x1, y1, x2, y2 = p[5:]  # float bounds, so their differences are rounded to float
        target = _crop(x1, y1, x2, y2, width, height, c.crop_margin, (_float(x2 - x1), _float(y2 - y1)))
        if target is None:
            return
        size, mid = [], []
        for k in (0, 1):
            now, then = self.crop[k + 2] - self.crop[k], target[k + 2] - target[k]
            then = min(max(then, now * 0.85), now * 1.2)
            size.append((1 - c.tracking_alpha) * now + c.tracking_alpha * then)
            mid.append((1 - c.tracking_alpha) * ((self.crop[k] + self.crop[k + 2]) / 2) + c.tracking_alpha * ((target[k] + target[k + 2]) / 2))
        self.crop = _crop(mid[0] - size[0] / 2, mid[1] - size[1] / 2, mid[0] + size[0] / 2, mid[1] + size[1] / 2, width, height, 0.0) or self.crop

    def _assess(self, p, width: int, height: int) -> str | None:
        c = self.config
        if p is None:
            return "missing_pose"
        if p[4] < c.tracking_min_keypoints:
            return "low_keypoints"
        x1, y1, x2, y2 = self.crop
        left, top, right, bottom = p[5:]
        ex, ey = (x2 - x1) * c.redetect_edge, (y2 - y1) * c.redetect_edge
        hit = left <= x1 + ex and x1 > 0 or right >= x2 - ex and x2 < width or top <= y1 + ey and y1 > 0 or bottom >= y2 - ey and y2 < height
        return "crop_edge" if hit else None

    def step(self, frame: int, started: float, width: int, height: int, found: Crop | None, seconds: float, people, error: str | None = None) -> tuple:
        """(reason, submitted, crop before, crop after, assessed reason, stage, instance, error).

        A detection that fails ends the session: at once, or on the frame that would take its result.
        """
        c = self.config
        before = self.crop
        if c.mode != "hybrid":  # no crop to follow: the whole frame, with or without a detector
            if frame % c.infer_every:
                return None, False, None, None, None, "reuse", None, None
            ran = c.mode == "detector"
            self.failed = ran and error is not None
            person = None if self.failed else self._person(people, (0, 0, width, height))
            return None, ran, None, None, None, "failed" if self.failed else "detector" if ran else "pose", None if person is None else int(person[0]), error if self.failed else None
        if self.waiting is not None and self.waiting[0] <= started:
            (_, got, failure), self.waiting = self.waiting, None
            if failure is not None:
                self.failed = True
                return None, False, before, before, None, "failed", None, failure
            self._take(got)
            if self.crop is None:
                self.pending = "missing_crop"
        if frame % c.infer_every:
            return None, False, before, self.crop, None, "reuse", None, None
        reason, submitted, stage = self._reason(frame, started), False, "reuse"
        if reason is not None:
            if not c.async_detector:
                stage, submitted = "detector", True
                if error is not None:
                    self.failed = True
                    return reason, True, before, self.crop, None, "failed", None, error
                self._take(found)
            elif self.waiting is None:
                submitted, self.waiting = True, (started + seconds, found, error)
            if submitted:
                self.last_frame, self.last_at = frame, started
        if self.crop is None:
            self.pending = "missing_crop"
            return reason, submitted, before, None, "missing_crop", stage, None, None
        stage = "detector" if stage == "detector" else "pose"
        person = self._person(people, self.crop)
        if person is not None:
            self._follow(person, width, height)
        self.pending = self._assess(person, width, height)
        return reason, submitted, before, self.crop, self.pending, stage, None if person is None else int(person[0]), None


def _float(x: float) -> float:
    return float(np.float32(x))


@lru_cache(maxsize=10_000)
def _config(text: str) -> TrackConfig:
    known = json.loads(text)  # nulls are left out
    return TrackConfig(**{"detector_interval": None} | known if known.get("detector_interval_seconds") else known)


NOBODY = (None,) * 4


def frames_of(rows: dict[str, list]) -> Iterator[tuple]:
    """``frames_in`` of rows given as lists by column."""
    return frames_in(zip(*(rows[c] for c in FOLDED)))


def frames_in(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(frame, (time, width, height, seconds, error, session), found, people) of every frame of a session's ``fold_rows`` (tuples of FOLDED), in their order.

    A frame's box is the one with the largest rank, then the smallest det_index; boxes and poses without a row of
    their frame are left out, and a repeated frame counts once, with its last times.
    """
    frame, times, best, people = None, None, None, []
    for session, at, started, seconds, w, h, error, _, rank, index, found, person in chain(rows, [(None,) * len(FOLDED)]):
        if at != frame:
            if times is not None:
                people.sort()
                yield frame, times, best and best[2], people
            frame, times, best, people = at, None, None, []
        if rank is not None:
            if best is None or (rank, -index) > best[:2]:
                best = rank, -index, None if found is None else tuple(found)
        elif person is not None:
            people.append([math.nan if x is None else x for x in person])
        elif started is not None and (times is None or started > times[0]):
            times = started, w, h, 0.0 if seconds is None or math.isnan(seconds) else seconds, error, session


FRAME, BOX, POSE, NOTHING = range(4)  # kinds of rows
NUMBERS = tuple(f"n{i}" for i in range(len(INSTANCE)))
FLOWING = ("session_id", "frame_index", "kind", "detector_error", "config", *NUMBERS)


def flat_rows(rows: DataFrame, *others: Column | str) -> DataFrame:
    """``fold_rows`` as FLOWING (and ``others``): their kind and the numbers of that kind as nine doubles, as few plain columns cross to Python fastest.

    Of a frame loop_started_at, detector_seconds, frame_width and frame_height, of a box rank, det_index and the four sides of ``found``, of a pose the nine of ``person``.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    kind = F.when(known("rank"), BOX).when(F.col("person").isNotNull(), POSE).when(known("loop_started_at"), FRAME).otherwise(NOTHING).cast("tinyint")
    of_frame = [F.col(c) for c in ("loop_started_at", "detector_seconds", "frame_width", "frame_height")]
    of_box = [F.col("rank"), F.col("det_index"), *(F.get("found", i) for i in range(4))]
    numbers = []
    for i, name in enumerate(NUMBERS):
        number = F.when(F.col("kind") == POSE, F.get("person", i))
        for which, columns in ((FRAME, of_frame), (BOX, of_box)):
            number = number.when(F.col("kind") == which, columns[i].cast("double")) if i < len(columns) else number
        numbers.append(number.alias(name))
    return rows.withColumn("kind", kind).select(*FLOWING[:5], *numbers, *others)


def frames_from(rows: dict[str, np.ndarray], session: int | None, part: int = 5_000) -> Iterator[tuple]:
    """``frames_in`` of a session's ``flat_rows`` in any order, given as arrays by column, with NaN for null; ``part`` frames are Python values at once."""
    at, kind, numbers = rows["frame_index"], rows["kind"], [rows[c] for c in NUMBERS]

    def sorted_by(which: int, *columns: np.ndarray) -> np.ndarray:
        """Places of a kind's rows by frame and ``columns``; equal ones as they came."""
        places = np.flatnonzero(kind == which)
        return places[np.lexsort((*(c[places] for c in reversed(columns)), at[places]))]

    def first(places: np.ndarray) -> np.ndarray:
        return places[np.flatnonzero(np.r_[True, np.diff(at[places]) != 0][: len(places)])]

    def whole(values: np.ndarray) -> list:
        return values.astype(np.int64).tolist() if not np.isnan(values).any() else [None if math.isnan(v) else int(v) for v in values.tolist()]

    timed = first(sorted_by(FRAME, -numbers[0]))
    boxes = first(sorted_by(BOX, -numbers[0], numbers[1]))
    people = sorted_by(POSE)
    boxes_at, people_at = at[boxes], at[people]
    for lo in range(0, len(timed), part):
        places = timed[lo : lo + part]
        frames = at[places]
        low, high = np.searchsorted(boxes_at, (frames[0], frames[-1] + 1))
        some = boxes[low:high]
        some = some[~np.isnan(numbers[2][some])]
        found = dict(zip(at[some].tolist(), zip(*(whole(n[some]) for n in numbers[2:6]))))
        starts, ends = (np.searchsorted(people_at, frames, side) for side in ("left", "right"))
        persons = np.stack([n[people[starts[0] : ends[-1]]] for n in numbers], 1).tolist()
        seconds = numbers[1][places]
        times = zip(numbers[0][places].tolist(), whole(numbers[2][places]), whole(numbers[3][places]), np.where(np.isnan(seconds), 0.0, seconds).tolist(), rows["detector_error"][places].tolist())
        for frame, (started, width, height, delay, error), start, end in zip(frames.tolist(), times, (starts - starts[0]).tolist(), (ends - starts[0]).tolist()):
            yield frame, (started, width, height, delay, error if isinstance(error, str) else None, session), found.get(frame), sorted(persons[start:end]) if end > start else []


def stepped(tracker: Tracker, frame: int, times: tuple, found: Crop | None, people: list) -> tuple:
    """The flat row of a frame, after which ``tracker`` is in its next state."""
    reason, sent, before, after, assessed, stage, instance, failure = tracker.step(frame, *times[:3], found, times[3], people, times[4])
    return times[5], frame, reason, sent, *(before or NOBODY), *(after or NOBODY), assessed, stage, instance, failure


def track_rows(rows: dict[str, list], tracker: Tracker) -> list[tuple]:
    """Flat tracks of a session from its ``fold_rows`` in order of frame_index."""
    return [stepped(tracker, *frame) for frame in frames_of(rows) if not tracker.failed]


def tracks(flat: DataFrame) -> DataFrame:
    """Crops as structs."""
    crop = lambda c: F.when(F.col(f"{c}_x1").isNotNull(), F.struct(*(F.col(f"{c}_{k}").alias(k) for k in SIDES))).alias(f"crop_{c}")
    return flat.select(*KEY, "detection_reason", "submitted", crop("before"), crop("after"), "assess_reason", "frame_stage", "instance_index", "error")


def folded(df: DataFrame, order: list[str], fold: Callable[[dict[str, list]], list[tuple]], schema: str, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """What ``fold`` makes of the rows of each session (or other group), given as lists by column in ``order``.

    One exchange and one sort; a task takes its sessions from the batches one by one, so small sessions cost no call
    and no frame of their own. A session's numbers are in memory together; ``flowing`` has a fold that needs only its state.
    """

    def whole(parts: Iterator[dict[str, list]]) -> list[tuple]:
        held = next(parts)
        for part in parts:
            for n, c in part.items():
                held[n] += c
        return fold(held) if held[by[0]] else []

    return flowing(df, order, whole, schema, by)


def listed(column: pa.Array) -> list:
    """``to_pylist`` of numbers and of lists of numbers, without an object of Arrow for each value."""
    kind, n = column.type, len(column)
    if column.null_count == n:
        return [None] * n
    if pa.types.is_list(kind):
        values, sizes = listed(column.flatten()), column.value_lengths().fill_null(0).to_numpy().tolist()
        ends = accumulate(sizes)
        out = [values[end - size : end] for size, end in zip(sizes, ends)]
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind):
        out = column.fill_null(0).to_numpy().tolist()
    else:
        return column.to_pylist()
    if column.null_count:
        out = [v if there else None for v, there in zip(out, column.is_valid().to_numpy(zero_copy_only=False).tolist())]
    return out


def flowing(df: DataFrame, order: list[str], fold: Callable[[Iterator[dict[str, list]]], Iterable[tuple]], schema: str, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``folded`` for a fold that takes the rows of a group part by part, as Arrow batches come in, and gives its own one by one.

    A task holds a batch, the rows given since the last batch it made, and what the fold keeps.
    """
    names, fields = df.columns, StructType.fromDDL(schema).fields
    out_schema = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in fields])
    places = [names.index(b) for b in by]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out_schema.types)], schema=out_schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [listed(c) for c in batch.columns]
            ids = list(zip(*(columns[k] for k in places)))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield ids[lo], {n: c[lo:hi] for n, c in zip(names, columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, group in groupby(parts(batches), key=lambda part: part[0]):
            for row in fold(rows_of for _, rows_of in group):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    # by a hash of its own: an exchange by session_id is left out where inputs of a union seem to have it already, though
    # their partitions may be changed while they run
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small partitions are not put together: the work is in the fold
    return df.repartition(n, F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def track_sessions(frames: DataFrame, detections: DataFrame, poses: DataFrame, config: TrackConfig | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Replay of every session; a session's frames are folded in one task, as they come in, and sessions are independent.

    ``sessions`` may give each its own configuration. The row of a frame whose detection failed has the stage failed
    and its error; no row of the session follows it.
    """
    config = config or TrackConfig()

    def fold(parts: Iterator[dict[str, list]]) -> Iterator[tuple]:
        chosen = tracker = None

        def rows() -> Iterator[tuple]:
            nonlocal chosen
            for part in parts:
                if chosen is None:  # every row of a frame has it, so it is there before the first frame is whole
                    chosen = next((c for c in part["config"] if c is not None), None)
                yield from zip(*(part[c] for c in FOLDED))

        for frame in frames_in(rows()):
            tracker = tracker or Tracker(config if chosen is None else _config(chosen))
            if tracker.failed:
                return
            yield stepped(tracker, *frame)

    return tracks(flowing(fold_rows(frames, detections, poses, config, sessions, inferred=True), ["frame_index"], fold, FLAT))


def detection_schedule(df: DataFrame, interval: int | None = 30, seconds: float | None = None) -> DataFrame:
    """Adds ``detection_reason`` to inferred frames that have (session_id, frame_index, checked_at, has_crop, pending, accepts).

    A missing crop comes first (a null counts as missing), then the pending reason, then the schedule, whose clocks
    restart at each accepted run. A frame without the time or index that the schedule goes by is never due by it and
    leaves its clock.
    """
    if (interval is None) == (seconds is None):
        raise ValueError("exactly one of interval and seconds is needed")
    names = ["session_id", "frame_index", "checked_at", "has_crop", "pending", "accepts"]

    def fold(rows: dict[str, list]) -> list[tuple]:
        last_frame, last_at, out = -(interval or 0), -math.inf, []
        for row in zip(*(rows[n] for n in names)):
            _, frame, at, has_crop, pending, accepts = row
            timed = seconds is not None
            due = (at is not None and at - last_at >= seconds) if timed else (frame is not None and frame - last_frame >= interval)
            reason = "missing_crop" if not has_crop else pending if pending is not None else "scheduled_interval" if due else None
            if reason is not None and accepts:
                last_frame, last_at = last_frame if frame is None else frame, last_at if at is None else at
            out.append((*row, reason))
        return out

    return folded(df.select(*names), ["frame_index"], fold, "session_id bigint, frame_index bigint, checked_at double, has_crop boolean, pending string, accepts boolean, detection_reason string")


def single_flight(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """(session_id, request_id, requested_at, inference_seconds, accepted, consumed_at) for every request.

    One request at a time: the next is admitted once the result of the one before has been taken, on the first
    frame that starts when it is there. Requests made in between are refused, not queued. A request without a duration
    never gets a result: it is accepted, stays outstanding, and all later ones are refused. One without a time is
    refused, and a frame without one takes nothing.
    """
    empty = F.lit(None)
    both = requests.select("session_id", "request_id", F.col("requested_at").alias("at"), "inference_seconds", F.lit(1).alias("kind")).unionByName(
        frames.select("session_id", empty.cast("bigint").alias("request_id"), F.col("loop_started_at").alias("at"), empty.cast("double").alias("inference_seconds"), F.lit(0).alias("kind"))
    )

    def fold(rows: dict[str, list]) -> list[tuple]:
        ask = np.array(rows["kind"], bool)
        at = np.array(rows["at"], float)
        there = ~np.isnan(at)
        polls, asked = at[~ask & there], at[ask & there]
        mine = [(i, t, s) for i, t, s, k in zip(rows["request_id"], rows["at"], rows["inference_seconds"], rows["kind"]) if k]
        timed = np.flatnonzero(there[ask]).tolist()  # places in mine of the requests that have a time
        took: dict[int, float | None] = {}
        k = 0
        while k < len(asked):  # from one accepted request straight to the next
            spent = mine[timed[k]][2]
            p = len(polls) if spent is None or math.isnan(spent) else np.searchsorted(polls, asked[k] + spent)
            took[timed[k]] = got = float(polls[p]) if p < len(polls) else None
            if got is None:
                break
            k = max(k + 1, int(np.searchsorted(asked, got)))
        return [(rows["session_id"][0], *row, j in took, took.get(j)) for j, row in enumerate(mine)]

    return folded(both, ["at", "kind", "request_id"], fold, "session_id bigint, request_id bigint, requested_at double, inference_seconds double, accepted boolean, consumed_at double")


TICKS = (
    "session_id bigint, frame_index bigint, tick_at double, poses bigint, pose_fps double, processed bigint, processed_fps double, captured bigint, skipped bigint, drop_pct double, "
    "age_p50 double, age_p95 double, pose_mean double, lag bigint"
)


def status_ticks(frame_log: DataFrame, sessions: DataFrame, interval: float = 2.0, ages: int = 120, poses: int = 60) -> DataFrame:
    """Status rows: one where ``interval`` has passed since the last one.

    The clock restarts at the frame that ticks, so ticks drift; ``sessions`` may have its own ``status_interval``. Poses
    are counted since the last tick, ``processed_fps`` since the start; captured, skipped and drop_pct are running totals;
    ages are percentiles of the last ``ages`` frames and ``pose_mean`` the mean of the last ``poses`` pose times,
    the frame itself included; ``lag`` is the frame's own. Figures whose columns ``frame_log`` lacks are null. A frame
    without ``completed_at`` is counted and never ticks; a session without ``started_at`` has no clock and no ticks.
    """
    if interval <= 0:
        raise ValueError("interval must be positive")
    own = F.coalesce("status_interval", F.lit(float(interval))) if "status_interval" in sessions.columns else F.lit(float(interval))
    missing = lambda c, kind: F.col(c) if c in frame_log.columns else F.lit(None).cast(kind)
    rows = frame_log.join(sessions.select("session_id", "started_at", own.cast("double").alias("interval")), "session_id").select(
        "session_id", "frame_index", "completed_at", "started_at", "interval", (F.col("has_player") & (F.col("frame_stage") != "reuse")).alias("posed"),
        *(missing(c, kind).cast(kind).alias(c) for c, kind in (("frame_age", "double"), ("pose_seconds", "double"), ("sequence", "bigint"), ("latest_sequence", "bigint"))), F.coalesce(missing("dropped", "bigint"), F.lit(0)).cast("bigint").alias("dropped"),
    )

    def fold(rows: dict[str, list]) -> list[tuple]:
        if rows["started_at"][0] is None:
            return []
        at = np.array(rows["completed_at"], float)
        at[np.isnan(at)] = -math.inf
        reached, posed = np.maximum.accumulate(at), np.cumsum(np.array(rows["posed"], bool))
        age, dropped = np.array(rows["frame_age"], float), np.cumsum(rows["dropped"])
        spent = np.array(rows["pose_seconds"], float)
        some = np.flatnonzero(~np.isnan(spent))
        start, every, session = rows["started_at"][0], rows["interval"][0], rows["session_id"][0]
        last, seen, out, i = start, 0, [], 0
        while True:
            # times may go back: what reached the limit before i did so before the last tick, so look for the first at or after i
            k = max(i, int(np.searchsorted(reached, last + every)))
            while k < len(at) and at[k] - last < every:
                k += 1
            if k >= len(at):
                return out
            n, newest, taken = k + 1, rows["latest_sequence"][k], rows["sequence"][k]
            captured = None if newest is None else newest + 1
            skipped = int(dropped[k]) if captured is None else max(int(dropped[k]), captured - n)
            recent = age[max(0, n - ages) : n]
            recent = recent[~np.isnan(recent)]
            p50, p95 = (float(np.percentile(recent, q)) for q in (50, 95)) if len(recent) else (None, None)
            posing = spent[some[: np.searchsorted(some, n)][-poses:]]
            lived = at[k] - start
            out.append((
                session, rows["frame_index"][k], float(at[k]), int(posed[k] - seen), float((posed[k] - seen) / (at[k] - last)), n, float(n / lived) if lived > 0 else 0.0, captured, skipped,
                None if captured is None else 100.0 * skipped / max(captured, 1), p50, p95, float(posing.mean()) if len(posing) else None, None if newest is None or taken is None else max(0, newest - taken),
            ))
            last, seen, i = at[k], posed[k], k + 1

    return folded(rows, ["frame_index"], fold, TICKS)
