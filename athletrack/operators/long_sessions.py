"""Long sessions in many tasks: a speculative parallel fold of the tracker.

A session is cut into pieces of frames. Each piece is folded at once from assumed states: a tracker that knows
nothing, and one with the crop of the piece's first detection whose schedule has run undisturbed since the session
began. Then the real state is handed over: a piece whose predecessor ends in another state than was assumed is folded
again from that state, next to the runs that it has, and only up to the frame where it is in the state of one of
them; from there on that run's rows and its end hold. As most meet soon, the first eighth of a piece is tried first, and
only pieces that meet none in it are folded again as a whole. This is repeated until no piece has a new beginning. The
first piece is right from the start, so each round settles one piece more at least, and usually all.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athletrack.operators.tracking import FLAT, FOLDED, Tracker, _config, fold_rows, folded, frames_of, stepped, tracks
from athletrack.schemas import TrackConfig
from athletrack.sources.shared import stored

RUNS = "piece bigint, run bigint, beginning string, ending string, parent bigint, met bigint, frames bigint"
GROUP = ("session_id", "piece")
SMALL = 200_000  # pieces that are broadcast; beyond it their rows are joined by shuffle
KNOWS_NOTHING, GUESSED, HANDED = 0, 1, 2  # runs of a piece; later ones have larger numbers


def _matters(t: Tracker) -> tuple | str:
    """What of a state matters for the frames to come: equal values, equal rows from here on."""
    if t.failed:
        return "failed"
    timed = t.config.detector_interval_seconds is not None
    return t.crop, t.pending, None if timed else t.last_frame, t.last_at if timed else None, t.waiting


def _text(t: Tracker) -> str:
    return json.dumps(_matters(t))


def _tracker(config: TrackConfig, text: str) -> Tracker:
    known = json.loads(text)
    if known == "failed":
        return Tracker(config, (None, None, 0, 0.0, None, True))
    crop, pending, frame, at, waiting = known
    if waiting is not None:
        waiting = waiting[0], waiting[1] and tuple(waiting[1]), waiting[2]
    return Tracker(config, (crop and tuple(crop), pending, 0 if frame is None else frame, 0.0 if at is None else at, waiting, False))


def _guess(config: TrackConfig, frames: list[tuple], began: float) -> Tracker:
    """In the middle of a calm session that ``began`` then: the piece's first box, last detected where an undisturbed schedule would have."""
    found = next((found for _, _, found, _ in frames if found is not None), None)
    first, times = frames[0][:2]
    every, seconds = config.detector_interval or 1, config.detector_interval_seconds or 1.0
    last_at = began + max(math.ceil((times[0] - began) / seconds) - 1, 0) * seconds
    return Tracker(config, (found, None, (first - 1) // every * every, last_at, None, False))


def _together(frames: list[tuple], runs: list[tuple[int, Tracker, int | None]]) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Rows (run, row) of the last of ``runs`` (number, tracker, frame where it is known to meet another), side by side with the others.

    It is folded up to the frame at whose end its state is that of another run that is still on its own; runs that met
    one before are left there. The second value has what it met: {run: (parent, frame)}.
    """
    number, last, _ = runs[-1]
    others, out = runs[:-1], []
    for frame in frames:
        if not last.failed:
            out.append((number, stepped(last, *frame)))
        for _, tracker, _ in others:
            if not tracker.failed:
                stepped(tracker, *frame)
        others = [r for r in others if r[2] is None or frame[0] < r[2]]
        now = _matters(last) if others else None
        parent = next((k for k, tracker, _ in others if _matters(tracker) == now), None)
        if parent is not None:
            return out, {number: (parent, frame[0])}
    return out, {}


def _folds(config: TrackConfig, rows: dict[str, list]) -> list[tuple]:
    """Rows of tracks and of runs of one piece: (FLAT..., piece, run, beginning, ending, parent, met, frames).

    Of a part of a piece there are none unless what was asked for meets another run in it.
    """
    session, piece = rows["session_id"][-1], rows["piece"][-1]
    asked = next((t for t in rows["asked"] if t is not None), None)
    own = next((c for c in rows["config"] if c is not None), None)
    config = config if own is None else _config(own)
    frames = list(frames_of(rows))
    none = (None,) * 13
    out: list[tuple] = []

    def add(number: int, tracker: Tracker, known: list[dict], part: bool = False) -> dict | None:
        beginning = _text(tracker)
        beside = [(k["run"], _tracker(config, k["beginning"]), k.get("met")) for k in known]
        made, met = _together(frames, [*beside, (number, tracker, None)])
        parent, at = met.get(number, (None, None))
        if part and parent is None:
            return None
        ending = next(k["ending"] for k in known if k["run"] == parent) if parent is not None else _text(tracker)
        out.extend((*row, piece, run, None, None, None, None, None) for run, row in made)
        run = {"run": number, "beginning": beginning, "ending": ending, "parent": parent, "met": at}
        out.append((session, None, *none[:-1], None, None, piece, number, beginning, ending, parent, at, len(frames) if at is None else sum(f[0] <= at for f in frames)))
        return run

    if asked is not None:
        todo = json.loads(asked)
        add(todo["run"], _tracker(config, todo["beginning"]), todo["known"], todo["part"])
    elif frames:
        known = [add(KNOWS_NOTHING, Tracker(config), [])]
        if rows["first"][-1] is False:
            add(GUESSED, _guess(config, frames, rows["began"][-1]), known)
    return out


@dataclass(frozen=True)
class LongFold:
    """``tracks`` as of ``track_sessions``; ``runs``: what was folded of each piece."""

    tracks: DataFrame
    runs: DataFrame

    def report(self) -> DataFrame:
        """(session_id, pieces, frames, guessed, refolded, rounds): frames folded from a guess, and folded again after a hand-over."""
        part = lambda c: F.coalesce(F.sum(F.when(c, F.col("frames"))), F.lit(0))
        run = F.col("run")
        return self.runs.groupBy("session_id").agg(F.countDistinct("piece").alias("pieces"), part(run == KNOWS_NOTHING).alias("frames"), part(run == GUESSED).alias("guessed"), part(run >= HANDED).alias("refolded"), F.greatest(F.max("run") - 1, F.lit(0)).alias("rounds"))


def _covers(rows: dict[str, list]) -> list[tuple]:
    """The frames [lo, hi) that each run of a piece gives to its tracks."""
    runs = {run: (parent, met) for run, parent, met in zip(rows["run"], rows["parent"], rows["met"])}
    at, lo, out = max(runs), -(1 << 62), []
    while True:
        parent, met = runs[at]
        out.append((rows["session_id"][0], rows["piece"][0], at, lo, 1 << 62 if met is None else met + 1))
        if met is None:
            return out
        at, lo = parent, max(lo, met + 1)


def _few(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.limit(SMALL + 1).count() <= SMALL else few


def track_long_sessions(frames: DataFrame, detections: DataFrame, poses: DataFrame, config: TrackConfig | None = None, sessions: DataFrame | None = None, piece: int = 10_000) -> LongFold:
    """``track_sessions`` where a session of any length is folded in pieces of ``piece`` frames, each in a task of its own.

    The tracks are those of ``track_sessions``, row by row. A session shorter than a piece is folded once. The rows of
    the fold are written once; each round reads those of the first frames of the pieces that get a new beginning, and all
    of the few that need them.
    """
    if piece < 1:
        raise ValueError("piece must be at least 1")
    config = config or TrackConfig()
    rows = fold_rows(frames, detections, poses, config, sessions, inferred=True).withColumn("piece", F.floor(F.col("frame_index") / piece))
    rows = stored(rows, "long-rows")
    firsts = stored(rows.where("loop_started_at is not null").groupBy("session_id").agg(F.min("piece").alias("first_piece"), F.min("loop_started_at").alias("began")), "long-firsts")
    schema = FLAT + ", " + RUNS
    fold = lambda held: _folds(config, held)

    def made(of: DataFrame) -> DataFrame:
        return stored(folded(of, ["frame_index"], fold, schema, GROUP), "long-folds")

    none = F.lit(None)
    whole = rows.join(_few(firsts), "session_id").select(*FOLDED, "piece", (F.col("piece") <= F.col("first_piece")).alias("first"), "began", none.cast("string").alias("asked"))

    def again(todo: DataFrame, of: DataFrame, number: int, part: bool) -> DataFrame:
        asked = F.to_json(F.struct(F.lit(number).alias("run"), "beginning", "known", F.lit(part).alias("part"))).alias("asked")
        held = of.join(_few(todo.select(*GROUP)), list(GROUP), "left_semi").unionByName(todo.select(*GROUP, asked), allowMissingColumns=True)
        return made(held.withColumn("first", none.cast("boolean")).withColumn("began", none.cast("double")).select(*FOLDED, "piece", "first", "began", "asked"))

    folds = made(whole)
    number = HANDED
    while True:
        runs = folds.where("beginning is not null")
        known = F.sort_array(F.collect_list(F.struct("run", "beginning", "ending", "parent", "met")))
        pieces = runs.groupBy(*GROUP).agg(known.alias("known"), F.max_by(F.struct("beginning", "ending"), "run").alias("now"))
        # a piece that knows the real beginning has it as its last run's
        order = F.lag(F.col("now.ending")).over(Window.partitionBy("session_id").orderBy("piece"))
        todo = pieces.withColumn("real", order).where("real is not null and real <> now.beginning")
        todo = stored(todo.select(*GROUP, F.col("real").alias("beginning"), "known"), "long-todo")
        if todo.isEmpty():
            break
        tried = again(todo, rows.where(F.col("frame_index") < F.col("piece") * piece + max(piece // 8, 1)), number, True)
        folds = folds.unionByName(tried)
        rest = stored(todo.join(tried.where("beginning is not null").select(*GROUP), list(GROUP), "left_anti"), "long-todo")
        if not rest.isEmpty():
            folds = folds.unionByName(again(rest, rows, number, False))
        number += 1
    runs = stored(folds.where("beginning is not null").select("session_id", *(c.split()[0] for c in RUNS.split(", "))), "long-runs")
    covers = folded(runs.select(*GROUP, "run", "parent", "met"), ["run"], _covers, "session_id bigint, piece bigint, run bigint, lo bigint, hi bigint", GROUP)
    covers = stored(covers, "long-covers")
    flat = folds.where("beginning is null").join(_few(covers), [*GROUP, "run"]).where("frame_index >= lo and frame_index < hi")
    return LongFold(tracks(flat), runs)
