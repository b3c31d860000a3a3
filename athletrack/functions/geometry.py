"""Boxes, crops and keypoints as columns; no function here shuffles or leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from athletrack.schemas import BONES, JOINTS, SIDES

MIN_CROP_POINTS = 4
POSE_VISIBLE = 0.2


def double(c: Column) -> Column:
    return c.cast("double")


def as_float(value: float | Column) -> Column:
    return F.lit(value).cast("float")


def visible(keypoints: Column, scores: Column, threshold: float | Column) -> Column:
    """(x, y, score, index) of the keypoints with a score of the threshold or more, compared as float."""
    points = F.transform(keypoints, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.get(scores, i).alias("score"), i.alias("index")))
    return F.filter(points, lambda p: p["score"] >= as_float(threshold))


def bounds(points: Column) -> Column:
    """Struct (n, x1, y1, x2, y2) over an array of points; the coordinates are null if it is empty."""
    xs, ys = points.getField("x"), points.getField("y")  # of all points at once, without a call for each
    return F.struct(F.size(points).alias("n"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float | Column) -> Column:
    """The box grown by ``margin`` of its size on each side and cut to the frame; null if nothing is left.

    Sizes are taken in the type of the coordinates and are 1 at least.
    """
    mx = F.greatest(double(x2 - x1), F.lit(1.0)) * F.lit(margin).cast("double")
    my = F.greatest(double(y2 - y1), F.lit(1.0)) * F.lit(margin).cast("double")
    a = F.greatest(F.lit(0), F.floor(double(x1) - mx).cast("int"))
    b = F.greatest(F.lit(0), F.floor(double(y1) - my).cast("int"))
    c = F.least(width, F.ceil(double(x2) + mx).cast("int"))
    d = F.least(height, F.ceil(double(y2) + my).cast("int"))
    known = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(known & (c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def crop_around_box(box: Column, width: Column, height: Column, margin: float) -> Column:
    return crop(box["x1"], box["y1"], box["x2"], box["y2"], width, height, margin)


def distance_weight(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """1 + distance of the point from the frame's centre, in units of the frame's longer side."""
    dx, dy = cx - double(width) / 2, cy - double(height) / 2
    return 1 + F.sqrt(dx * dx + dy * dy) / double(F.greatest(width, height))


def joint_name(index: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, JOINTS)), index), index.cast("string"))


def bones() -> Column:
    return F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in BONES))


def touches(x: Column, y: Column, box: Column, fraction: float) -> dict[str, Column]:
    """Whether a point lies in the band along each side of the crop, bounds included."""
    ex = double(box["x2"] - box["x1"]) * F.lit(float(fraction))
    ey = double(box["y2"] - box["y1"]) * F.lit(float(fraction))
    x, y = double(x), double(y)
    return {"left": x <= double(box["x1"]) + ex, "right": x >= double(box["x2"]) - ex, "top": y <= double(box["y1"]) + ey, "bottom": y >= double(box["y2"]) - ey}


def hits(points: Column, box: Column, fraction: float) -> Column:
    """(joint, edge, confidence) for every point and side it touches, by point, then left, right, top, bottom."""

    def of(p: Column) -> Column:
        by_side = touches(p["x"], p["y"], box, fraction)
        made = [F.when(by_side[s], F.struct(joint_name(p["index"]).alias("joint"), F.lit(s).alias("edge"), double(p["score"]).alias("confidence"))) for s in SIDES]
        return F.array_compact(F.array(*made))

    return F.flatten(F.transform(points, of))


def clamped(box: Column, width: Column, height: Column) -> Column:
    """Sides on which the crop ends at the frame."""
    tests = (box["x1"] <= 0, box["x2"] >= width, box["y1"] <= 0, box["y2"] >= height)
    return F.array_compact(F.array(*(F.when(t, F.lit(s)) for s, t in zip(SIDES, tests))))


def assessment(has_pose: Column, points: Column, box: Column, width: Column, height: Column, min_keypoints: int, fraction: float) -> Column:
    """Struct (reason, edge_hits, clamped_edges, clamped_only_suppressed)."""
    few = ~has_pose | (F.size(points) < min_keypoints)
    none = F.array().cast("array<struct<joint:string,edge:string,confidence:double>>")
    found = F.when(few, none).otherwise(hits(points, box, fraction))
    sides = F.when(few, F.array().cast("array<string>")).otherwise(clamped(box, width, height))
    actionable = F.exists(found, lambda h: ~F.array_contains(sides, h["edge"]))
    reason = F.when(~has_pose, "missing_pose").when(few, "low_keypoints").when(actionable, "crop_edge")
    return F.struct(reason.alias("reason"), found.alias("edge_hits"), sides.alias("clamped_edges"), ((F.size(found) > 0) & ~actionable).alias("clamped_only_suppressed"))


def smoothed(current: Column, target: Column, width: Column, height: Column, alpha: float) -> Column:
    """One smoothing step of a crop towards another."""
    size, centre = {}, {}
    for a, lo, hi in (("x", "x1", "x2"), ("y", "y1", "y2")):
        now, then = double(current[hi] - current[lo]), double(target[hi] - target[lo])
        then = F.least(F.greatest(then, now * F.lit(0.85)), now * F.lit(1.2))
        mid_now, mid_then = double(current[lo] + current[hi]) / 2, double(target[lo] + target[hi]) / 2
        size[a] = F.lit(1 - alpha) * now + F.lit(alpha) * then
        centre[a] = F.lit(1 - alpha) * mid_now + F.lit(alpha) * mid_then
    made = crop(centre["x"] - size["x"] / 2, centre["y"] - size["y"] / 2, centre["x"] + size["x"] / 2, centre["y"] + size["y"] / 2, width, height, 0.0)
    return F.coalesce(made, current)
