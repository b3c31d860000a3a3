"""From raw predictions to the main player of every frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athletrack.functions import geometry as g

KEY = ("session_id", "frame_index")


def flatten_instances(df: DataFrame) -> DataFrame:
    """One row for each instance of the first prediction; missing or empty predictions give none."""
    return df.select(*[c for c in df.columns if c != "predictions"], F.posexplode(F.get("predictions", F.lit(0))).alias("instance_index", "instance"))


def instance_bbox(df: DataFrame) -> DataFrame:
    """Adds ``box``: the first four numbers of ``bbox``, else of ``bboxes``; null if both are missing."""
    flat = F.flatten(F.coalesce(F.col("instance.bbox"), F.col("instance.bboxes")))
    names = ("x1", "y1", "x2", "y2")
    return df.withColumn("box", F.when(F.size(flat) >= 4, F.struct(*(F.get(flat, F.lit(i)).alias(n) for i, n in enumerate(names)))))


def flatten_detections(df: DataFrame) -> DataFrame:
    """One row for each box of the parallel arrays, up to the shortest."""
    n = F.least(F.size("prediction.bboxes"), F.size("prediction.scores"), F.size("prediction.labels"))
    zipped = F.slice(F.arrays_zip("prediction.bboxes", "prediction.scores", "prediction.labels"), F.lit(1), F.greatest(n, F.lit(0)))
    rows = df.select(*[c for c in df.columns if c != "prediction"], F.posexplode(zipped).alias("det_index", "d"))
    box = [F.get("d.bboxes", F.lit(i)).alias(name) for i, name in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select(*[c for c in rows.columns if c not in ("d", "det_index")], F.col("det_index").cast("bigint"), *box, F.col("d.scores").alias("score"), F.col("d.labels").alias("label"))


def person_filter(df: DataFrame, threshold: float | Column = 0.3) -> DataFrame:
    return df.where((F.col("label") == 0) & (F.col("score").cast("double") >= threshold))


def detection_rank(df: DataFrame) -> DataFrame:
    """Adds ``rank``: area times score, less the farther the box is from the frame's centre."""
    w, h = g.double(F.col("x2") - F.col("x1")), g.double(F.col("y2") - F.col("y1"))
    cx, cy = g.double(F.col("x1") + F.col("x2")) / 2, g.double(F.col("y1") + F.col("y2")) / 2
    area = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    return df.withColumn("rank", area * g.double(F.col("score")) / g.distance_weight(cx, cy, F.col("frame_width"), F.col("frame_height")))


def select_player_bbox(detections: DataFrame, threshold: float = 0.3, frames: DataFrame | None = None) -> DataFrame:
    """The best person of each frame; the first wins ties. With ``frames``, frames without one stay, with nulls.

    ``max_by`` is combined before the shuffle, so a frame costs one row a task.
    """
    ranked = detection_rank(person_filter(detections, threshold)).where(~F.isnan("rank"))
    value = F.struct("det_index", "x1", "y1", "x2", "y2", "score", "frame_width", "frame_height", "rank")
    best = ranked.groupBy(*KEY).agg(F.max_by(value, F.struct("rank", -F.col("det_index"))).alias("b")).select(*KEY, "b.*")
    return best if frames is None else frames.select(*KEY).join(best, list(KEY), "left")


def pose_rank(df: DataFrame) -> DataFrame:
    """Adds ``rank``; rows without keypoints, or with none visible and no box, are left out.

    The area is the box's, else that of the visible keypoints (all of them if there are no scores).
    """
    shown = F.when(F.size("scores") == 0, F.col("keypoints")).otherwise(
        F.filter("keypoints", lambda p, i: F.get("scores", i).cast("double") > g.POSE_VISIBLE)
    )
    wide = F.transform(shown, lambda p: F.struct(g.double(p["x"]).alias("x"), g.double(p["y"]).alias("y")))
    rows = df.where(F.size("keypoints") > 0).withColumn("_b", g.bounds(wide)).where((F.col("_b.n") > 0) | F.col("bbox").isNotNull())
    has = F.col("bbox").isNotNull()
    box = {k: F.when(has, F.col(f"bbox.{k}")).otherwise(F.col(f"_b.{k}")) for k in ("x1", "y1", "x2", "y2")}
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    area = F.when(has, F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)).otherwise(w * h)
    weight = g.distance_weight((box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2, F.col("frame_width"), F.col("frame_height"))
    return rows.withColumn("rank", area / weight).drop("_b")


def select_player(poses: DataFrame) -> DataFrame:
    """The best instance of each frame; the first wins ties."""
    ranked = pose_rank(poses).where(~F.isnan("rank"))
    rest = [c for c in ranked.columns if c not in KEY]
    best = ranked.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("rank", -F.col("instance_index"))).alias("b"))
    return best.select(*KEY, "b.*")


def top_counts(df: DataFrame, by: list[str], key: str, count: str = "n", k: int | None = 8) -> DataFrame:
    """The ``k`` largest counters of each group; equal ones by key."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc(count), key)
    ranked = df.withColumn("place", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("place") <= k)
