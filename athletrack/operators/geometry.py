"""Keypoints, crops and what they say about the next detection. Every operator is a projection of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.functions import geometry as g


def _points(threshold: float):
    return g.visible(F.col("keypoints"), F.col("scores"), threshold)


def visible_keypoints(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    return df.withColumn("visible", _points(threshold))


def keypoint_bounds(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Adds ``bounds``: number and extent of the visible keypoints."""
    return df.withColumn("bounds", g.bounds(_points(threshold)))


def crop_around_bbox(df: DataFrame, margin: float = 0.2) -> DataFrame:
    """Adds ``crop`` around the columns x1, y1, x2, y2."""
    return df.withColumn("crop", g.crop(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "frame_width", "frame_height")), margin))


def crop_around_player(df: DataFrame, margin: float = 0.2) -> DataFrame:
    """Adds ``crop`` around the pose's box, else around its keypoints if at least four are visible."""
    size = F.col("frame_width"), F.col("frame_height")
    b = F.col("_b")
    around = F.when(F.col("bbox").isNotNull(), g.crop_around_box(F.col("bbox"), *size, margin)).when(b["n"] >= g.MIN_CROP_POINTS, g.crop_around_box(b, *size, margin))
    return df.withColumn("_b", g.bounds(_points(g.POSE_VISIBLE))).withColumn("crop", around).drop("_b")


def move_pose_to_frame(df: DataFrame) -> DataFrame:
    """Keypoints of a crop in coordinates of the frame; the crop becomes the box. A null pose stays null."""
    shift = lambda p: F.struct((p["x"] + F.col("crop.x1").cast("float")).cast("float").alias("x"), (p["y"] + F.col("crop.y1").cast("float")).cast("float").alias("y"))
    box = F.struct(*(F.col(f"crop.{k}").cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")))
    return df.withColumn("keypoints", F.transform("keypoints", shift)).withColumn("bbox", F.when(F.col("keypoints").isNotNull(), box))


def scale_pose(df: DataFrame, scale: float) -> DataFrame:
    s = g.as_float(scale)
    points = F.transform("keypoints", lambda p: F.struct((p["x"] * s).cast("float").alias("x"), (p["y"] * s).cast("float").alias("y")))
    box = F.when(F.col("bbox").isNotNull(), F.struct(*((F.col(f"bbox.{k}") * F.lit(float(scale))).alias(k) for k in ("x1", "y1", "x2", "y2"))))
    return df.withColumn("keypoints", points).withColumn("bbox", box)


def skeleton_segments(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each bone whose ends are both visible, with rounded ends (halves to even)."""
    ends = df.select(*df.columns, F.posexplode(g.bones()).alias("bone_index", "bone"))
    seen = F.get("scores", F.col("bone.a")) >= g.as_float(threshold), F.get("scores", F.col("bone.b")) >= g.as_float(threshold)
    at = lambda end, axis: F.rint(g.double(F.get("keypoints", F.col(f"bone.{end}"))[axis])).cast("int")
    return ends.where(seen[0] & seen[1]).select(
        *df.columns, F.col("bone_index").cast("bigint"), at("a", "x").alias("ax"), at("a", "y").alias("ay"), at("b", "x").alias("bx"), at("b", "y").alias("by")
    )


def joint_markers(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each visible keypoint, with rounded coordinates, and the pose's rounded box."""
    rows = df.select(*df.columns, F.explode(_points(threshold)).alias("p"))
    place = lambda c: F.rint(g.double(c)).cast("int")
    box = F.when(F.col("bbox").isNotNull(), F.struct(*(place(F.col(f"bbox.{k}")).alias(k) for k in ("x1", "y1", "x2", "y2"))))
    return rows.select(*df.columns, F.col("p.index").alias("kp_index"), place(F.col("p.x")).alias("mx"), place(F.col("p.y")).alias("my"), box.alias("marker_box"))


def edge_hits(df: DataFrame, threshold: float = 0.3, fraction: float = 0.06) -> DataFrame:
    """One row for each visible keypoint and side of ``crop`` that it touches."""
    found = g.hits(_points(threshold), F.col("crop"), fraction)
    return df.select(*df.columns, F.explode(found).alias("h")).select(*df.columns, "h.joint", "h.edge", "h.confidence")


def clamped_edges(df: DataFrame) -> DataFrame:
    return df.withColumn("clamped", g.clamped(F.col("crop"), F.col("frame_width"), F.col("frame_height")))


def assess_redetection(df: DataFrame, threshold: float = 0.3, min_keypoints: int = 8, fraction: float = 0.06) -> DataFrame:
    """Adds ``assessment``: why a new detection is due, if one is."""
    made = g.assessment(F.col("keypoints").isNotNull(), F.coalesce(_points(threshold), F.array()), F.col("crop"), F.col("frame_width"), F.col("frame_height"), min_keypoints, fraction)
    return df.withColumn("assessment", made)


def update_crop_step(df: DataFrame, threshold: float = 0.3, margin: float = 0.2, alpha: float = 0.35) -> DataFrame:
    """Adds ``new_crop``: ``crop`` smoothed towards the visible keypoints, unchanged if fewer than four are visible."""
    size = F.col("frame_width"), F.col("frame_height")
    with_bounds = df.withColumn("_b", g.bounds(_points(threshold)))
    with_target = with_bounds.withColumn("_t", F.when(F.col("_b.n") >= g.MIN_CROP_POINTS, g.crop_around_box(F.col("_b"), *size, margin)))
    new = F.when(F.col("_t").isNull(), F.col("crop")).otherwise(g.smoothed(F.col("crop"), F.col("_t"), *size, alpha))
    return with_target.withColumn("new_crop", new).drop("_b", "_t")
