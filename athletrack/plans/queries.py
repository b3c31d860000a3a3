"""Every operator as a query over the test tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from athletrack.functions import geometry as g
from athletrack.operators import frequent, geometry, metrics, select, sketches, timeline, windows
from athletrack.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["session_id", "frame_index"]
POSE = ["session_id", "pose_id", "frame_index"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = " ".join(sql.split())
        return f

    return add


def _tables(text: str) -> str:
    return text.format(lineitem="lineitem", events="events", embeddings="embeddings")


DET, LOG, SES, REQ, KP = map(_tables, (fx.DETECTIONS, fx.FRAME_LOG, fx.SESSIONS, fx.REQUESTS, fx.KEYPOINTS))
WITH_DET = f"with d as ({DET})"
WITH_LOG = f"with g as ({LOG}), s as ({SES})"
TAKEN = "(select *, greatest(0, sequence - lag(sequence, 1, -1) over (partition by session_id order by sequence) - 1) as dropped from g)"
WITH_REQ = f"with r as ({REQ}), s as ({SES})"
WITH_KP = f"with kp as ({KP})"
THR = "cast(0.3 as float)"
RANK = """greatest(cast(0 as double), cast(x2 - x1 as double)) * greatest(cast(0 as double), cast(y2 - y1 as double)) * cast(score as double)
 / (1 + sqrt((cast(x1 + x2 as double) / 2 - cast(frame_width as double) / 2) * (cast(x1 + x2 as double) / 2 - cast(frame_width as double) / 2)
  + (cast(y1 + y2 as double) / 2 - cast(frame_height as double) / 2) * (cast(y1 + y2 as double) / 2 - cast(frame_height as double) / 2)) / cast(greatest(frame_width, frame_height) as double))"""
PERSON = "label = 0 and cast(score as double) >= cast(0.3 as double)"
SELECTED = f"(select * from (select *, {RANK} as rank, row_number() over (partition by session_id, frame_index order by {RANK} desc, det_index) as place from d where {PERSON}) t where place = 1)"


def sql_crop(box: tuple[str, str, str, str], margin: float) -> str:
    """The four sides of the crop around a box; null where it is empty, by the outer select over a, b, c, e."""
    x1, y1, x2, y2 = box
    mx = f"greatest(cast({x2} - ({x1}) as double), cast(1 as double)) * cast({margin} as double)"
    my = f"greatest(cast({y2} - ({y1}) as double), cast(1 as double)) * cast({margin} as double)"
    return (
        f"greatest(0, cast(floor(cast({x1} as double) - {mx}) as int)) as a, greatest(0, cast(floor(cast({y1} as double) - {my}) as int)) as b, "
        f"least(frame_width, cast(ceil(cast({x2} as double) + {mx}) as int)) as c, least(frame_height, cast(ceil(cast({y2} as double) + {my}) as int)) as e"
    )


SIDES_OF_CROP = ", ".join(f"case when c > a and e > b then {v} end as {k}" for k, v in zip(("x1", "y1", "x2", "y2"), "abce"))


def _flat(df: DataFrame, keep: list[str], crop: str = "crop") -> DataFrame:
    return df.select(*keep, *(F.col(f"{crop}.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")))


# --- predictions and selection


@query(f"{WITH_DET} select session_id, frame_index, det_index, x1, y1, x2, y2, score, label from d")
def flatten_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("det_index", F.array("x1", "y1", "x2", "y2").alias("box"), "score", "label")
    rows = fx.detections(spark, sf_dir).groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("r"))
    raw = rows.select(*KEY, F.struct(F.col("r.box").alias("bboxes"), F.col("r.score").alias("scores"), F.col("r.label").alias("labels")).alias("prediction"))
    return select.flatten_detections(raw)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances a pose; every tenth prediction is empty. The second instance has neither bbox nor bboxes."""
    p = fx.poses(spark, sf_dir)
    box = F.array(F.array(*(F.col(f"crop.{k}").cast("double") for k in ("x1", "y1", "x2", "y2"))))
    none = F.lit(None).cast("array<array<double>>")
    points = F.transform("keypoints", lambda k: F.array(k["x"], k["y"]))
    first = F.struct(points.alias("keypoints"), F.col("scores").alias("keypoint_scores"), F.when(F.col("pose_id") % 3 == 0, box).alias("bbox"), F.when(F.col("pose_id") % 3 == 1, box).alias("bboxes"))
    second = F.struct(points.alias("keypoints"), F.col("scores").alias("keypoint_scores"), none.alias("bbox"), none.alias("bboxes"))
    both = F.array(F.array(first, second))
    return p.select(*POSE, F.when(F.col("pose_id") % 10 == 0, F.slice(both, 1, 0)).otherwise(both).alias("predictions"))


@query(f"{WITH_KP} select session_id, pose_id, frame_index, cast(i as int) as instance_index, cast(count(*) as int) as n_points, max(score) as best from kp, (select range as i from range(2)) q where pose_id % 10 <> 0 group by session_id, pose_id, frame_index, i")
def flatten_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.flatten_instances(_predictions(spark, sf_dir))
    return rows.select(*POSE, "instance_index", F.size("instance.keypoints").alias("n_points"), F.array_max("instance.keypoint_scores").alias("best"))


@query(f"""{WITH_KP} select session_id, pose_id, frame_index, cast(i as int) as instance_index,
 {', '.join(f"case when i = 0 and pose_id % 3 < 2 then cast(c{k} as double) end as {k}" for k in ('x1', 'y1', 'x2', 'y2'))}
 from kp, (select range as i from range(2)) q where pose_id % 10 <> 0 and kp_index = 0""")
def instance_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(select.instance_bbox(select.flatten_instances(_predictions(spark, sf_dir))), [*POSE, "instance_index"], "box")


@query(f"{WITH_DET} select session_id, frame_index, det_index, score from d where {PERSON}")
def person_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.person_filter(fx.detections(spark, sf_dir)).select(*KEY, "det_index", "score")


@query(f"{WITH_DET} select session_id, frame_index, det_index, {RANK} as rank from d")
def detection_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.detection_rank(fx.detections(spark, sf_dir)).select(*KEY, "det_index", "rank")


@query(f"{WITH_DET} select session_id, frame_index, det_index, x1, y1, x2, y2, score, rank from {SELECTED} t")
def select_player_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_player_bbox(fx.detections(spark, sf_dir)).drop("frame_width", "frame_height")


@query(f"{WITH_DET} select session_id, frame_index, det_index, {SIDES_OF_CROP} from (select *, {sql_crop(('x1', 'y1', 'x2', 'y2'), 0.35)} from {SELECTED} t) u")
def crop_around_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.select_player_bbox(fx.detections(spark, sf_dir))
    return _flat(geometry.crop_around_bbox(best, 0.35), [*KEY, "det_index"])


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances a frame: the pose, with a box in every third, and the same at half the size."""
    p = fx.poses(spark, sf_dir)
    box = F.when(F.col("pose_id") % 3 == 0, F.struct(*(F.col(f"crop.{k}").cast("double").alias(k) for k in ("x1", "y1", "x2", "y2"))))
    half = F.transform("keypoints", lambda k: F.struct((k["x"] * g.as_float(0.5)).cast("float").alias("x"), (k["y"] * g.as_float(0.5)).cast("float").alias("y")))
    second = p.withColumn("keypoints", half).withColumn("instance_index", F.lit(1).cast("bigint"))
    return p.withColumn("bbox", box).unionByName(second)


PEOPLE = """people as (select session_id, pose_id, frame_index, i as instance_index, i = 0 and pose_id % 3 = 0 as has, min(case when vis then x end) as x1, min(case when vis then y end) as y1,
 max(case when vis then x end) as x2, max(case when vis then y end) as y2, min(cx1) as cx1, min(cy1) as cy1, min(cx2) as cx2, min(cy2) as cy2
 from (select session_id, pose_id, frame_index, q.i as i, cast(score as double) > cast(0.2 as double) as vis, cast(x as double) / (1 + q.i) as x, cast(y as double) / (1 + q.i) as y, cx1, cy1, cx2, cy2 from kp, (select cast(range as bigint) as i from range(2)) q) w
 group by session_id, pose_id, frame_index, i),
ranked as (select *, case when has then greatest(cast(0 as double), bx2 - bx1) * greatest(cast(0 as double), by2 - by1) else (bx2 - bx1) * (by2 - by1) end
  / (1 + sqrt(((bx1 + bx2) / 2 - 640) * ((bx1 + bx2) / 2 - 640) + ((by1 + by2) / 2 - 360) * ((by1 + by2) / 2 - 360)) / 1280) as rank
 from (select *, case when has then cast(cx1 as double) else x1 end as bx1, case when has then cast(cy1 as double) else y1 end as by1, case when has then cast(cx2 as double) else x2 end as bx2, case when has then cast(cy2 as double) else y2 end as by2 from people where has or x1 is not null) v)"""


@query(f"{WITH_KP}, {PEOPLE} select session_id, pose_id, frame_index, instance_index, rank from ranked")
def pose_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.pose_rank(_people(spark, sf_dir)).select(*POSE, "instance_index", "rank")


@query(f"{WITH_KP}, {PEOPLE} select session_id, pose_id, frame_index, instance_index, rank from (select *, row_number() over (partition by session_id, frame_index order by rank desc, instance_index) as place from ranked) t where place = 1")
def select_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_player(_people(spark, sf_dir)).select(*POSE, "instance_index", "rank")


@query(f"""{WITH_REQ} select session_id, reason, n, cast(place as int) as place from (select *, row_number() over (partition by session_id order by n desc, reason) as place from
 (select session_id, reason, count(*) as n from r where accepted group by session_id, reason) t) u where place <= 3""")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.requests(spark, sf_dir).where("accepted").groupBy("session_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    return select.top_counts(counts, ["session_id"], "reason", k=3)


@query("""select lane, part, n, cast(place as int) as place from (select *, row_number() over (partition by lane order by n desc, part) as place from
 (select l_orderkey % 7 as lane, case when l_linenumber > 2 then l_suppkey % 9 else l_partkey end as part, count(*) as n from lineitem group by 1, 2) t) u where place <= 5""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent values among many rare ones, in seven groups."""
    part = F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 9).otherwise(F.col("l_partkey")).alias("part")
    rows = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("lane"), part)
    return frequent.top_values(rows, ["lane"], "part", k=5, tracked=512)


# --- keypoints and crops


@query(f"{WITH_KP} select session_id, pose_id, frame_index, cast(kp_index as int) as kp_index, x, y, score from kp where score >= {THR}")
def visible_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.visible_keypoints(fx.poses(spark, sf_dir)).select(*POSE, F.explode("visible").alias("p")).select(*POSE, F.col("p.index").alias("kp_index"), "p.x", "p.y", "p.score")


BOUNDS = f"""bounds as (select session_id, pose_id, frame_index, cast(count(case when score >= {THR} then 1 end) as int) as n, min(case when score >= {THR} then x end) as x1, min(case when score >= {THR} then y end) as y1,
 max(case when score >= {THR} then x end) as x2, max(case when score >= {THR} then y end) as y2, min(cx1) as cx1, min(cy1) as cy1, min(cx2) as cx2, min(cy2) as cy2, min(frame_width) as frame_width, min(frame_height) as frame_height
 from kp group by session_id, pose_id, frame_index)"""


@query(f"{WITH_KP}, {BOUNDS} select session_id, pose_id, frame_index, n, x1, y1, x2, y2 from bounds")
def keypoint_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.keypoint_bounds(fx.poses(spark, sf_dir)).select(*POSE, "bounds.*")


@query(f"""{WITH_KP}, bounds as (select session_id, pose_id, frame_index, count(case when score >= cast(0.2 as float) then 1 end) as n, min(case when score >= cast(0.2 as float) then x end) as x1, min(case when score >= cast(0.2 as float) then y end) as y1,
 max(case when score >= cast(0.2 as float) then x end) as x2, max(case when score >= cast(0.2 as float) then y end) as y2, min(frame_width) as frame_width, min(frame_height) as frame_height from kp group by session_id, pose_id, frame_index)
 select session_id, pose_id, frame_index, {SIDES_OF_CROP.replace('c > a', 'n >= 4 and c > a')} from (select session_id, pose_id, frame_index, n, {sql_crop(('x1', 'y1', 'x2', 'y2'), 0.35)} from bounds) u""")
def crop_around_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(geometry.crop_around_player(fx.poses(spark, sf_dir), 0.35), POSE)


@query(f"{WITH_KP} select session_id, pose_id, frame_index, cast(kp_index as int) as kp_index, cast(x + cast(cx1 as float) as float) as x, cast(y + cast(cy1 as float) as float) as y, cast(cx2 as double) as box_x2 from kp")
def move_pose_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = geometry.move_pose_to_frame(fx.poses(spark, sf_dir))
    return moved.select(*POSE, F.col("bbox.x2").alias("box_x2"), F.posexplode("keypoints").alias("kp_index", "p")).select(*POSE, "kp_index", "p.x", "p.y", "box_x2")


@query(f"{WITH_KP} select session_id, pose_id, frame_index, cast(kp_index as int) as kp_index, cast(x * cast(0.5 as float) as float) as x, cast(y * cast(0.5 as float) as float) as y, score from kp")
def scale_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = geometry.scale_pose(fx.poses(spark, sf_dir), 0.5)
    return scaled.select(*POSE, F.posexplode(F.arrays_zip("keypoints", "scores")).alias("kp_index", "p")).select(*POSE, "kp_index", "p.keypoints.x", "p.keypoints.y", F.col("p.scores").alias("score"))


BONES = "(values " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(geometry.g.BONES)) + ") as bone(bone_index, a, b)"
_END = "cast(round_even(cast(ps[{end} + 1].{axis} as double), 0) as int) as {name}"
_ENDS = ", ".join(_END.format(end=end, axis=axis, name=f"{end}{axis}") for end in "ab" for axis in "xy")


@query(f"""{WITH_KP}, pose as materialized (select session_id, pose_id, frame_index, list({{'x': x, 'y': y, 'score': score}} order by kp_index) as ps from kp group by session_id, pose_id, frame_index)
 select session_id, pose_id, frame_index, cast(bone_index as bigint) as bone_index, {_ENDS} from pose cross join {BONES} where ps[a + 1].score >= {THR} and ps[b + 1].score >= {THR}""")
def skeleton_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.skeleton_segments(fx.poses(spark, sf_dir)).select(*POSE, "bone_index", "ax", "ay", "bx", "by")


@query(f"{WITH_KP} select session_id, pose_id, frame_index, cast(kp_index as int) as kp_index, cast(round_even(cast(x as double), 0) as int) as mx, cast(round_even(cast(y as double), 0) as int) as my from kp where score >= {THR}")
def joint_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.joint_markers(fx.poses(spark, sf_dir)).select(*POSE, "kp_index", "mx", "my")


JOINT = "case kp_index " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(g.JOINTS)) + " else cast(kp_index as varchar) end"


@query(f"{WITH_KP} select session_id, pose_id, frame_index, cast(kp_index as int) as kp_index, {JOINT} as joint from (select session_id, pose_id, frame_index, kp_index + pose_id % 3 as kp_index from kp) t")
def joint_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.poses(spark, sf_dir).select(*POSE, F.posexplode("keypoints").alias("i", "p"))
    index = (F.col("i") + F.col("pose_id") % 3).cast("int")
    return rows.select(*POSE, index.alias("kp_index"), g.joint_name(index).alias("joint"))


_EX, _EY = "cast(cx2 - cx1 as double) * cast(0.06 as double)", "cast(cy2 - cy1 as double) * cast(0.06 as double)"
TOUCH = {
    "left": f"cast(x as double) <= cast(cx1 as double) + {_EX}", "right": f"cast(x as double) >= cast(cx2 as double) - {_EX}",
    "top": f"cast(y as double) <= cast(cy1 as double) + {_EY}", "bottom": f"cast(y as double) >= cast(cy2 as double) - {_EY}",
}
HITS = "hits as (" + " union all ".join(f"select session_id, pose_id, frame_index, {JOINT} as joint, '{s}' as edge, cast(score as double) as confidence, {c} as clamped from kp where score >= {THR} and {t}"
    for (s, t), c in zip(TOUCH.items(), ("cx1 <= 0", "cx2 >= frame_width", "cy1 <= 0", "cy2 >= frame_height"))) + ")"
#: hits of the poses with enough keypoints, as an assessment records them
ASSESSED = f"{WITH_KP}, {BOUNDS}, {HITS}, kept as (select h.* from hits h join bounds b on h.pose_id = b.pose_id where b.n >= 8)"


@query(f"{WITH_KP}, {HITS} select session_id, pose_id, frame_index, joint, edge, confidence from hits")
def edge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.edge_hits(fx.poses(spark, sf_dir)).select(*POSE, "joint", "edge", "confidence")


@query(f"""{WITH_KP} select session_id, pose_id, frame_index, side from (select distinct session_id, pose_id, frame_index, cx1, cy1, cx2, cy2 from kp) p, (values ('left'), ('right'), ('top'), ('bottom')) as q(side)
 where (side = 'left' and cx1 <= 0) or (side = 'right' and cx2 >= 1280) or (side = 'top' and cy1 <= 0) or (side = 'bottom' and cy2 >= 720)""")
def clamped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.clamped_edges(fx.poses(spark, sf_dir)).select(*POSE, F.explode("clamped").alias("side"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.assess_redetection(fx.poses(spark, sf_dir)).select("session_id", "pose_id", "frame_index", "assessment")


@query(f"""{ASSESSED} select b.session_id, b.pose_id, b.frame_index, case when b.n < 8 then 'low_keypoints' when max(case when not clamped then 1 end) = 1 then 'crop_edge' end as reason,
 cast(count(k.edge) as int) as hits, count(k.edge) > 0 and coalesce(max(case when not clamped then 1 end), 0) = 0 as suppressed
 from bounds b left join kept k on k.pose_id = b.pose_id group by b.session_id, b.pose_id, b.frame_index, b.n""")
def assess_redetection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select(*POSE, "assessment.reason", F.size("assessment.edge_hits").alias("hits"), F.col("assessment.clamped_only_suppressed").alias("suppressed"))


def _step_sql() -> str:
    target = f"select *, {sql_crop(('x1', 'y1', 'x2', 'y2'), 0.35)} from bounds"
    size = lambda lo, hi, tlo, thi: f"cast(0.65 as double) * cast({hi} - {lo} as double) + cast(0.35 as double) * least(greatest(cast({thi} - {tlo} as double), cast({hi} - {lo} as double) * cast(0.85 as double)), cast({hi} - {lo} as double) * cast(1.2 as double))"
    mid = lambda lo, hi, tlo, thi: f"cast(0.65 as double) * (cast({lo} + {hi} as double) / 2) + cast(0.35 as double) * (cast({tlo} + {thi} as double) / 2)"
    blend = f"select session_id, pose_id, frame_index, n, cx1, cy1, cx2, cy2, frame_width, frame_height, n >= 4 and c > a and e > b as ok, {size('cx1', 'cx2', 'a', 'c')} as w, {size('cy1', 'cy2', 'b', 'e')} as h, {mid('cx1', 'cx2', 'a', 'c')} as mx, {mid('cy1', 'cy2', 'b', 'e')} as my from ({target}) t"
    made = f"select *, {sql_crop(('mx - w / 2', 'my - h / 2', 'mx + w / 2', 'my + h / 2'), 0.0)} from ({blend}) v"
    out = ", ".join(f"case when ok and c > a and e > b then {v} else c{k} end as {k}" for k, v in zip(("x1", "y1", "x2", "y2"), "abce"))
    return f"{WITH_KP}, {BOUNDS} select session_id, pose_id, frame_index, {out} from ({made}) z"


@query(_step_sql())
def update_crop_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(geometry.update_crop_step(fx.poses(spark, sf_dir), margin=0.35), POSE, "new_crop")


# --- latencies and stages


@query(f"{WITH_LOG} select session_id, frame_index, completed_at - captured_at as frame_age, inference_started_at - captured_at as inference_wait, greatest(0, latest_sequence - sequence) as sequence_lag from g")
def frame_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.frame_latency(fx.frame_log(spark, sf_dir)).select(*KEY, "frame_age", "inference_wait", "sequence_lag")


@query(f"{WITH_REQ} select session_id, request_id, consumed_at - requested_at as result_latency, case when consumed_sequence is not null then greatest(0, consumed_sequence - sequence) end as result_lag from r")
def detector_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.detector_latency(fx.requests(spark, sf_dir)).select("session_id", "request_id", "result_latency", "result_lag")


@query(f"{WITH_LOG} select session_id, frame_index, sequence from g where frame_index % 3 = 0")
def infer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.infer_sample(fx.frame_log(spark, sf_dir), 3).select(*KEY, "sequence")


@query(f"{WITH_LOG} select session_id, frame_index, case when frame_index % 2 = 0 and reason is not null then 'detector' when frame_index % 2 = 0 and has_player then 'pose' else 'reuse' end as frame_stage from g")
def frame_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame_log(spark, sf_dir).select(*KEY, (F.col("frame_index") % 2 == 0).alias("inferred"), F.col("reason").isNotNull().alias("detector_ran"), F.col("has_player").alias("has_crop"))
    return timeline.frame_stage(rows).select(*KEY, "frame_stage")


@query(f"{WITH_LOG} select g.session_id, g.frame_index, g.completed_at from g join s on g.session_id = s.session_id where g.completed_at >= s.started_at + s.warmup_seconds")
def steady_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.steady_filter(fx.frame_log(spark, sf_dir), fx.sessions(spark, sf_dir), "completed_at").select(*KEY, "completed_at")


# --- joins


@query(f"""{WITH_LOG}, p as (select session_id, polled_at, row_number() over (partition by session_id order by polled_at) as i from (select session_id, loop_started_at + cast(0.011 as double) as polled_at from g where frame_index % 2 = 0) t),
 n as (select p.session_id, p.i, p.polled_at, coalesce(max(g.sequence), -1) as newest from p left join g on g.session_id = p.session_id and g.captured_at <= p.polled_at group by p.session_id, p.i, p.polled_at),
 t as (select *, i + greatest(-1, max(newest - i) over (partition by session_id order by i)) as sequence, (select max(sequence) from g where g.session_id = n.session_id) as last from n)
 select session_id, i - 1 as poll_index, polled_at, sequence, sequence - lag(sequence, 1, -1) over (partition by session_id order by i) - 1 as dropped from t where sequence <= last""")
def latest_frame_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.frame_log(spark, sf_dir)
    polls = log.where("frame_index % 2 = 0").select("session_id", (F.col("loop_started_at") + F.lit(0.011)).alias("polled_at"))
    return timeline.latest_frame_feed(polls, log.select("session_id", "sequence", "captured_at"))


@query(f"""{WITH_REQ}, g as ({LOG}), f as (select r.session_id, r.request_id, r.completed_at, min(g.loop_started_at) as at from r left join g on g.session_id = r.session_id and g.loop_started_at >= r.completed_at group by r.session_id, r.request_id, r.completed_at)
 select f.session_id, f.request_id, f.completed_at, min(g.frame_index) as applied_frame, min(g.sequence) as applied_sequence from f left join g on g.session_id = f.session_id and g.loop_started_at = f.at group by f.session_id, f.request_id, f.completed_at""")
def apply_detector_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.apply_detector_results(fx.requests(spark, sf_dir), fx.frame_log(spark, sf_dir))


@query(f"{WITH_LOG} select f.session_id, f.frame_index, p.frame_index as pose_frame, p.frame_age from g f left join (select * from g where has_player and frame_index % 3 = 0) p on p.session_id = f.session_id and p.frame_index = f.frame_index - f.frame_index % 3")
def pose_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.frame_log(spark, sf_dir)
    found = log.where("has_player and frame_index % 3 = 0").select(*KEY, F.col("frame_index").alias("pose_frame"), "frame_age")
    return timeline.pose_reuse(log.select(*KEY), found, 3).select(*KEY, "pose_frame", "frame_age")


RUN = "select cast(floor(session_id / 2.0) as bigint) as video, cast(count(*) as double) / max(completed_at) as fps, cast(100 * sum(dropped) as double) / (max(sequence) + 1) as drop_pct, round(quantile_cont(frame_age, 0.95), 9) as age_p95, max(frame_age) as max_age, count(reason) as refreshes"


@query(f"""{WITH_LOG}, t as {TAKEN}, a as ({RUN} from t where session_id % 2 = 0 group by session_id), b as ({RUN} from t where session_id % 2 = 1 group by session_id)
 select coalesce(a.video, b.video) as video, {', '.join(f"a.{m} as {m}_before, b.{m} as {m}_after" for m in ('fps', 'drop_pct', 'age_p95', 'max_age', 'refreshes'))},
 case when a.fps > 0 then 100 * (b.fps - a.fps) / a.fps end as gain_pct from a full join b on a.video = b.video""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.taken_log(spark, sf_dir)

    def run(parity: int) -> DataFrame:
        rows = log.where(F.col("session_id") % 2 == parity).groupBy("session_id").agg(
            (F.count(F.lit(1)).cast("double") / F.max("completed_at")).alias("fps"),
            ((100 * F.sum("dropped")).cast("double") / (F.max("sequence") + 1)).alias("drop_pct"),
            F.round(metrics.percentile("frame_age", 0.95), 9).alias("age_p95"),
            F.max("frame_age").alias("max_age"),
            F.count("reason").alias("refreshes"),
        )
        return rows.withColumn("video", F.floor(F.col("session_id") / 2).cast("bigint"))

    return timeline.compare_runs(run(0), run(1))


# --- aggregations

ROUND = 9
STEADY = "greatest(cast(0 as double), ended_at - greatest(started_at, started_at + warmup_seconds))"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, ROUND) for n in names})


@query(f"""{WITH_LOG}, t as {TAKEN}, c as (select session_id, max(sequence) + 1 as captured, max(captured_at) - min(captured_at) as span, count(*) as processed, count(case when frame_stage <> 'reuse' then 1 end) as inferred,
 count(case when frame_stage = 'detector' then 1 end) as refreshes, cast(sum(dropped) as bigint) as dropped from t group by session_id)
 select c.session_id, ended_at - started_at as duration, captured, processed, inferred, refreshes, greatest(dropped, captured - processed) as skipped,
 round(case when span > 0 then (captured - 1) / span else 0 end, 9) as capture_fps, round(processed / (ended_at - started_at), 9) as processed_fps, round(inferred / (ended_at - started_at), 9) as inferred_fps,
 round(cast(100 as double) * greatest(dropped, captured - processed) / greatest(captured, 1), 9) as drop_pct from c join s on c.session_id = s.session_id""")
def session_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.session_throughput(fx.taken_log(spark, sf_dir), fx.sessions(spark, sf_dir)), "capture_fps", "processed_fps", "inferred_fps", "drop_pct")


def _scoped_sql(rows: str, clock: str) -> str:
    return f"(select x.*, started_at, ended_at, warmup_seconds, scope from {rows} x join s on x.session_id = s.session_id, (values ('all'), ('steady')) as v(scope) where scope = 'all' or {clock} >= started_at + warmup_seconds)"


SECONDS = f"case when scope = 'steady' then {STEADY} else ended_at - started_at end"


@query(f"""{WITH_LOG} select session_id, scope, processed, age_p50, age_p95, max_age, wait_p95, max_lag, seconds, round(case when seconds > 0 then processed / seconds else 0 end, 9) as fps from
 (select session_id, scope, count(*) as processed, round(quantile_cont(frame_age, 0.5), 9) as age_p50, round(quantile_cont(frame_age, 0.95), 9) as age_p95, max(frame_age) as max_age, round(quantile_cont(inference_wait, 0.95), 9) as wait_p95,
 max(greatest(0, latest_sequence - sequence)) as max_lag, max({SECONDS}) as seconds from {_scoped_sql('g', 'completed_at')} t group by session_id, scope) u""")
def session_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.session_freshness(fx.frame_log(spark, sf_dir), fx.sessions(spark, sf_dir)), "age_p50", "age_p95", "wait_p95", "fps")


@query(f"{WITH_LOG} select session_id, frame_stage, count(*) as n, round(quantile_cont(frame_age, 0.5), 9) as age_p50, round(quantile_cont(frame_age, 0.95), 9) as age_p95 from {_scoped_sql('g', 'completed_at')} t where scope = 'steady' and frame_stage <> 'reuse' group by session_id, frame_stage")
def frame_class_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.frame_class_latency(fx.frame_log(spark, sf_dir), fx.sessions(spark, sf_dir)), "age_p50", "age_p95")


@query(f"""{WITH_LOG} select session_id, scope, count(case when has_player then 1 end) as poses, round(quantile_cont(pose_seconds, 0.5), 9) as pose_p50, round(quantile_cont(pose_seconds, 0.95), 9) as pose_p95,
 round(case when max({SECONDS}) > 0 then count(case when has_player then 1 end) / max({SECONDS}) else 0 end, 9) as poses_per_second from {_scoped_sql("(select * from g where frame_stage <> 'reuse')", 'pose_ended_at')} t group by session_id, scope""")
def pose_output_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.pose_output_rate(fx.frame_log(spark, sf_dir), fx.sessions(spark, sf_dir)), "pose_p50", "pose_p95", "poses_per_second")


@query(f"""{WITH_REQ}, a as (select session_id, scope, count(*) as submitted from {_scoped_sql('(select * from r where accepted)', 'requested_at')} t group by session_id, scope),
 b as (select session_id, scope, count(*) as completed, {', '.join(f"round(quantile_cont({v}, {p}), 9) as {n}_p{round(100 * p)}" for n, v in (('latency', 'consumed_at - requested_at'), ('lag', 'cast(greatest(0, consumed_sequence - sequence) as double)')) for p in (0.5, 0.95))}
 from {_scoped_sql('(select * from r where accepted and consumed_at is not null)', 'consumed_at')} t group by session_id, scope)
 select coalesce(a.session_id, b.session_id) as session_id, coalesce(a.scope, b.scope) as scope, coalesce(submitted, 0) as submitted, coalesce(completed, 0) as completed, latency_p50, latency_p95, lag_p50, lag_p95
 from a full join b on a.session_id = b.session_id and a.scope = b.scope""")
def detector_worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.detector_worker_stats(fx.requests(spark, sf_dir), fx.sessions(spark, sf_dir)), "latency_p50", "latency_p95", "lag_p50", "lag_p95")


@query(f"{WITH_REQ} select session_id, scope, reason, count(*) as n from {_scoped_sql('(select * from r where accepted)', 'requested_at')} t group by session_id, scope, reason")
def detector_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detector_reason_counts(fx.requests(spark, sf_dir), fx.sessions(spark, sf_dir))


@query(f"""{WITH_REQ} select s.session_id, coalesce(n, 0) as refreshes, round(case when {STEADY} > 0 then coalesce(n, 0) / {STEADY} else 0 end, 9) as per_second from s left join
 (select session_id, count(*) as n from {_scoped_sql('(select * from r where accepted)', 'requested_at')} t where scope = 'steady' group by session_id) u on u.session_id = s.session_id""")
def detector_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.detector_rate(fx.requests(spark, sf_dir), fx.sessions(spark, sf_dir)), "per_second")


EVENTS_OF = "select b.session_id, count(distinct k.pose_id) as events, count(distinct k.pose_id) - count(distinct case when not clamped then k.pose_id end) as suppressed from bounds b left join kept k on k.pose_id = b.pose_id group by b.session_id"


@query(f"{ASSESSED} {EVENTS_OF}")
def edge_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_event_counts(_assessed(spark, sf_dir))


@query(f"{ASSESSED} select session_id, events, suppressed, events - suppressed as actionable from ({EVENTS_OF}) t")
def edge_actionable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_actionable_split(_assessed(spark, sf_dir))


def _kept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_hit_rows(_assessed(spark, sf_dir))


@query(f"{ASSESSED} select session_id, edge, count(*) as n from kept group by session_id, edge")
def edge_side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_side_counts(_kept_hits(spark, sf_dir))


@query(f"{ASSESSED} select session_id, joint, count(*) as n from kept group by session_id, joint")
def edge_joint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_joint_counts(_kept_hits(spark, sf_dir))


@query(f"{ASSESSED} select session_id, joints, count(*) as n from (select session_id, pose_id, count(distinct joint) as joints from kept group by session_id, pose_id) t group by session_id, joints")
def edge_landmark_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_landmark_histogram(_assessed(spark, sf_dir))


@query(f"""{ASSESSED} select session_id, side, count(*) as n from (select distinct session_id, pose_id, edge as side from kept where clamped
 union all select session_id, pose_id, 'not_clamped' as side from kept group by session_id, pose_id having max(case when clamped then 1 else 0 end) = 0) t group by session_id, side""")
def edge_clamp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_clamp_counts(_assessed(spark, sf_dir))


@query(f"{ASSESSED} select session_id, count(*) as n, round(quantile_cont(confidence, 0.5), 9) as p50, round(quantile_cont(confidence, 0.95), 9) as p95 from kept group by session_id")
def edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.edge_confidence(_kept_hits(spark, sf_dir)), "p50", "p95")


MEANS = ", ".join(f"avg({s}) as {s.replace('_seconds', '_mean')}" for s in metrics.STAGES)
MEAN_NAMES = tuple(s.replace("_seconds", "_mean") for s in metrics.STAGES)


@query(f"{WITH_LOG} select session_id, {', '.join(f'round(avg({s}), 9) as {m}' for s, m in zip(metrics.STAGES, MEAN_NAMES))} from g group by session_id")
def stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.stage_means(fx.frame_log(spark, sf_dir)), *MEAN_NAMES)


@query(f"{WITH_LOG} select session_id, round(ms, 6) as budget_ms, round(case when ms > 0 then 1000 / ms end, 6) as expected_fps from (select session_id, 1000 * (coalesce(detector_mean, 0) / 30 + coalesce(pose_mean, 0) + coalesce(display_mean, 0) + coalesce(decode_mean, 0)) as ms from (select session_id, {MEANS} from g group by session_id) t) u")
def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.frame_budget(metrics.stage_means(fx.frame_log(spark, sf_dir)), 30)
    return rows.select("session_id", F.round("budget_ms", 6).alias("budget_ms"), F.round("expected_fps", 6).alias("expected_fps"))


@query(f"{WITH_LOG} select frame_stage, count(frame_age) as n, round(quantile_cont(frame_age, 0.5), 9) as p50, round(quantile_cont(frame_age, 0.95), 9) as p95, max(frame_age) as max from g group by frame_stage")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.latency_percentiles(fx.frame_log(spark, sf_dir), ["frame_stage"], "frame_age"), "p50", "p95")


@query(f"{WITH_LOG} select frame_stage, count(frame_age) as n, max(frame_age) as max, true as within from g group by frame_stage")
def fleet_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by session, stage and hour, merged by stage; ``within``: the ranks of p50 and p95, counted over all samples, are off by 1 % at most."""
    log = fx.frame_log(spark, sf_dir)
    kept = sketches.sketched(log, ["session_id", "frame_stage"], "frame_age", "captured_at", k=800)
    found = sketches.percentiles(kept, ["frame_stage"], k=800)
    return found.join(sketches.measured_error(log, ["frame_stage"], "frame_age", found), "frame_stage").select("frame_stage", "n", "max", (F.col("error") <= 0.01).alias("within"))


@query(f"{WITH_LOG} select session_id, count(frame_age) as n, count(case when frame_age <= cast(0.05 as double) then 1 end) as fresh, true as within from g group by session_id")
def fleet_share_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of fresh frames by session from sketches by hour; ``within``: it is off by 1 % at most from what is counted."""
    log = fx.frame_log(spark, sf_dir)
    kept = sketches.sketched(log, ["session_id", "frame_stage"], "frame_age", "captured_at", k=800)
    counted = log.groupBy("session_id").agg(F.count_if(F.col("frame_age") <= 0.05).alias("fresh"))
    met = sketches.share_within(kept, ["session_id"], 0.05, k=800).join(counted, "session_id")
    return met.select("session_id", "n", "fresh", (F.abs(F.col("share") - F.col("fresh") / F.col("n")) <= 0.01).alias("within"))


# --- windows


@query(f"{WITH_LOG} select session_id, frame_index, dropped from {TAKEN} t")
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.taken_log(spark, sf_dir).select(*KEY, "dropped")


OVER = "over (partition by session_id order by frame_index rows between {n} preceding and current row)"


@query(f"""{WITH_LOG} select session_id, frame_index, {', '.join(f"round(last_value({n} ignore nulls) over (partition by session_id order by frame_index rows between unbounded preceding and current row), 9) as {n}" for n in (s.replace('_seconds', '_rolling') for s in windows.SIZES))} from
 (select session_id, frame_index, {', '.join(f"case when {s} is not null then avg({s}) over (partition by session_id, {s} is not null order by frame_index rows between {k - 1} preceding and current row) end as {s.replace('_seconds', '_rolling')}" for s, k in windows.SIZES.items())} from g) t""")
def rolling_stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [s.replace("_seconds", "_rolling") for s in windows.SIZES]
    return _rounded(windows.rolling_stage_means(fx.frame_log(spark, sf_dir)).select(*KEY, *names), *names)


@query(f"""{WITH_LOG} select session_id, frame_index, round(coalesce(last_value(m ignore nulls) over (partition by session_id order by frame_index rows between unbounded preceding and current row), 0), 6) as model_fps, round(o, 6) as output_fps from
 (select session_id, frame_index, case when pose_seconds is not null then count(pose_seconds) over w / greatest(sum(pose_seconds) over w, cast(0.000001 as double)) end as m,
  count(loop_seconds) {OVER.format(n=59)} / greatest(sum(loop_seconds) {OVER.format(n=59)}, cast(0.000001 as double)) as o
  from g window w as (partition by session_id, pose_seconds is not null order by frame_index rows between 29 preceding and current row)) t""")
def rolling_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.rolling_fps(fx.frame_log(spark, sf_dir)).select(*KEY, "model_fps", "output_fps")
    return rows.withColumns({n: F.round(n, 6) for n in ("model_fps", "output_fps")})


@query(f"""{WITH_LOG} select session_id, frame_index, round(quantile_cont(frame_age, 0.5) {OVER.format(n=119)}, 9) as age_p50, round(quantile_cont(frame_age, 0.95) {OVER.format(n=119)}, 9) as age_p95, round(quantile_cont(inference_wait, 0.95) {OVER.format(n=119)}, 9) as wait_p95 from g""")
def rolling_age_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.rolling_age_percentiles(fx.frame_log(spark, sf_dir)).select(*KEY, "age_p50", "age_p95", "wait_p95")
    return _rounded(rows, "age_p50", "age_p95", "wait_p95")


@query(f"{WITH_LOG} select session_id, frame_index, max(greatest(0, latest_sequence - sequence)) {OVER.format(n=119)} as max_lag from g")
def rolling_max_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_max_lag(fx.frame_log(spark, sf_dir)).select(*KEY, "max_lag")


@query(f"""{ASSESSED}, m as (select b.session_id, b.frame_index, k.joint || '|' || k.edge as mark from bounds b join kept k on k.pose_id = b.pose_id),
 o as (select b.session_id, b.frame_index, exists(select 1 from m where m.session_id = b.session_id and m.frame_index = b.frame_index) as hit,
  exists(select 1 from m join m p on p.session_id = m.session_id and p.mark = m.mark and p.frame_index = m.frame_index - 1 where m.session_id = b.session_id and m.frame_index = b.frame_index) as again from bounds b),
 i as (select *, sum(case when again then 0 else 1 end) over (partition by session_id order by frame_index) as island from o),
 k2 as (select *, case when hit then row_number() over (partition by session_id, island order by frame_index) else 0 end as streak from i)
 select session_id, count(case when again then 1 end) as repeated, cast(max(streak) as bigint) as max_streak from k2 group by session_id""")
def edge_repeat_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.edge_repeat_streaks(_assessed(spark, sf_dir))


@query(f"""{WITH_LOG} select session_id, frame_index, round(d + greatest(cast(0 as double), max(slack) over (partition by session_id order by frame_index)), 9) as released_at from
 (select session_id, frame_index, d, cast(row_number() over (partition by session_id order by frame_index) - 1 as double) / 30 - d as slack from
 (select session_id, frame_index, sum(decode_seconds) over (partition by session_id order by frame_index rows between unbounded preceding and current row) as d from g) t) u""")
def paced_capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeline.paced_capture_times(fx.frame_log(spark, sf_dir), 30).select(*KEY, "released_at"), "released_at")


@query(f"""{WITH_LOG}, t as {TAKEN} select session_id, frame_index, captured, processed, skipped, round(cast(100 as double) * skipped / greatest(captured, 1), 9) as drop_pct from
 (select *, greatest(dropped, captured - processed) as skipped from (select session_id, frame_index, max(latest_sequence) {OVER.format(n='unbounded')} + 1 as captured, count(*) {OVER.format(n='unbounded')} as processed, cast(sum(dropped) {OVER.format(n='unbounded')} as bigint) as dropped from t) u) v""")
def live_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.live_totals(fx.taken_log(spark, sf_dir)).select(*KEY, "captured", "processed", "skipped", "drop_pct"), "drop_pct")
