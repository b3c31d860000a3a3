"""Sessions, detections, poses and logs derived from the test tables, in SQL that runs in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from athletrack.operators.timeline import dropped_frames

DETECTIONS = """
select l_orderkey % 64 as session_id, cast(floor(l_orderkey / 64.0) as bigint) as frame_index,
 cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as bigint) as det_index,
 cast((l_partkey * 37) % 1280 - 20 - l_quantity * 3 as float) as x1, cast((l_suppkey * 53) % 720 - 40 - l_quantity * 5 as float) as y1,
 cast((l_partkey * 37) % 1280 + 20 + l_quantity * 3 as float) as x2, cast((l_suppkey * 53) % 720 + 40 + l_quantity * 5 as float) as y2,
 cast(1.0 - l_discount * 8 as float) as score, cast(case when l_suppkey % 3 = 0 then 1 else 0 end as bigint) as label,
 1280 as frame_width, 720 as frame_height from {lineitem}
"""

_EVENTS = """
select event_id, user_id as session_id,
 cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_index,
 cast(sum(1 + event_id % 3) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) - 1 as bigint) as sequence,
 value / 1000 as frame_age, cast(event_id % 40 as double) / 1000 as inference_wait,
 case event_type when 'error' then 'detector' when 'purchase' then 'reuse' else 'pose' end as frame_stage,
 case when event_type = 'purchase' then false else event_id % 11 <> 0 end as has_player,
 case when event_type <> 'error' then null when event_id % 5 = 0 then 'scheduled_interval' when event_id % 5 = 1 then 'missing_crop'
      when event_id % 5 = 2 then 'missing_pose' when event_id % 5 = 3 then 'low_keypoints' else 'crop_edge' end as reason,
 cast(event_id % 7 as double) / 1000 as decode_seconds,
 case when event_type = 'error' then cast(200 + event_id % 50 as double) / 1000 end as detector_seconds,
 case when event_type <> 'purchase' then cast(20 + event_id % 13 as double) / 1000 end as pose_seconds,
 cast(event_id % 5 as double) / 1000 as display_seconds, cast(30 + event_id % 9 as double) / 1000 as loop_seconds
 from {events}
"""

FRAME_LOG = f"""
select *, captured_at + inference_wait as loop_started_at, captured_at + inference_wait as inference_started_at, captured_at + frame_age as completed_at,
 captured_at + inference_wait + coalesce(pose_seconds, 0) as pose_ended_at, sequence + event_id % 4 as latest_sequence
 from (select *, cast(sequence as double) / 30 as captured_at from ({_EVENTS}) e) f
"""

SESSIONS = f"""
select session_id, cast(0 as double) as started_at, max(completed_at) as ended_at, cast(3 as double) as warmup_seconds
 from ({FRAME_LOG}) g group by session_id
"""

REQUESTS = f"""
select session_id, event_id as request_id, frame_index, sequence, reason, event_id % 4 <> 3 as accepted, inference_started_at as requested_at,
 detector_seconds as inference_seconds, inference_started_at + detector_seconds as completed_at,
 case when event_id % 10 <> 9 then inference_started_at + detector_seconds + cast(event_id % 6 as double) / 100 end as consumed_at,
 case when event_id % 10 <> 9 then sequence + event_id % 9 end as consumed_sequence
 from ({FRAME_LOG}) g where reason is not null
"""

_CROP = """case when vec_id % 4 = 0 then 0 else 300 - vec_id % 97 end as cx1, case when vec_id % 5 = 0 then 0 else 100 - vec_id % 53 end as cy1,
 case when vec_id % 6 = 0 then 1280 else 980 + vec_id % 89 end as cx2, case when vec_id % 7 = 0 then 720 else 620 + vec_id % 61 end as cy2"""

#: DuckDB's form of the keypoints; in Spark they stay arrays. One row for each keypoint.
KEYPOINTS = f"""
select session_id, pose_id, frame_index, k as kp_index,
 cast((case when vec_id % 4 = 0 then 250 else 640 end) + cast(e[cast(3 * k + 1 as int)] as double) * 900 as float) as x,
 cast((case when vec_id % 5 = 0 then 200 else 360 end) + cast(e[cast(3 * k + 2 as int)] as double) * 700 as float) as y,
 cast(least(cast(1 as double), greatest(cast(0 as double), 0.4 + cast(e[cast(3 * k + 3 as int)] as double) * 3)) as float) as score,
 cast(cx1 as int) as cx1, cast(cy1 as int) as cy1, cast(cx2 as int) as cx2, cast(cy2 as int) as cy2, 1280 as frame_width, 720 as frame_height
 from (select cast(label as bigint) as session_id, vec_id as pose_id, vec_id, embedding as e,
  cast(row_number() over (partition by label order by vec_id) - 1 as bigint) as frame_index, {_CROP} from {{embeddings}}) v,
 (select cast(range as bigint) as k from range(17)) r
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """``ranged``: a task has the orders of a range, in place of those of a hash, so that its boxes are of frames next to each other."""
    lines = table(spark, sf_dir, "lineitem")
    return spark.sql(DETECTIONS, lineitem=lines.repartitionByRange("l_orderkey") if ranged else lines)


def frame_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAME_LOG, events=table(spark, sf_dir, "events"))


def taken_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_frames(frame_log(spark, sf_dir))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SESSIONS, events=table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS, events=table(spark, sf_dir, "events"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses with arrays of keypoints and the crop they were taken from."""
    rows = spark.sql(
        f"select cast(label as bigint) as session_id, vec_id, vec_id as pose_id, cast(0 as bigint) as instance_index, embedding as e, cast(row_number() over (partition by label order by vec_id) - 1 as bigint) as frame_index, {_CROP} from {{embeddings}}",
        embeddings=table(spark, sf_dir, "embeddings"),
    )
    k = F.sequence(F.lit(0), F.lit(16))
    e = lambda i, off: F.get("e", 3 * i + off).cast("double")
    left, top = F.when(F.col("vec_id") % 4 == 0, 250).otherwise(640), F.when(F.col("vec_id") % 5 == 0, 200).otherwise(360)
    points = F.transform(k, lambda i: F.struct((left + e(i, 0) * 900).cast("float").alias("x"), (top + e(i, 1) * 700).cast("float").alias("y")))
    scores = F.transform(k, lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.4) + e(i, 2) * 3)).cast("float"))
    crop = F.struct(*(F.col(f"c{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))
    none = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    return rows.select("session_id", "pose_id", "frame_index", "instance_index", points.alias("keypoints"), scores.alias("scores"), none.alias("bbox"), crop.alias("crop"), F.lit(1280).alias("frame_width"), F.lit(720).alias("frame_height"))
