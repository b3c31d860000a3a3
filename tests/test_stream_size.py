"""What the tracker's streams cost besides the rows: partitions of state, files that wait, code that is compiled."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_loops import CONFIGS, _tables

from athletrack.operators import tracking
from athletrack.plans import stateful
from athletrack.plans.queries import QUERIES
from athletrack.schemas import TrackConfig


@pytest.fixture
def partitions(spark):
    """More partitions than there are pairs of sessions; given back as they were."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    yield 70
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["track_stream", "track_unordered"])
def test_partitions_of_state_follow_the_sessions(spark, sf_dir, partitions, monkeypatch, name):
    folders, made = {}, stateful.new_folder
    monkeypatch.setattr(stateful, "new_folder", lambda s, kind: folders.setdefault(kind, made(s, kind)))
    assert QUERIES[name](spark, sf_dir).count() == 1_500
    checkpoint = next(f for kind, f in folders.items() if kind.endswith("-checkpoint")).removeprefix("file:")
    assert 0 < len(glob.glob(f"{checkpoint}/state/0/[0-9]*")) <= 32  # 64 sessions
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(partitions)


def test_a_task_stages_rows_of_few_arrivals(spark, sf_dir, partitions):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for rows in stateful._raw_rows(spark, sf_dir, TrackConfig(infer_every=2)):
        held = rows.select(F.spark_partition_id().alias("task"), F.floor(F.col("frame_index") / 6).alias("part")).distinct().cache()
        assert held.select("part").distinct().count() == 4
        assert held.count() <= partitions + 3


def test_crops_and_bounds_are_made_once(spark):
    """An expression that is written out for each of its uses is compiled to nothing."""
    f, d, p, _ = _tables(spark, 5, 2)
    rows = tracking.fold_rows(f, d, p, CONFIGS[0], inferred=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    crops = [line for line in plan.splitlines() if "FLOOR" in line.upper() and "found" not in line]
    assert crops and not any("AS found" in line and "FLOOR" in line.upper() for line in plan.splitlines())
    assert not any("AS person" in line and "filter(" in line for line in plan.splitlines())


def test_frames_from_arrays_are_those_of_rows(spark):
    rng = random.Random(3)
    f, d, p, _ = _tables(spark, 11, 1)
    rows = tracking.fold_rows(f, d, p, CONFIGS[0]).where("session_id = 0")
    rows = rows.union(rows.where("frame_index % 5 = 0")).union(rows.where("loop_started_at is null and frame_index % 3 = 0").withColumn("frame_index", F.col("frame_index") + 5_000))  # repeated, and of no frame
    table = rows.collect()
    rng.shuffle(table)
    expected = list(tracking.frames_in(map(tuple, sorted(table, key=lambda r: r["frame_index"]))))
    flat = tracking.flat_rows(spark.createDataFrame(table, rows.schema)).toPandas()
    got = list(tracking.frames_from({c: flat[c].to_numpy() for c in flat.columns}, 0, 7))
    plain = lambda frames: [(k, *t, found, np.nan_to_num(people, nan=-1.0).tolist()) for k, t, found, people in frames]
    assert plain(got) == plain(expected)
