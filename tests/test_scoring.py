"""Models on batches of one size, whatever the batches that Arrow hands over."""

import cProfile
import gc
import pstats
import time
import weakref

import pandas as pd
import pytest

from athletrack.sources import io

OUT = "frame_index bigint, score double, width bigint, rows bigint, sizes bigint"


def _factory():
    def make():  # local, so that it travels to the workers by value
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            assert list(batch.index) == list(range(len(batch)))
            width = batch["crop_width"]
            return pd.DataFrame({"frame_index": batch["frame_index"], "score": batch["frame_index"] / 2, "width": width, "rows": len(batch), "sizes": width.nunique(dropna=False)})

        return model

    return make


_model = _factory()


@pytest.fixture(scope="module")
def frames(spark):
    box = lambda k: None if k % 11 == 0 else (0, 0, 100 + k % 3, 50)
    rows = spark.createDataFrame([(k, box(k)) for k in range(1000)], "frame_index long, crop struct<x1:int,y1:int,x2:int,y2:int>")
    return io.crop_size(rows).coalesce(1)


@pytest.mark.parametrize("arrow", [3, 64, 10_000])
def test_predictions_do_not_depend_on_the_batches(spark, frames, arrow):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        got = io.score_frames(frames, _model, OUT, infer_every=2, batch_size=16, same=["crop_width", "crop_height"], seconds="spent").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["frame_index"], r["score"]) for r in got) == [(k, k / 2) for k in range(0, 1000, 2)]
    assert all(r["sizes"] == 1 and r["rows"] <= 16 and r["spent"] >= 0 for r in got)
    by_size = {}
    for r in got:
        by_size.setdefault(r["width"], []).append(r["rows"])
    assert len(by_size) == 4 and all(sum(n < 16 for n in rows) < 16 for rows in by_size.values())  # one call of fewer rows by size


def test_many_sizes_stay_bounded(spark):
    rows = spark.createDataFrame([(k, k % 500, 1) for k in range(3000)], "frame_index long, crop_width long, crop_height long").coalesce(1)
    got = io.score_frames(rows, _model, OUT, batch_size=50, same=["crop_width"]).collect()
    assert sorted(r["frame_index"] for r in got) == list(range(3000)) and all(r["sizes"] == 1 for r in got)


def test_without_groups_and_empty_tables(spark, frames):
    got = io.score_frames(frames, _model, OUT, batch_size=300).collect()
    assert sorted({r["rows"] for r in got}) == [100, 300] and len(got) == 1000
    assert io.score_frames(frames.limit(0), _model, OUT, batch_size=300, seconds="s").count() == 0
    assert len(io.score_frames(frames, _model, OUT, seconds="s").collect()) == 1000
    for wrong in ({"batch_size": 0}, {"same": ["crop_width"]}, {"infer_every": 0}):
        with pytest.raises(ValueError):
            io.score_frames(frames, _model, OUT, **wrong)


def test_equal_sizes_meet_from_all_partitions(spark):
    rows = spark.createDataFrame([(k, k % 500, 1) for k in range(6000)], "frame_index long, crop_width long, crop_height long").repartition(8)
    got = io.score_frames(rows, _model, OUT, batch_size=4, same=["crop_width"]).collect()
    assert sorted(r["frame_index"] for r in got) == list(range(6000))
    assert all(r["rows"] == 4 and r["sizes"] == 1 for r in got)  # 12 of each size


def test_a_size_that_most_crops_have_is_scored_by_all_tasks(spark):
    width = lambda k: None if k % 9 == 0 else k if k % 10 == 0 else 7
    rows = spark.createDataFrame([(k, width(k), None if width(k) else 7) for k in range(4000)], "frame_index long, crop_width long, crop_height long").repartition(8)
    parts = [p for p in io.dealt(rows, ["crop_width", "crop_height"], 16).select("crop_width").rdd.map(lambda r: r[0]).glom().collect()]
    assert sum(p.count(7) > 400 for p in parts) >= 3
    got = io.score_frames(rows, _model, OUT, batch_size=16, same=["crop_width", "crop_height"]).collect()
    assert sorted(r["frame_index"] for r in got) == list(range(4000)) and all(r["sizes"] == 1 for r in got)
    assert io.dealt(rows.limit(0), ["crop_width"]).count() == 0


class Rows:  # hands back what a task runs
    isStreaming = True
    where = lambda self, _: self
    mapInPandas = lambda self, task, _: task


def test_a_short_call_costs_little_beside_the_model(spark):
    """In Python function calls, which do not vary with the load of the machine."""
    task = io.score_frames(Rows(), lambda: lambda batch: batch, "frame_index bigint, crop_width bigint", batch_size=16, same=["crop_width"], seconds="spent")
    batches = [pd.DataFrame({"frame_index": range(at, at + 2000), "crop_width": [k // 2 for k in range(at, at + 2000)]}) for at in (0, 2000)]
    list(task(iter(batches)))
    profile = cProfile.Profile()
    got = profile.runcall(lambda: list(task(iter(batches))))
    assert sorted(k for out in got for k in out["frame_index"]) == list(range(4000)) and all(out["spent"].notna().all() for out in got)
    assert pstats.Stats(profile).total_calls < 700 * 2000  # 2,000 sizes, a call each


def test_seconds_are_those_of_the_call(spark):
    def make():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            began = time.perf_counter()
            time.sleep(batch["crop_width"].iloc[0] % 7 / 200)
            return pd.DataFrame({"frame_index": batch["frame_index"], "own": (time.perf_counter() - began) / len(batch)})

        return model

    rows = spark.createDataFrame([(k, 1 + k % 40 * (k % 3)) for k in range(300)], "frame_index long, crop_width long")
    got = io.score_frames(rows, make, "frame_index bigint, own double", batch_size=4, same=["crop_width"], seconds="spent").collect()
    assert sorted(r["frame_index"] for r in got) == list(range(300)) and all(r["spent"] >= r["own"] for r in got)


def test_rows_in_any_order_are_split_by_value_nulls_among_themselves():
    batch = pd.DataFrame({"k": range(8), "a": [2.0, None, 1.0, 2.0, None, 1.0, 2.0, 1.0], "b": [1, 1, 1, 1, 1, 1, 2, 1]})
    assert [(key, part["k"].tolist()) for key, part in io.alike(batch, ["a", "b"])] == [((2.0, 1), [0, 3]), ((None, 1), [1, 4]), ((1.0, 1), [2, 5, 7]), ((2.0, 2), [6])]
    assert list(io.alike(batch[:0], ["a", "b"])) == []


def test_waiting_rows_do_not_keep_their_batches(spark):
    class Content:
        pass

    kept = []

    def batches():
        for at in range(0, 60, 6):
            content = [Content() for _ in range(6)]
            kept.append([weakref.ref(c) for c in content])
            yield pd.DataFrame({"frame_index": range(at, at + 6), "crop_width": [at + 1, 0, 0, 0, 0, 0], "content": content})
            del content
            gc.collect()
            assert all(sum(c() is not None for c in refs) <= 2 for refs in kept[:-2])  # of each batch one row by itself and at most one beyond a call's five

    task = io.score_frames(Rows(), lambda: lambda batch: batch[["frame_index"]], "frame_index bigint", batch_size=5, same=["crop_width"])
    assert sorted(k for out in task(batches()) for k in out["frame_index"]) == list(range(60)) and len(kept) == 10
