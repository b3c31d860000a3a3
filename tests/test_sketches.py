"""Sketches of a fleet against exact percentiles, and the rolling percentiles against windows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from athletrack.operators import sketches, windows


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(5)  # one session has a third of all samples; times span three hours
    return spark.createDataFrame([(0 if i % 3 == 0 else i % 50, i % 4, i / 3.0, r.random() * r.random()) for i in range(30_000)], "session_id long, kind long, at double, age double")


def test_merged_sketches_are_within_the_bound(spark, samples):
    k = 800
    kept = sketches.sketched(samples, ["session_id", "kind"], "age", "at", k)
    assert "hour" in kept.columns
    once = sketches.sketched(samples, ["kind"], "age", k=k)
    for found in (sketches.percentiles(kept, ["kind"], (0.5, 0.95), k), sketches.percentiles(once, ["kind"], (0.5, 0.95), k)):
        errors = sketches.measured_error(samples, ["kind"], "age", found).collect()
        assert len(errors) == 4 and all(r["error"] <= 3 * sketches.rank_error(k) for r in errors)
    whole = sketches.percentiles(kept, [], (0.5,), k).first()
    exact = samples.agg(F.percentile("age", F.lit(0.5)).alias("p"), F.max("age").alias("m"), F.count("age").alias("n")).first()
    assert (whole["n"], whole["max"]) == (exact["n"], exact["m"]) and abs(whole["p50"] - exact["p"]) < 0.02
    share = sketches.share_within(kept, ["kind"], 0.25, k).collect()
    counted = {r["kind"]: r["s"] for r in samples.groupBy("kind").agg((F.count_if(F.col("age") <= 0.25) / F.count("age")).alias("s")).collect()}
    assert all(abs(r["share"] - counted[r["kind"]]) <= 3 * sketches.rank_error(k) for r in share)


def test_sketches_are_much_smaller_than_their_samples(samples):
    size = sketches.sketched(samples, [], "age").select(F.length("sketch")).first()[0]
    assert size < 8_000 < 30_000 * 8


def test_nulls_nans_and_empty_groups(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("a", None, 0.0), ("a", math.nan, 0.0), ("b", None, None), (None, 2.0, None), (None, 4.0, 7200.0)], "kind string, age double, at double")
    got = {r["kind"]: tuple(r)[1:] for r in sketches.percentiles(sketches.sketched(rows, ["kind"], "age", "at"), ["kind"]).collect()}
    assert got["a"] == (1, 1.0, 1.0, 1.0) and got["b"] == (0, None, None, None) and got[None][0] == 2 and got[None][3] == 4.0
    assert sketches.percentiles(sketches.sketched(rows.limit(0), ["kind"], "age"), ["kind"]).count() == 0
    found = sketches.percentiles(sketches.sketched(rows, ["kind"], "age"), ["kind"])
    assert {r["kind"]: r["error"] for r in sketches.measured_error(rows, ["kind"], "age", found).collect()} == {"a": 0.0, None: 0.0}
    with pytest.raises(ValueError):
        sketches.sketched(rows, ["kind"], "age", k=1)
    with pytest.raises(ValueError):
        sketches.percentiles(found, ["kind"], (1.5,))


@pytest.mark.parametrize("k,current", [(120, True), (7, False), (1, True)])
def test_rolling_percentiles_equal_windows(spark, k, current):
    r = random.Random(k)
    value = lambda: r.choice([None, math.nan, *([r.random()] * 4), 0.25])
    log = spark.createDataFrame([(s, i, value(), value(), [s]) for s in (1, 2, None) for i in range(300)], "session_id long, frame_index long, frame_age double, inference_wait double, more array<long>").repartition(5)
    end = 0 if current else -1
    w = Window.partitionBy("session_id").orderBy("frame_index").rowsBetween(end - k + 1, end)
    p = lambda c, q: F.percentile(c, F.lit(q)).over(w)
    plain = log.withColumns({"age_p50": p("frame_age", 0.5), "age_p95": p("frame_age", 0.95), "wait_p95": p("inference_wait", 0.95)})
    tidy = lambda df: sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in row) for row in df.collect())
    assert tidy(windows.rolling_age_percentiles(log, k, current)) == tidy(plain)
    assert windows.rolling_age_percentiles(log.limit(0), k, current).count() == 0
