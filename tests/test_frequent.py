"""Frequent values by counters and a second pass against counting everything."""

import random

import pytest
from pyspark.sql import functions as F

from athletrack.operators import frequent
from athletrack.operators.select import top_counts


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    skewed = [("hot", f"v{int(1 / (r.random() + 1e-4))}") for _ in range(6000)] + [("hot", None)] * 900
    flat = [("flat", f"w{k % 700}") for k in range(2100)]  # no value stands out
    few = [(None, c) for c in "aabbcc"] + [("one", None)] * 3
    return spark.createDataFrame(skewed + flat + few, "lane string, value string").repartition(6)


def _exact(df, by, k):
    counts = df.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    return sorted(map(str, top_counts(counts, by or [F.lit(0)], "value", k=k).select(*by, "value", "n", "place").collect()))


@pytest.mark.parametrize("by,k,tracked", [(["lane"], 3, 64), (["lane"], 8, 1024), ([], 2, 64), (["lane"], 20, 32)])
def test_frequent_values_equal_counting_everything(rows, by, k, tracked):
    assert sorted(map(str, frequent.top_values(rows, by, "value", k, tracked).collect())) == _exact(rows, by, k)


def test_the_far_side_of_the_broadcast_gives_the_same(rows, monkeypatch):
    monkeypatch.setattr(frequent, "BROADCAST", 0)
    assert sorted(map(str, frequent.top_values(rows, ["lane"], "value", 3, 64).collect())) == _exact(rows, ["lane"], 3)


def test_counters_merge_and_empty_tables(rows):
    dealt = rows.withColumn("day", F.pmod(F.xxhash64("value", F.rand(1)), F.lit(5)))
    whole = frequent.merged_counters(frequent.counters(dealt, ["lane", "day"], "value", 256), ["lane"], 256)
    got = {r["lane"]: (r["n"], r["e"]) for r in whole.select("lane", "n", F.expr("approx_top_k_estimate(top, 2)").alias("e")).collect()}
    assert got["hot"][0] == 6900 and {e["item"] for e in got["hot"][1]} == {"v1", "v2"}
    assert frequent.top_values(rows.limit(0), ["lane"], "value").count() == 0
    with pytest.raises(ValueError):
        frequent.top_values(rows, ["lane"], "value", k=0)
