"""Percentiles of a fleet from mergeable sketches: samples are read once, and kept sketches answer for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 200


def rank_error(k: int = K) -> float:
    """How far the rank of a percentile may be off, as a share of the samples, in 99 of 100 cases (published bound of KLL sketches)."""
    return 2.296 / k**0.9723


def _checked(k: int) -> int:
    if not 8 <= k <= 65_535:
        raise ValueError("k must be between 8 and 65535")
    return k


def sketched(df: DataFrame, by: list[str], col: str, at: str | None = None, k: int = K) -> DataFrame:
    """(by..., hour, n, max, sketch): the samples of ``col`` by ``by`` and, where ``at`` names a clock in seconds, by hour.

    Nulls and NaN are no samples; a group without samples has n 0 and null max and sketch; a null clock has a null hour. Sketches are made
    before the shuffle and take a few kilobytes each, however many samples there are.
    """
    value = F.when(~F.isnan(col), F.col(col).cast("double"))
    keys = [*by, *([F.floor(F.col(at) / 3600).cast("bigint").alias("hour")] if at else [])]
    rows = df.groupBy(*keys).agg(F.count(value).alias("n"), F.max(value).alias("max"), F.kll_sketch_agg_double(value, _checked(k)).alias("sketch"))
    return rows.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Rows of ``sketched`` put together by fewer columns: (by..., n, max, sketch). No sample is read again."""
    rows = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", _checked(k)).alias("sketch"))
    return rows.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def _asked(value: Column) -> Column:
    return F.when(F.col("n") > 0, value)


def percentiles(sketches: DataFrame, by: list[str], ps: tuple[float, ...] = (0.5, 0.95), k: int = K) -> DataFrame:
    """(by..., n, p.., max) like ``latency_percentiles``, each percentile a sample whose rank is within ``rank_error(k)``."""
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles are between 0 and 1")
    got = [_asked(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(f"p{round(100 * p)}") for p in ps]
    return merged(sketches, by, k).select(*by, "n", *got, "max")


def share_within(sketches: DataFrame, by: list[str], limit: float, k: int = K) -> DataFrame:
    """(by..., n, share): the share of samples up to ``limit``, within ``rank_error(k)``."""
    return merged(sketches, by, k).select(*by, "n", _asked(F.kll_sketch_get_rank_double("sketch", F.lit(float(limit)))).alias("share"))


def measured_error(df: DataFrame, by: list[str], col: str, found: DataFrame, ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by..., error): how far the ranks of ``found`` (from ``percentiles``) are off at most, counted over all samples.

    A percentile may be any sample whose equal values span its rank. Null keys meet each other.
    """
    named = found.select(*(F.col(b).alias(f"_{b}") for b in by), *(F.col(f"p{round(100 * p)}").alias(f"_p{i}") for i, p in enumerate(ps)))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    met = df.where(F.col(col).isNotNull() & ~F.isnan(col)).join(named, on)
    counts = met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(col) < F.col(f"_p{i}")).alias(f"_lo{i}") for i in range(len(ps))), *(F.count_if(F.col(col) <= F.col(f"_p{i}")).alias(f"_hi{i}") for i in range(len(ps)))
    )
    off = [F.greatest(F.lit(0.0), F.col(f"_lo{i}") / F.col("_n") - p, p - F.col(f"_hi{i}") / F.col("_n")) for i, p in enumerate(ps)]
    return counts.select(*by, F.greatest(*off, F.lit(0.0)).alias("error"))
