"""The most frequent values of each group of a fleet: mergeable counters find them, a second pass counts them exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athletrack.operators.select import top_counts
from athletrack.sources.shared import stored

TRACKED = 1024
BROADCAST = 500_000  # values or groups


def counters(df: DataFrame, by: list[str], value: str, tracked: int = TRACKED) -> DataFrame:
    """(by..., n, top): rows by ``by`` and counters of at most ``tracked`` values, made before the shuffle. A null is a value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{value}`, {int(tracked)})").alias("top"))


def merged_counters(kept: DataFrame, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """Rows of ``counters`` put together by fewer columns; no row is read again."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(top, {int(tracked)})").alias("top"))


def unseen(tracked: int = TRACKED) -> float:
    """A value that the counters don't name makes up no more than this share of its group (twice the published error of the sketch)."""
    return 2 * 3.5 * 0.75 / tracked


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _same(columns: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]


def top_values(df: DataFrame, by: list[str], value: str, k: int = 8, tracked: int = TRACKED) -> DataFrame:
    """(by..., value, n, place): the ``k`` most frequent values of each group, equal ones by value, nulls first: the rows of ``top_counts`` over all counts.

    Only values that the counters name are counted again, so rare ones never leave their tasks. A group is settled if
    these are all its values, or the k-th of them has more rows than any other value can have; the others, where no
    value stands out, are counted in full. Null groups and null values count like others; an empty table has no rows.
    """
    if not 1 <= k <= tracked:
        raise ValueError("k must be between 1 and tracked")
    groups = by or ["_all"]
    rows = df.select(*by, value) if by else df.select(F.lit(0).alias("_all"), value)
    kept = stored(counters(rows, groups, value, tracked), "counters")
    named = kept.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("n").alias("_rows"), F.explode(F.expr(f"approx_top_k_estimate(top, {int(tracked)})")).alias("_e"))
    named = named.select(*(f"_{g}" for g in groups), "_rows", F.col("_e.item").alias(f"_{value}"))
    counts = rows.join(_small(named), _same([*groups, value])).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), F.max("_rows").alias("_rows"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), value)))  # at most ``tracked`` rows a group
    ranked = stored(ranked, "counted")
    settled = ranked.groupBy(*groups).agg((F.sum("n") == F.max("_rows")).alias("whole"), (F.max(F.when(F.col("place") == k, F.col("n"))) > F.max("_rows") * unseen(tracked)).alias("above"))
    settled = settled.where("whole or above").select(*(F.col(g).alias(f"_{g}") for g in groups))
    rest = stored(kept.join(settled, _same(groups), "left_anti").select(*(F.col(g).alias(f"_{g}") for g in groups)), "unsettled")
    full = rows.join(_small(rest), _same(groups), "left_semi").groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    found = ranked.where(F.col("place") <= k).join(rest, _same(groups), "left_anti").drop("_rows")
    return found.unionByName(top_counts(full, groups, value, k=k)).select(*by, value, "n", "place")
