"""The N best items of every group, by a bounded heap per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def latest(df: DataFrame, key: str, time: str, *values: str) -> DataFrame:
    """Per ``key`` the ``values`` of its row with the greatest ``time``.

    Among rows with one ``time`` the greatest values win (null least, NaN
    greatest), so the result never depends on row order.  Null keys are dropped.
    """
    best = F.max(F.struct(F.col(time), *[F.col(v) for v in values])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{v}") for v in values])


def top_n(
    df: DataFrame, groups: list[str], score: Column, item: str, n: int, repeated: bool = True
) -> DataFrame:
    """``groups``, ``item``, ``score`` and ``place`` (1 is best) of the ``n`` best items of every group.

    Scores come first, higher is better; ties go to the smaller ``item`` by code
    points.  Rows whose score is null or NaN and rows with a null item or group
    column take no part; groups with fewer items give what they have.  Repeated
    rows give one; pass ``repeated=False`` where items are unique by construction,
    which saves a shuffle.  A heap of ``n`` entries per group is built on each side
    of the shuffle, so a group of any size sends at most ``n`` entries per task.
    """
    entry = F.struct((-score).alias("low"), F.col(item).alias("item"))
    usable = df.where(score.isNotNull() & ~F.isnan(score) & F.col(item).isNotNull()).dropna(subset=groups)
    entries = usable.select(*groups, entry.alias("_entry"))
    if repeated:
        entries = entries.distinct()
    heap = InternalFunction.collect_top_k(F.col("_entry"), n, True)
    heaps = entries.groupBy(*groups).agg(heap.alias("_heap"))
    return heaps.select(*groups, F.posexplode("_heap").alias("_at", "_e")).select(
        *groups,
        F.col("_e.item").alias(item),
        (-F.col("_e.low")).alias("score"),
        (F.col("_at") + 1).cast("int").alias("place"),
    )
