"""Deterministic samples by hashed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(item: str, seed: int = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(item)), 256)


def first_by_hash(df: DataFrame, item: str, n: int, *strata: str, seed: int = 42) -> DataFrame:
    """The first ``n`` of every stratum in hashed order; smaller strata whole.  Null strata count as one."""
    w = Window.partitionBy(*strata).orderBy(hashed(item, seed), item)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def allocation(sizes: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """``n`` places shared in proportion to ``size``; the largest remainders get the rest, ties by name."""
    whole = Window.partitionBy()
    exact = F.col(size) * F.lit(n) / F.sum(size).over(whole)
    base = sizes.select(stratum, F.floor(exact).alias("quota"), (exact - F.floor(exact)).alias("part"))
    place = F.row_number().over(whole.orderBy(F.round("part", 9).desc(), stratum))
    rest = F.lit(n) - F.sum("quota").over(whole)
    return base.select(stratum, (F.col("quota") + F.when(place <= rest, 1).otherwise(0)).cast("bigint").alias("quota"))


def proportional(df: DataFrame, item: str, stratum: str, n: int) -> DataFrame:
    """A sample of ``n`` with every stratum in proportion, by hashed order within it."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    quotas = allocation(sizes, stratum, "_size", n)
    w = Window.partitionBy(stratum).orderBy(hashed(item), item)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .join(F.broadcast(quotas), stratum)
        .where(F.col("_rn") <= F.col("quota"))
        .drop("_rn", "quota")
    )


def whole_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """Whole groups in hashed order while fewer than ``n`` rows are taken; the crossing group is kept.

    Only group sizes are sorted together.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy(hashed(group), group).rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < n)
    return df.join(kept.select(group), group, "left_semi")


def equal_per_group(df: DataFrame, item: str, group: str, n: int) -> DataFrame:
    """``max(1, n // groups)`` of every group by hashed order, then the first ``n`` of all."""
    groups = df.select(F.count_distinct(group).alias("_groups"))
    each = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.col("_groups"), F.lit(1)))).cast("int")
    w = Window.partitionBy(group).orderBy(hashed(item), item)
    taken = df.withColumn("_rn", F.row_number().over(w)).crossJoin(F.broadcast(groups)).where(F.col("_rn") <= each)
    return taken.drop("_rn", "_groups").orderBy(hashed(item), item).limit(n)
