"""Ranks, positions and scalings inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges below this count as constant.
CONSTANT = 1e-12


def hashed_position(df: DataFrame, group: str = "qid", item: str = "tid", seed: int = 42) -> DataFrame:
    """Adds ``pos`` (1 first), the canonical order of a group: by the SHA-256 of ``seed|item``.

    The order depends on nothing but the seed and the items.  Equal items share
    their hash and are ordered by the item itself.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(item)), 256)
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(key, item)))


#: Blocks of a group that :func:`placed_blocks` ranks apart: one a hexadecimal digit.
DIGITS = "0123456789abcdef"


def placed_blocks(df: DataFrame, least: int = 1, group: str = "qid", item: str = "tid", seed: int = 42) -> DataFrame:
    """Adds ``pos`` as :func:`hashed_position` does, and ``n``, the group's size; groups below ``least`` are dropped.

    Hashes are spread evenly, so a group is cut by their first digit into blocks of
    like size; each is ranked in its own task and shifted by the sizes of the
    blocks before it.  No task sees more than a sixteenth of a group, and rows are placed once.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(item)), 256)
    keyed = df.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, 1))
    block = Window.partitionBy(group, "_b")
    inner = keyed.withColumns(
        {"_rn": F.row_number().over(block.orderBy("_h", item)), "_c": F.count(F.lit(1)).over(block)}
    )
    sizes = inner.where("_rn = 1").select(F.col(group).alias("_g"), F.col("_b").alias("_d"), "_c")
    whole = Window.partitionBy("_g")
    before = F.sum("_c").over(whole.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_g", "_d", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"))
    found = inner.join(shifts.where(F.col("n") >= least), (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_d")))
    pos = (F.col("_rn") + F.col("_before")).cast("int")
    return found.withColumn("pos", pos).drop("_h", "_b", "_rn", "_c", "_g", "_d", "_before")


def minmax(column: Column, group: str = "qid") -> Column:
    """``(x - low) / (high - low)`` within the group; 0.5 where all values are equal.

    Nulls stay null and do not take part in the range.
    """
    w = Window.partitionBy(group)
    low, high = F.min(column).over(w), F.max(column).over(w)
    scaled = F.when(high - low < CONSTANT, 0.5).otherwise((column - low) / F.nullif(high - low, F.lit(0.0)))
    return F.when(column.isNotNull(), scaled)


def oriented(column: Column, direction: str) -> Column:
    """The signal so that more is better: negated where ``direction`` is ``min``."""
    if direction not in ("max", "min"):
        raise ValueError("direction is max or min")
    return -column if direction == "min" else column


def average_rank(column: Column, *group: str) -> Column:
    """1-based ascending rank; ties share the mean of their ranks."""
    ordered = Window.partitionBy(*group).orderBy(column)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, column))
    return F.rank().over(ordered) + (ties - 1) / F.lit(2.0)


def norm_rank(column: Column, group: str = "qid", direction: str = "max") -> Column:
    """Average rank scaled to 0 (worst) .. 1 (best); a group of one has 1.

    The values must be free of nulls and NaN; use :func:`usable` first.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    rank = average_rank(oriented(column, direction), group)
    return F.when(size == 1, 1.0).otherwise((rank - 1) / F.nullif(size - 1, F.lit(0)))


def usable(column: Column) -> Column:
    """Neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column)


def zscored(df: DataFrame, column: str, name: str = "z") -> DataFrame:
    """Adds the z-score over all rows, with the population deviation; 0 where the deviation is 0."""
    scale = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.coalesce((F.col(column) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))
    return df.crossJoin(F.broadcast(scale)).withColumn(name, z).drop("_m", "_s")


def index_percentile(values: Column, share: float) -> Column:
    """The element at index ``min(int(share * n), n - 1)`` of the sorted array ``values``."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    return F.element_at(ordered, F.least(F.floor(F.lit(share) * n).cast("int"), n - 1) + 1)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key of an append log, by ``order``; repeated rows give one."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
