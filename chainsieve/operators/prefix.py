"""Distributed running sums over groups that may not fit into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.session import checkpoint_dir

#: Blocks a hot group is cut into.
BLOCKS = 64


def running_sums(
    df: DataFrame,
    group: str,
    order: str,
    tie: str,
    sums: dict[str, str],
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Inclusive running sums of ``sums`` (input column -> output column) per ``group``.

    Rows are ordered by the numeric column ``order``, then ``tie``.  A group with
    more than ``block_rows`` rows is cut at approximate quantiles of ``order`` into
    blocks; each block is summed in its own task and shifted by the totals of the
    blocks before it.  The quantiles only decide where blocks begin, so the sums are
    exact.  Only block totals are ever sorted together; how the few cuts of the hot
    groups (at most rows / ``block_rows`` of them) are joined is left to the optimizer.  Null ``group``
    values form a group of their own; an empty input gives an empty result.  The
    input is read several times and is therefore cut from its past first.
    """
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    hot = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    if hot.isEmpty():  # every group fits into a task: the same sums by one window
        whole = Window.partitionBy(group).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(whole).alias(o) for c, o in sums.items()])
    steps = [i / BLOCKS for i in range(1, BLOCKS)]
    cuts = (
        df.join(hot.select(group), group, "left_semi")
        .groupBy(group)
        .agg(F.percentile_approx(order, F.array(*map(F.lit, steps)), 1000).alias("_cuts"))
    )
    keyed = df.join(cuts.withColumnRenamed(group, "_g"), F.col(group) == F.col("_g"), "left").drop("_g")
    block = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(order)))
    keyed = keyed.withColumn("_block", block).drop("_cuts")
    inner = Window.partitionBy(group, "_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("*", *[F.sum(c).over(inner).alias(f"_run_{o}") for c, o in sums.items()])
    totals = keyed.groupBy(group, "_block").agg(*[F.sum(c).alias(f"_tot_{o}") for c, o in sums.items()])
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        totals.where("_block is not null")
        .select(
            F.col(group).alias("_g"),
            F.col("_block").alias("_b"),
            *[F.coalesce(F.sum(f"_tot_{o}").over(before), F.lit(0)).alias(f"_shift_{o}") for o in sums.values()],
        )
        .where("_b > 0")
    )
    joined = local.join(
        shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")), "left"
    )
    out = joined
    for o in sums.values():
        out = out.withColumn(o, F.col(f"_run_{o}") + F.coalesce(f"_shift_{o}", F.lit(0)))
    drop = ["_block", "_g", "_b", *[f"_run_{o}" for o in sums.values()], *[f"_shift_{o}" for o in sums.values()]]
    return out.drop(*drop)
