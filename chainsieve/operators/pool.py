"""The pools that selection rules draw from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_count(df: DataFrame, least: int, group: str = "qid") -> DataFrame:
    """Rows of groups with at least ``least`` rows, with ``n``, the group's size."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("n", n).where(F.col("n") >= least)


def usable_pool(candidates: DataFrame, quality: DataFrame, least: int = 3) -> DataFrame:
    """Chains with a quality, of questions that have at least ``least`` of them."""
    scored = quality.where("qual is not null").drop("qid")
    return with_count(candidates.join(scored, "tid"), least)


def excluded_chains(candidates: DataFrame, quality: DataFrame) -> DataFrame:
    """``tid`` of the chains without a quality."""
    return candidates.join(quality.where("qual is not null"), "tid", "left_anti").select("tid")


def extended_pool(chains: DataFrame, kept: DataFrame, excluded: DataFrame, complete: bool = True) -> DataFrame:
    """All chains of the ``kept`` questions but the ``excluded`` and blank ones; ``complete``: nor the truncated."""
    pool = chains.join(kept.select("qid").distinct(), "qid", "left_semi").join(
        excluded.select("tid").distinct(), "tid", "left_anti"
    )
    pool = pool.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return pool.where(~F.col("finish_reason").eqNullSafe("length")) if complete else pool


def without_teachers(pool: DataFrame, teachers: list[str], k: int = 3) -> DataFrame:
    """Drops chains of ``teachers``, then questions left with fewer than ``k``; signals stay as they are.

    A null teacher is none of the dropped ones.
    """
    kept = pool.where(~F.coalesce(F.col("teacher").isin(teachers), F.lit(False)))
    return with_count(kept.drop("n"), k)
