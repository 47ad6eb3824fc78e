"""Accuracy of generations: per question, per run, pooled over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ["tag", "seed", "benchmark"]


def first_samples(generations: DataFrame, k: int = 4) -> DataFrame:
    """Samples numbered below ``k``; of repeated (run, question, sample) the greatest ``gen_id`` counts."""
    keys = [*RUN, "qid", "sample"]
    w = Window.partitionBy(*keys).orderBy(F.col("gen_id").desc())
    rows = generations.where(F.col("sample") < k).withColumn("_n", F.row_number().over(w))
    return rows.where("_n = 1").drop("_n")


def question_accuracy(generations: DataFrame, k: int = 4) -> DataFrame:
    """Share of correct samples of every question of a run that has all ``k``; null counts as wrong."""
    right = F.coalesce(F.col("correct").cast("int"), F.lit(0))
    return (
        first_samples(generations, k)
        .groupBy(*RUN, "qid")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("hits"))
        .where(F.col("n") == k)
        .select(*RUN, "qid", (F.col("hits") / F.lit(float(k))).alias("acc"), (F.col("hits") > 0).alias("solved"))
    )


def run_accuracy(generations: DataFrame, k: int = 4) -> DataFrame:
    """``acc`` and ``passed`` (any sample right) of every run, over its complete questions."""
    return (
        question_accuracy(generations, k)
        .groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("n_questions"),
            F.avg("acc").alias("acc"),
            F.avg(F.col("solved").cast("double")).alias("passed"),
        )
    )


def pooled_question_accuracy(generations: DataFrame, k: int = 4) -> DataFrame:
    """Mean over the seeds of a tag and benchmark, of questions complete in every one of its seeds."""
    each = question_accuracy(generations, k)
    seeds = each.select("tag", "benchmark", "seed").distinct().groupBy("tag", "benchmark").agg(F.count(F.lit(1)).alias("s"))
    return (
        each.groupBy("tag", "benchmark", "qid")
        .agg(F.avg("acc").alias("acc"), F.count(F.lit(1)).alias("m"))
        .join(seeds, ["tag", "benchmark"])
        .where("m = s")
        .select("tag", "benchmark", "qid", "acc")
    )


def paired(pooled: DataFrame, tag_a: str, tag_b: str) -> DataFrame:
    """Questions of both tags, with both accuracies."""
    a = pooled.where(F.col("tag") == tag_a).select("benchmark", "qid", F.col("acc").alias("a"))
    b = pooled.where(F.col("tag") == tag_b).select("benchmark", "qid", F.col("acc").alias("b"))
    return a.join(b, ["benchmark", "qid"])


def bootstrap(pairs: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Per benchmark the mean difference ``b - a`` with its 95 % interval over resampled questions.

    The questions of a benchmark are sorted, so a seed gives one result.  A
    benchmark with fewer than two questions has null bounds.  Held-out benchmarks
    are bounded in size; each is resampled in one task, in chunks of draws.
    """

    def resample(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("qid")
        diff = (frame["b"] - frame["a"]).to_numpy()
        low = high = None
        if len(diff) >= 2:
            rng = np.random.default_rng(seed)
            means = np.concatenate(
                [diff[rng.integers(0, len(diff), (min(100, draws - at), len(diff)))].mean(1) for at in range(0, draws, 100)]
            )
            low, high = np.percentile(means, [2.5, 97.5])
        row = {"benchmark": frame["benchmark"].iloc[0], "n": len(diff), "diff": diff.mean(), "low": low, "high": high}
        return pd.DataFrame([row]).astype({"low": float, "high": float})

    schema = "benchmark string, n bigint, diff double, low double, high double"
    return pairs.groupBy("benchmark").applyInPandas(resample, schema)


def length_split(generations: DataFrame, tag_a: str, tag_b: str, cap: int = 3072, k: int = 4) -> DataFrame:
    """Difference ``b - a`` by whether a question has a capped sample in either tag; parts add to the whole.

    ``contribution`` is the group's share of questions times its difference.
    """
    pooled = pooled_question_accuracy(generations, k)
    both = paired(pooled, tag_a, tag_b)
    is_cut = F.coalesce(~F.col("stopped"), F.lit(False)) & (F.col("n_tokens") >= cap)
    cut = (
        first_samples(generations, k)
        .where(F.col("tag").isin(tag_a, tag_b) & is_cut)
        .select("benchmark", "qid")
        .distinct()
        .withColumn("cut", F.lit("cut"))
    )
    marked = both.join(cut, ["benchmark", "qid"], "left").fillna("clean", "cut")
    whole = Window.partitionBy("benchmark")
    parts = marked.groupBy("benchmark", "cut").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("b") - F.col("a")).alias("diff"))
    parts = parts.withColumn("contribution", F.col("n") / F.sum("n").over(whole) * F.col("diff"))
    total = marked.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("b") - F.col("a")).alias("diff"))
    total = total.select("benchmark", F.lit("all").alias("cut"), "n", "diff", F.col("diff").alias("contribution"))
    return parts.select("benchmark", "cut", "n", "diff", "contribution").unionByName(total)
