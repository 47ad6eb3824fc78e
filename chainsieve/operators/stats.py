"""Rank correlation, agreement and interval statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.ranks import average_rank


def pearson(x: Column, y: Column) -> Column:
    """Aggregate expression of the correlation; null where a side is constant up to rounding."""
    wide = lambda c: F.stddev_pop(c) > 1e-12 * F.greatest(F.abs(F.avg(c)), F.lit(1e-300))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(wide(x) & wide(y), F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def spearman_within(df: DataFrame, x: str, y: str, group: str = "qid", least: int = 3) -> DataFrame:
    """Correlation of the ranks of ``x`` and ``y`` in every group of at least ``least`` rows.

    Rows with a null on either side are left out; a constant side gives null.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(
        group, average_rank(F.col(x), group).alias("_x"), average_rank(F.col(y), group).alias("_y")
    )
    return (
        ranked.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_x"), F.col("_y")).alias("rho"))
        .where(F.col("n") >= least)
    )


def pair_agreement(df: DataFrame, x: str, y: str, group: str = "qid") -> DataFrame:
    """Over unordered pairs of one group: pairs ordered alike, unlike, and tied in x or in y.

    Rows with equal values are counted together first, so what is compared are the
    distinct value pairs of a group, not its rows; meant for scores of few levels.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, x, y)
    cells = rows.groupBy(group, x, y).agg(F.count(F.lit(1)).alias("c"))
    a, b = cells.alias("a"), cells.alias("b")
    both = a.join(b, F.col(f"a.{group}") == F.col(f"b.{group}"))
    weight = F.col("a.c") * F.col("b.c")
    up = F.col(f"a.{x}") < F.col(f"b.{x}")
    same = F.sum(F.when(up & (F.col(f"a.{y}") < F.col(f"b.{y}")), weight).otherwise(0))
    unlike = F.sum(F.when(up & (F.col(f"a.{y}") > F.col(f"b.{y}")), weight).otherwise(0))
    orders = both.groupBy(F.col(f"a.{group}").alias(group)).agg(same.alias("same"), unlike.alias("diff"))
    pairs = lambda *by: (
        rows.groupBy(group, *by)
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(group)
        .agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("bigint").alias("ties"))
    )
    return (
        orders.join(pairs(x).withColumnRenamed("ties", "tie_a"), group)
        .join(pairs(y).withColumnRenamed("ties", "tie_b"), group)
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("same", "diff", "tie_a", "tie_b")])
        .withColumn("rate", F.col("same") / F.nullif(F.col("same") + F.col("diff"), F.lit(0)))
    )


def top_one_agreement(df: DataFrame, x: str, y: str, group: str = "qid", item: str = "pos") -> DataFrame:
    """Groups of two and more whose first best by ``x`` also has the best ``y``."""
    w = Window.partitionBy(group)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns(
        {
            "_rn": F.row_number().over(w.orderBy(F.col(x).desc(), item)),
            "_top": F.max(y).over(w),
            "_n": F.count(F.lit(1)).over(w),
        }
    )
    hit = (F.col(y) == F.col("_top")).cast("bigint")
    return rows.where("_rn = 1 and _n >= 2").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(hit).alias("n_hits"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null where ``n`` is 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(m.isNotNull(), low), F.when(m.isNotNull(), high)


def auc(df: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """Area under the curve by rank sums, ties counting half; null where a class is missing.

    Ranks come from value counts, so no group is ever sorted row by row.
    """
    keys = list(group)
    one = F.col(label).cast("int")
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("c"), F.sum(one).alias("p")
    )
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn("r", F.coalesce(before, F.lit(0)) + (F.col("c") + 1) / F.lit(2.0))
    positives, all_rows = F.sum("p"), F.sum("c")
    area = (F.sum(F.col("p") * F.col("r")) - positives * (positives + 1) / 2) / F.nullif(
        positives * (all_rows - positives), F.lit(0)
    )
    found = ranked.groupBy(*keys) if keys else ranked
    return found.agg(area.alias("auc"))


def kappa(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cohen's kappa of two labels; null where chance agreement is complete."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(x) == F.col(y), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col(x).alias("v")).agg(F.sum("c").alias("a"))
    right = cells.groupBy(F.col(y).alias("v")).agg(F.sum("c").alias("b"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return total.crossJoin(F.broadcast(chance)).select("n", ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def overlap_matrix(selections: DataFrame) -> DataFrame:
    """Of every two selections (column ``tag``) the share of the first's chains that the second has too."""
    a, b = selections.alias("a"), selections.alias("b")
    both = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.tid") == F.col("b.tid")))
    shared = both.groupBy(F.col("a.tag").alias("tag_a"), F.col("b.tag").alias("tag_b")).agg(F.count(F.lit(1)).alias("n"))
    sizes = selections.groupBy("tag").agg(F.count(F.lit(1)).alias("size"))
    return shared.join(F.broadcast(sizes), F.col("tag_a") == F.col("tag")).select(
        "tag_a", "tag_b", "n", (100.0 * F.col("n") / F.col("size")).alias("percent")
    )


def same_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per question of both selections: chains in both, and whether the sets are equal."""
    a = left.select("qid", "tid", F.lit(1).alias("a"))
    b = right.select("qid", "tid", F.lit(1).alias("b"))
    both = a.join(b, ["qid", "tid"], "full").fillna(0, ["a", "b"])
    return (
        both.groupBy("qid")
        .agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("shared"))
        .where("na > 0 and nb > 0")
        .select("qid", "shared", ((F.col("shared") == F.col("na")) & (F.col("na") == F.col("nb"))).alias("same"))
    )
