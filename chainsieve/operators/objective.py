"""Subset objectives over small groups with vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.ranks import minmax


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    length = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(1.0)))


def pair_distances(df: DataFrame, group: str = "qid", pos: str = "pos", vector: str = "vec") -> DataFrame:
    """Euclidean distance ``d`` of every two unit vectors ``i < j`` of a group.

    Meant for groups of bounded size (some ten candidates a question): the join
    is on the group.
    """
    a = df.select(group, F.col(pos).alias("i"), F.col(vector).alias("_u"))
    b = df.select(group, F.col(pos).alias("j"), F.col(vector).alias("_v"))
    d = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(F.col("_u"), F.col("_v"))))
    return a.join(b, group).where("i < j").select(group, "i", "j", d.alias("d"))


def triples(df: DataFrame, group: str = "qid", pos: str = "pos") -> DataFrame:
    """All subsets of three of every group, with ``div``: each member's distance to its nearest in the subset."""
    d = pair_distances(df, group, pos)
    one = d.select(group, F.col("i").alias("p1"), F.col("j").alias("p2"), F.col("d").alias("d12"))
    two = d.select(group, F.col("i").alias("p1"), F.col("j").alias("p3"), F.col("d").alias("d13"))
    three = d.select(group, F.col("i").alias("p2"), F.col("j").alias("p3"), F.col("d").alias("d23"))
    found = one.join(two, [group, "p1"]).where("p2 < p3").join(three, [group, "p2", "p3"])
    div = F.least("d12", "d13") + F.least("d12", "d23") + F.least("d13", "d23")
    return found.select(group, "p1", "p2", "p3", div.alias("div"))


def scored_triples(
    df: DataFrame, a: float, b: float, lam: Column | float, scale: str = "raw", group: str = "qid"
) -> DataFrame:
    """The subsets with ``value = sum(fit^a * qual^b) + lam * div``, rounded to 9 decimals.

    ``scale='minmax'`` scales ``div`` over the group's subsets, 0 where all are equal.
    """
    per = df.select(group, "pos", (F.pow("fit", F.lit(a)) * F.pow("qual", F.lit(b))).alias("g"))
    found = triples(df, group)
    for n in (1, 2, 3):
        found = found.join(per.select(group, F.col("pos").alias(f"p{n}"), F.col("g").alias(f"g{n}")), [group, f"p{n}"])
    if scale == "minmax":
        span = F.max("div").over(Window.partitionBy(group)) - F.min("div").over(Window.partitionBy(group))
        found = found.withColumn("div_scaled", F.when(span < 1e-12, 0.0).otherwise(minmax(F.col("div"), group)))
    else:
        found = found.withColumn("div_scaled", F.col("div"))
    lam = F.lit(lam) if isinstance(lam, (int, float)) else lam
    value = F.round(F.col("g1") + F.col("g2") + F.col("g3") + lam * F.col("div_scaled"), 9)
    return found.withColumn("value", value).select(group, "p1", "p2", "p3", "div", "value")


def best_triple(scored: DataFrame, *group: str) -> DataFrame:
    """The subset of the greatest value of every group; ties go to the first in lexicographic order."""
    keys = list(group or ("qid",))
    entry = F.min_by(F.struct("p1", "p2", "p3", "div", "value"), F.struct((-F.col("value")).alias("v"), "p1", "p2", "p3"))
    return scored.groupBy(*keys).agg(entry.alias("_b")).select(*keys, "_b.*")


def greedy_sets(df: DataFrame, lam: float, k: int = 3, group: str = "qid") -> DataFrame:
    """The set found by adding, from the best single member on, whichever raises the objective most.

    Sequential by nature, so each (bounded) group is worked off in one call.
    """
    import numpy as np
    import pandas as pd

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        vectors = np.array(frame["vec"].tolist())
        gain = (frame["fit"] * frame["qual"]).to_numpy()
        apart = np.sqrt(np.clip(2 - 2 * vectors @ vectors.T, 0, None))
        np.fill_diagonal(apart, np.inf)

        def value(members: list[int]) -> float:
            spread = apart[np.ix_(members, members)].min(1).sum() if len(members) > 1 else 0.0
            return gain[members].sum() + lam * spread

        chosen = [int(gain.argmax())]
        while len(chosen) < min(k, len(frame)):
            best, found = -np.inf, None
            for m in range(len(frame)):
                if m not in chosen and (v := value([*chosen, m])) > best + 1e-12:
                    best, found = v, m
            chosen.append(found)
        return pd.DataFrame({group: frame[group].iloc[0], "pos": frame["pos"].iloc[sorted(chosen)]})

    kinds = dict(df.dtypes)
    return df.groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, pos {kinds['pos']}")
