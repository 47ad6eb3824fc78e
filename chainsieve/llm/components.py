"""Connected components of a graph given by its links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsieve.session import checkpoint_dir


def _large_star(links: DataFrame) -> DataFrame:
    """Connects every larger neighbour of a node to the least node around."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connects the smaller neighbours of a node, and the node, to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``grp`` (the least node of its component) of every node in ``links``.

    ``links`` has 64-bit columns ``a > b``.  Every round is cut from its past by a
    checkpoint in the shared folder; it ends when a round changes nothing, after a
    number of rounds that grows with the logarithm of the longest path.
    """
    checkpoint_dir(spark)
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    current = links.checkpoint()
    before = None
    for _ in range(rounds):
        current = _small_star(_large_star(current)).checkpoint()
        after = current.agg(state.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("grp")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("grp")).distinct()
    )
