"""Records of one split that also stand, exactly or almost, in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.bagminhash import AGREE, pairs_across
from chainsieve.session import checkpoint_dir


def canonical(text: Column) -> Column:
    """The words of a text with one space between; null where it has none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", plain)


def _records(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Distinct ``keep`` and ``canon``, with the 128-bit hash of the canonical text."""
    rows = df.select(*keep, canonical(F.col(text)).alias("canon")).where("canon is not null").distinct()
    return rows.withColumn("hash", F.md5("canon"))


def exact_overlap(left: DataFrame, right: DataFrame, text: str, keep: tuple[list[str], list[str]]) -> DataFrame:
    """Rows of both sides whose texts have one canonical form: all ``keep`` columns, distinct."""
    a = _records(left, text, keep[0]).drop("canon")
    b = _records(right, text, keep[1]).drop("canon")
    return a.join(b, "hash").select(*keep[0], *keep[1]).distinct()


def cross_split(
    left: DataFrame, right: DataFrame, text: str, keep: tuple[list[str], list[str]], agree: float = AGREE
) -> DataFrame:
    """Rows of both sides whose texts are equal or agree in ``agree`` of the longer one's words.

    Gives all ``keep`` columns of both sides (their names must differ), distinct.
    Records are brought into canonical form once and hashed: equal hashes join at
    once; the distinct records of the two sides are compared across, never within
    a side.  Null, empty and wordless texts match nothing; null keys are kept like
    values.
    """
    checkpoint_dir(left.sparkSession)
    a = _records(left, text, keep[0]).withColumn("side", F.lit(0))
    b = _records(right, text, keep[1]).withColumn("side", F.lit(1))
    cut = a.unionByName(b, allowMissingColumns=True).checkpoint()
    owners_a = cut.where("side = 0").select("hash", *keep[0])
    owners_b = cut.where("side = 1").select("hash", *keep[1])
    node = F.shiftleft(F.xxhash64("hash"), 1) + F.col("side")
    distinct = cut.groupBy("hash", "side").agg(F.min("canon").alias("canon")).withColumn("node", node)
    near = pairs_across(distinct.select("node", "canon"), "node", "canon", agree)
    marked_a = owners_a.withColumn("even", F.shiftleft(F.xxhash64("hash"), 1)).drop("hash")
    marked_b = owners_b.withColumn("odd", F.shiftleft(F.xxhash64("hash"), 1) + 1).drop("hash")
    almost = marked_a.join(near, "even").join(marked_b, "odd")
    exact = owners_a.join(owners_b, "hash")
    names = [*keep[0], *keep[1]]
    return almost.select(*names).unionByName(exact.select(*names)).distinct()
