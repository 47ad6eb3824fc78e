"""The selection rules: k chains of every question.

All rules take a pool with ``qid``, ``tid``, ``teacher`` and ``pos`` (see
``ranks.hashed_position``) and break ties by ``pos``, so results are deterministic.
Signals must be neither null nor NaN in the pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.ranks import norm_rank, oriented

#: Guards the product of a share and a count against falling just below a whole number.
GUARD = 1e-9


def _best(score: Column, *group: str) -> Window:
    return Window.partitionBy(*(group or ("qid",))).orderBy(score.desc(), "pos")


def top_k(pool: DataFrame, signal: str, k: int = 3, direction: str = "max") -> DataFrame:
    """The ``k`` best by ``signal``; ``tie``: the value at place k equals the one after it.

    Only ``k + 1`` rows of a group are moved: the rank filter is applied before the shuffle as well.
    """
    few = top_k_lean(pool, signal, k + 1, direction)
    after = F.max(F.when(F.col("rn") == k + 1, F.col(signal))).over(Window.partitionBy("qid"))
    last = F.max(F.when(F.col("rn") == k, F.col(signal))).over(Window.partitionBy("qid"))
    return few.withColumn("tie", F.coalesce(last == after, F.lit(False))).where(F.col("rn") <= k)


def top_k_lean(pool: DataFrame, signal: str, k: int = 3, direction: str = "max") -> DataFrame:
    """The same chains without the tie flag: the rank filter is applied before the shuffle as well."""
    w = _best(oriented(F.col(signal), direction))
    return pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def random_k(pool: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` in the hashed order."""
    return pool.where(F.col("pos") <= k)


def teacher_first(pool: DataFrame, prefer: list[str] = (), avoid: list[str] = (), k: int = 3) -> DataFrame:
    """Preferred teachers first, avoided ones last, each by ``pos``; a null teacher is in between."""
    group = F.when(F.col("teacher").isin(list(prefer)), 0).when(F.col("teacher").isin(list(avoid)), 2).otherwise(1)
    w = Window.partitionBy("qid").orderBy(group, "pos")
    return pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def rank_sum(pool: DataFrame, signals: dict[str, tuple[float, str]], k: int = 3) -> DataFrame:
    """The ``k`` best by the weighted sum of normalised ranks, rounded to 9 decimals.

    ``signals`` gives weight and direction of each; the weights sum to one.
    """
    if abs(sum(w for w, _ in signals.values()) - 1) > GUARD or any(w < 0 for w, _ in signals.values()):
        raise ValueError("weights are not negative and sum to one")
    total = sum((F.lit(w) * norm_rank(F.col(s), direction=d) for s, (w, d) in signals.items()), F.lit(0.0))
    return top_k(pool.withColumn("rank_sum", F.round(total, 9)), "rank_sum", k)


def veto_count(n: Column, k: Column | int, share: float) -> Column:
    """How many of ``n`` are vetoed: a share rounded down, but no more than leaves ``k``."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.greatest(F.lit(0), F.least(n - k, F.floor(F.lit(share) * n + GUARD).cast("int")))


def veto_top_k(pool: DataFrame, signal: str, veto: str, share: float = 0.3333333333, k: int = 3) -> DataFrame:
    """Drops the worst by ``veto`` (of ties the later ``pos``), then the ``k`` best by ``signal``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    worst = F.row_number().over(Window.partitionBy("qid").orderBy(F.col(veto), F.col("pos").desc()))
    left = pool.withColumns({"_n": n, "_worst": worst}).where(F.col("_worst") > veto_count(F.col("_n"), k, share))
    return top_k_lean(left.drop("_n", "_worst"), signal, k)


def _within_quota(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows whose place ``rn`` among their teacher's is within the number of the teacher's chains that were drawn."""
    quota = drawn.groupBy(F.col("qid").alias("_q"), F.col("teacher").alias("_t")).agg(F.count(F.lit(1)).alias("quota"))
    same = (F.col("qid") == F.col("_q")) & F.col("teacher").eqNullSafe(F.col("_t"))
    return rows.join(quota, same).where(F.col("rn") <= F.col("quota")).drop("_q", "_t")


def within_teacher(pool: DataFrame, signal: str, k: int = 3, direction: str = "max") -> DataFrame:
    """As many chains of each teacher as the first ``k`` by ``pos`` hold, the best by ``signal``.

    No teacher can have more than ``k``, so no more of its chains are moved.
    """
    w = _best(oriented(F.col(signal), direction), "qid", "teacher")
    best = pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return _within_quota(best, random_k(pool, k))


def random_at_signal_shares(pool: DataFrame, signal: str, k: int = 3, direction: str = "max") -> DataFrame:
    """As many chains of each teacher as the ``k`` best by ``signal`` hold, the first by ``pos``."""
    w = Window.partitionBy("qid", "teacher").orderBy("pos")
    first = pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return _within_quota(first, top_k_lean(pool, signal, k, direction).drop("rn"))


def _quota(pool: DataFrame, drawn: Column) -> DataFrame:
    """Adds ``quota``: how many of the teacher's chains the draw holds."""
    share = F.sum(F.when(drawn, 1).otherwise(0)).over(Window.partitionBy("qid", "teacher"))
    return pool.withColumn("quota", share)


def veto_within_teacher(pool: DataFrame, signal: str, veto: str, share: float = 0.3333333333, k: int = 3) -> DataFrame:
    """The veto rule within each teacher, with the teacher's quota of the draw in place of ``k``."""
    quoted = _quota(pool, F.col("pos") <= k)
    w = Window.partitionBy("qid", "teacher")
    worst = F.row_number().over(w.orderBy(F.col(veto), F.col("pos").desc()))
    left = quoted.withColumns({"_n": F.count(F.lit(1)).over(w), "_worst": worst}).where(
        (F.col("quota") > 0) & (F.col("_worst") > veto_count(F.col("_n"), F.col("quota").cast("int"), share))
    )
    best = F.row_number().over(_best(F.col(signal), "qid", "teacher"))
    return left.withColumn("rn", best).where(F.col("rn") <= F.col("quota")).drop("_n", "_worst")


def lark(pool: DataFrame, loss: str = "mean_surprisal", brier: str = "brier") -> DataFrame:
    """Adds ``ghat``: ``l/L * (2r - R/L)`` with ``r = brier/loss``, L the question's loss, R its sum of ``r*l``.

    ``r`` is 0 where the loss is (almost) 0; a question without loss has NaN.
    """
    w = Window.partitionBy("qid")
    tiny = F.lit(1e-30)
    rho = F.when(F.col(loss) <= tiny, 0.0).otherwise(F.col(brier) / F.nullif(F.col(loss), F.lit(0.0)))
    total, weighted = F.sum(loss).over(w), F.sum(rho * F.col(loss)).over(w)
    safe = F.nullif(total, F.lit(0.0))
    ghat = F.when(total <= tiny, F.lit(float("nan"))).otherwise(F.col(loss) / safe * (2 * rho - weighted / safe))
    return pool.withColumn("ghat", ghat)


def lark_weights(pool: DataFrame, b: int = 3) -> DataFrame:
    """The ``b`` best by ``ghat`` with soft weights that sum to ``b``: the distance to the best one left out.

    Equal weights where all chains are taken or the distances vanish; NaN is never taken.
    """
    valid = pool.where(~F.isnan("ghat"))
    w = Window.partitionBy("qid")
    ranked = valid.withColumns({"rn": F.row_number().over(_best(F.col("ghat"))), "_n": F.count(F.lit(1)).over(w)})
    cut = F.max(F.when(F.col("rn") == b + 1, F.col("ghat"))).over(w)
    ranked = ranked.withColumn("_gap", F.col("ghat") - cut).where(F.col("rn") <= b)
    total = F.sum("_gap").over(w)
    even = F.lit(1.0) / F.least(F.col("_n"), F.lit(b))
    weight = F.when((F.col("_n") <= b) | (total <= 1e-12), even).otherwise(F.col("_gap") / F.nullif(total, F.lit(0.0)))
    return ranked.withColumn("weight", weight * b).drop("_n", "_gap")
