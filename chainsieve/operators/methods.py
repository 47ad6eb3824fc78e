"""The named selection methods: a rule with its parameters each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.operators import pool as pools
from chainsieve.operators import rules
from chainsieve.operators.ranks import usable

#: Signals of which less is better.
LESS_IS_BETTER = frozenset({"rsr"})
DROP = 0.3333333333


def direction(signal: str) -> str:
    return "min" if signal in LESS_IS_BETTER else "max"


def top(signal: str) -> Callable[[DataFrame, int], DataFrame]:
    """Top-k by a signal over the chains that have it."""
    return lambda pool, k: rules.top_k_lean(pool.where(usable(F.col(signal).cast("double"))), signal, k, direction(signal))


@dataclass(frozen=True)
class Method:
    """A rule on the pool of judged chains; ``exclude`` drops teachers before it."""

    rule: Callable[[DataFrame, int], DataFrame]
    exclude: tuple[str, ...] = field(default=())
    exploratory: bool = False


METHODS: dict[str, Method] = {
    "correct_only": Method(rules.random_k),
    "correct_only_noqwen": Method(rules.random_k, ("qwen72b",)),
    "grape": Method(top("grape")),
    "grape_noqwen": Method(top("grape"), ("qwen72b",)),
    "rsr": Method(top("rsr")),
    "token_length": Method(top("n_tokens")),
    "local_naturalness": Method(top("local_nat")),
    "quality": Method(top("qual")),
    "lark": Method(lambda p, k: rules.lark_weights(rules.lark(p), k)),
    "rank_sum": Method(lambda p, k: rules.rank_sum(p, {"grape": (0.5, "max"), "qual": (0.5, "max")}, k)),
    "rank_sum_judge": Method(lambda p, k: rules.rank_sum(p, {"grape": (0.5, "max"), "llm_score": (0.5, "max")}, k)),
    "veto": Method(lambda p, k: rules.veto_top_k(p, "grape", "qual", DROP, k)),
    "veto_judge": Method(lambda p, k: rules.veto_top_k(p, "grape", "llm_score", DROP, k)),
    "veto_judge_noqwen": Method(lambda p, k: rules.veto_top_k(p, "grape", "llm_score", DROP, k), ("qwen72b",)),
    "veto_judge_within_teacher": Method(lambda p, k: rules.veto_within_teacher(p, "grape", "llm_score", DROP, k)),
    "quality_within_teacher": Method(lambda p, k: rules.within_teacher(p, "qual", k)),
    "familiarity_within_teacher": Method(lambda p, k: rules.within_teacher(p, "grape", k)),
    "random_at_grape": Method(lambda p, k: rules.random_at_signal_shares(p, "grape", k), exploratory=True),
    "teacher_qwen_first": Method(lambda p, k: rules.teacher_first(p, ["qwen72b"], [], k), exploratory=True),
    "teacher_llama_first": Method(lambda p, k: rules.teacher_first(p, ["llama70b"], [], k), exploratory=True),
    "teacher_deepseek_first": Method(lambda p, k: rules.teacher_first(p, ["deepseek"], [], k), exploratory=True),
    "teacher_qwen_last": Method(lambda p, k: rules.teacher_first(p, [], ["qwen72b"], k), exploratory=True),
}


def select(pool: DataFrame, method: str, k: int = 3) -> DataFrame:
    """``qid`` and ``tid`` of the chains a method takes.

    Teachers are dropped after ranks and positions are fixed; the positions of what
    is left keep their order and are numbered anew.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {sorted(METHODS)}")
    chosen = METHODS[method]
    rows = pool
    if chosen.exclude:
        rows = pools.without_teachers(pool, list(chosen.exclude), k)
        from pyspark.sql import Window

        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos")))
    return chosen.rule(rows, k).select("qid", "tid")


def method_list(exploratory: bool = False) -> list[str]:
    """Names of all methods, those of controls only on demand."""
    return [n for n, m in METHODS.items() if exploratory or not m.exploratory]
