"""The tables as the core reads them, in Spark and as SQL text that the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainsieve.operators.ranks import last_per_key, placed_blocks, usable
from chainsieve.sources.tables import table

K = 3


def chains(spark: SparkSession, root: str, text: bool = False) -> DataFrame:
    """Candidates, each once; their texts are read and shuffled only on demand.

    Rows are placed by ``tid`` before equal ones are dropped, so that the joins on it
    that follow need no other shuffle.
    """
    rows = table(spark, root, "candidates")
    return (rows if text else rows.drop("text")).repartition("tid").distinct()


def fits(spark: SparkSession, root: str) -> DataFrame:
    """The last fit row of every chain."""
    return last_per_key(table(spark, root, "fit"), ["tid"], ["ts", "grape", "rsr", "n_tokens"])


def quality(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "quality").repartition("tid").distinct()


def generations(spark: SparkSession, root: str, text: bool = False) -> DataFrame:
    """Generations, each once; texts and questions only on demand."""
    rows = table(spark, root, "eval")
    return (rows if text else rows.drop("text", "question")).distinct()


def questions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "questions").distinct()


POOL = (
    "tid qid teacher sample_idx finish_reason completion_tokens qual llm_score rule_score rule_norm llm_norm n_words "
    "grape rsr brier mean_surprisal mean_rank n_tokens local_nat n_steps pos n"
).split()


def pool(spark: SparkSession, root: str) -> DataFrame:
    """Chains with quality and fit of questions that have at least three of them, in hashed order."""
    lean = chains(spark, root).drop("ts")
    scored = lean.join(fits(spark, root).drop("qid", "model", "ts"), "tid").where(usable_column("grape"))
    judged = quality(spark, root).where("qual is not null").drop("qid")
    return placed_blocks(scored.join(judged, "tid"), K).select(*POOL)


def usable_column(name: str):
    from pyspark.sql import functions as F

    return usable(F.col(name))


#: Common table expressions with the same content.
WITH = f"""
with chains as (select distinct * from candidates),
fits as (select * exclude (k) from (
  select *, row_number() over (partition by tid order by ts desc nulls last, grape desc nulls last, rsr desc nulls last,
    n_tokens desc nulls last) as k from fit) where k = 1),
quals as (select distinct * from quality),
gens as (select distinct * from eval),
asked as (select distinct * from questions),
pool as (
  select *, row_number() over (partition by qid order by sha256('42|' || tid), tid) as pos from (
    select c.tid, c.qid, c.teacher, c.sample_idx, c.finish_reason, c.completion_tokens, q.qual, q.llm_score, q.rule_score,
      q.rule_norm, q.llm_norm, q.n_words, f.grape, f.rsr, f.brier, f.mean_surprisal, f.mean_rank, f.n_tokens,
      f.local_nat, f.n_steps, count(*) over (partition by c.qid) as n
    from chains c join fits f on c.tid = f.tid join quals q on c.tid = q.tid
    where f.grape is not null and not isnan(f.grape) and q.qual is not null) where n >= {K})
"""
