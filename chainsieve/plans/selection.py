"""Pools and selection rules over the chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainsieve.operators import pool as P
from chainsieve.operators import ranks, rules
from chainsieve.plans.base import K, WITH, chains, fits, pool, quality
from chainsieve.sources.tables import table

DROP = 0.3333333333
TEACHERS = {"first": (["qwen72b"], []), "last": ([], ["qwen72b"])}


def _picked(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "tid", *more)


def _topk(signal: str, direction: str = "max"):
    def query(spark: SparkSession, root: str) -> DataFrame:
        rows = pool(spark, root).where(ranks.usable(F.col(signal).cast("double")))
        return _picked(rules.top_k(rows, signal, K, direction), "tie")

    sign = "" if direction == "max" else "-"
    sql = f"""{WITH}, p as (select * from pool where {signal} is not null and not isnan(cast({signal} as double))),
    r as (select *, row_number() over (partition by qid order by {sign}{signal} desc, pos) as rn,
      lead({signal}) over (partition by qid order by {sign}{signal} desc, pos) as nxt from p)
    select qid, tid, coalesce(bool_or(rn = {K} and nxt is not null and {signal} = nxt) over (partition by qid), false) as tie
    from r qualify rn <= {K}"""
    return query, sql


def _rule(build, sql: str, *more: str):
    return (lambda spark, root: _picked(build(pool(spark, root)), *more)), WITH + sql


def _norm(signal: str, direction: str = "max") -> str:
    s = signal if direction == "max" else f"-{signal}"
    return (
        f"case when n = 1 then 1.0 else (rank() over (partition by qid order by {s}) - 1 "
        f"+ (count(*) over (partition by qid, {signal}) - 1) / 2.0) / (n - 1) end"
    )


def _within(signal: str) -> str:
    return f""", q as (select *, sum(case when pos <= {K} then 1 else 0 end) over (partition by qid, teacher) as quota,
      row_number() over (partition by qid, teacher order by {signal} desc, pos) as rn from pool)
    select qid, tid from q where rn <= quota"""


def _veto(signal: str, veto: str) -> str:
    return f""", v as (select *, greatest(0, least(n - {K}, cast(floor({DROP} * n + 1e-9) as int))) as nd,
      row_number() over (partition by qid order by {veto}, pos desc) as vr from pool),
    t as (select *, row_number() over (partition by qid order by {signal} desc, pos) as rn from v where vr > nd)
    select qid, tid from t where rn <= {K}"""


def usable(spark: SparkSession, root: str) -> DataFrame:
    return P.usable_pool(chains(spark, root), quality(spark, root)).select("qid", "tid", "n")


def extended(spark: SparkSession, root: str) -> DataFrame:
    every, judged = chains(spark, root), quality(spark, root)
    kept = P.usable_pool(every, judged)
    return _picked(P.extended_pool(chains(spark, root, text=True), kept, P.excluded_chains(every, judged)))


def excluding(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root).withColumn("r", F.round(ranks.norm_rank(F.col("grape")), 9))
    return P.without_teachers(rows, ["qwen72b"], K).select("qid", "tid", "r", "n")


def quota(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root)
    drawn = F.sum(F.when(F.col("pos") <= K, 1).otherwise(0)).over(Window.partitionBy("qid", "teacher"))
    return rows.select("qid", "teacher", drawn.cast("bigint").alias("quota")).distinct()


def veto_counts(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("n").cast("int")
    return pool(spark, root).select("qid", n.alias("n"), rules.veto_count(n, K, DROP).alias("n_drop")).distinct()


def scaled(spark: SparkSession, root: str) -> DataFrame:
    return pool(spark, root).select(
        "qid",
        "tid",
        F.round(ranks.minmax(F.col("grape")), 6).alias("scaled"),
        F.round(1 - ranks.minmax(F.col("rsr")), 6).alias("fit"),
    )


def blended(spark: SparkSession, root: str) -> DataFrame:
    rows = chains(spark, root).select("tid").join(quality(spark, root).select("tid", "qid", "rule_score", "llm_score"), "tid")
    judged = F.col("llm_score").isNotNull()
    rule = ranks.minmax(F.when(judged, F.round("rule_score", 6)))
    judge = ranks.minmax(F.col("llm_score"))
    return rows.select(
        "qid",
        "tid",
        F.round(rule, 6).alias("rule_norm"),
        F.round(judge, 6).alias("llm_norm"),
        F.round(F.when(judged, 0.5 * rule + 0.5 * judge), 6).alias("qual"),
    )


def rank_columns(spark: SparkSession, root: str) -> DataFrame:
    return pool(spark, root).select(
        "qid",
        "tid",
        F.round(ranks.norm_rank(F.col("llm_score")), 9).alias("norm"),
        ranks.average_rank(F.col("llm_score"), "qid").alias("average"),
    )


def larks(spark: SparkSession, root: str) -> DataFrame:
    return rules.lark(pool(spark, root)).select("qid", "tid", F.round("ghat", 9).alias("ghat"))


def lark_soft(spark: SparkSession, root: str) -> DataFrame:
    rows = rules.lark_weights(rules.lark(pool(spark, root)), K)
    return rows.select("qid", "tid", F.round("weight", 6).alias("weight"))


def top_by_tid(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("qual").desc(), "tid")
    return pool(spark, root).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= K).select("qid", "tid", "rn")


def split_tid(spark: SparkSession, root: str) -> DataFrame:
    part = lambda i: F.regexp_extract("tid", r"^(.*)\|([^|]*)\|(\d+)$", i)
    return (
        table(spark, root, "candidates", "tid")
        .distinct()
        .select("tid", part(1).alias("q"), part(2).alias("t"), part(3).cast("int").alias("s"))
        .withColumn("again", F.concat_ws("|", "q", "t", "s"))
    )


def groups(spark: SparkSession, root: str) -> DataFrame:
    name = F.when(F.col("level").isNull(), F.col("source")).otherwise(F.concat("source", F.lit("-L"), "level"))
    return table(spark, root, "questions").distinct().groupBy(name.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def truncated(spark: SparkSession, root: str) -> DataFrame:
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    return chains(spark, root).groupBy(cut.alias("truncated")).agg(F.count(F.lit(1)).alias("n"))


def capped(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "eval", "gen_id", "stopped", "n_tokens").distinct()
    return rows.where("not stopped and n_tokens >= 3072").select("gen_id")


def last_fit(spark: SparkSession, root: str) -> DataFrame:
    return fits(spark, root).select("tid", "ts", "rsr", "n_tokens")


def outside(spark: SparkSession, root: str) -> DataFrame:
    """Chains of usable questions that are not in the pool themselves."""
    rows = pool(spark, root)
    return (
        chains(spark, root)
        .select("tid", "qid")
        .join(rows.select("qid").distinct(), "qid", "left_semi")
        .join(rows.select("tid"), "tid", "left_anti")
    )


def fallback(spark: SparkSession, root: str) -> DataFrame:
    """Share of the other chains that a truncated chain's fit lies above, ties counting half."""
    w = Window.partitionBy("qid")
    below = F.rank().over(w.orderBy("grape")) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy("qid", "grape")) - 1
    share = (below + 0.5 * equal) / (F.col("n") - 1)
    rows = pool(spark, root).withColumn("share", F.round(share, 9))
    return rows.where(F.col("finish_reason") == "length").select("qid", "tid", "share")


_RULES = {
    "q_w8_random": _rule(lambda p: rules.random_k(p, K), f"select qid, tid from pool where pos <= {K}"),
    "q_w9_teacher_first": _rule(
        lambda p: rules.teacher_first(p, ["qwen72b"], [], K),
        f""", r as (select *, row_number() over (partition by qid order by case when teacher = 'qwen72b' then 0 else 1 end, pos)
        as rn from pool) select qid, tid from r where rn <= {K}""",
    ),
    "q_w9_teacher_last": _rule(
        lambda p: rules.teacher_first(p, [], ["qwen72b"], K),
        f""", r as (select *, row_number() over (partition by qid order by case when teacher = 'qwen72b' then 2 else 1 end, pos)
        as rn from pool) select qid, tid from r where rn <= {K}""",
    ),
    "q_w10_rank_sum": _rule(
        lambda p: rules.rank_sum(p, {"grape": (0.5, "max"), "qual": (0.5, "max")}, K),
        f""", s as (select *, round(0.5 * ({_norm("grape")}) + 0.5 * ({_norm("qual")}), 9) as v from pool),
        r as (select *, row_number() over (partition by qid order by v desc, pos) as rn from s)
        select qid, tid from r where rn <= {K}""",
    ),
    "q_w12_veto_topk": _rule(lambda p: rules.veto_top_k(p, "grape", "qual", DROP, K), _veto("grape", "qual")),
    "q_w12_veto_judge": _rule(lambda p: rules.veto_top_k(p, "grape", "llm_score", DROP, K), _veto("grape", "llm_score")),
    "q_w14_quality_within_teacher": _rule(lambda p: rules.within_teacher(p, "qual", K), _within("qual")),
    "q_w15_signal_within_teacher": _rule(lambda p: rules.within_teacher(p, "grape", K), _within("grape")),
    "q_w16_random_at_shares": _rule(
        lambda p: rules.random_at_signal_shares(p, "grape", K),
        f""", r as (select *, row_number() over (partition by qid order by grape desc, pos) as place from pool),
        q as (select *, sum(case when place <= {K} then 1 else 0 end) over (partition by qid, teacher) as quota,
          row_number() over (partition by qid, teacher order by pos) as rn from r)
        select qid, tid from q where rn <= quota""",
    ),
    "q_w17_veto_within_teacher": _rule(
        lambda p: rules.veto_within_teacher(p, "grape", "llm_score", DROP, K),
        f""", q as (select *, sum(case when pos <= {K} then 1 else 0 end) over (partition by qid, teacher) as quota,
          count(*) over (partition by qid, teacher) as nt,
          row_number() over (partition by qid, teacher order by llm_score, pos desc) as vr from pool),
        v as (select *, greatest(0, least(nt - quota, cast(floor({DROP} * nt + 1e-9) as int))) as nd from q where quota > 0),
        t as (select *, row_number() over (partition by qid, teacher order by grape desc, pos) as rn from v where vr > nd)
        select qid, tid from t where rn <= quota""",
    ),
}
_TOPK = {
    "q_w6_grape": _topk("grape"),
    "q_w6_rsr": _topk("rsr", "min"),
    "q_w6_token_length": _topk("n_tokens"),
    "q_w6_local_nat": _topk("local_nat"),
    "q_w6_judge_ties": _topk("llm_score"),
}

QUERIES = {
    "q_p1_split_tid": split_tid,
    "q_p2_group_of": groups,
    "q_p3_truncated": truncated,
    "q_p4_capped": capped,
    "q_p8_usable_pool": usable,
    "q_p9_extended_pool": extended,
    "q_p10_without_teachers": excluding,
    "q_p12_outside_pool": outside,
    "q_w1_minmax": scaled,
    "q_w3_quality_blend": blended,
    "q_w4_ranks": rank_columns,
    "q_w7_topk_by_tid": top_by_tid,
    "q_w11_veto_count": veto_counts,
    "q_w13_quota": quota,
    "q_w18_lark": larks,
    "q_w19_lark_weights": lark_soft,
    "q_w25_fallback_rank": fallback,
    "q_w27_last_per_key": last_fit,
    **{n: q for n, (q, _) in {**_TOPK, **_RULES}.items()},
}

_GHAT = f"""{WITH}, r as (select *, case when mean_surprisal <= 1e-30 then 0.0 else brier / mean_surprisal end as rho from pool),
s as (select *, sum(mean_surprisal) over (partition by qid) as total, sum(rho * mean_surprisal) over (partition by qid) as wt from r),
g as (select *, mean_surprisal / total * (2 * rho - wt / total) as ghat from s)"""

SQL = {
    "q_p1_split_tid": r"""select distinct tid, regexp_extract(tid, '^(.*)\|([^|]*)\|(\d+)$', 1) as q,
      regexp_extract(tid, '^(.*)\|([^|]*)\|(\d+)$', 2) as t,
      cast(regexp_extract(tid, '^(.*)\|([^|]*)\|(\d+)$', 3) as int) as s, tid as again from candidates""",
    "q_p2_group_of": """select case when level is null then source else source || '-L' || level end as grp, count(*) as n
      from (select distinct * from questions) group by 1""",
    "q_p3_truncated": f"{WITH} select coalesce(finish_reason = 'length', false) as truncated, count(*) as n from chains group by 1",
    "q_p4_capped": "select distinct gen_id from eval where not stopped and n_tokens >= 3072",
    "q_p8_usable_pool": f"""{WITH} select * from (select c.qid, c.tid, count(*) over (partition by c.qid) as n
      from chains c join quals q on c.tid = q.tid where q.qual is not null) where n >= {K}""",
    "q_p9_extended_pool": f"""{WITH}, ok as (select c.qid, c.tid, count(*) over (partition by c.qid) as n
      from chains c join quals q on c.tid = q.tid where q.qual is not null)
      select qid, tid from chains where qid in (select qid from ok where n >= {K}) and tid in (select tid from ok)
        and trim(coalesce(text, '')) <> '' and coalesce(finish_reason, '') <> 'length'""",
    "q_p10_without_teachers": f"""{WITH}, r as (select *, round({_norm("grape")}, 9) as r from pool),
      k as (select qid, tid, r, count(*) over (partition by qid) as n from r where coalesce(teacher <> 'qwen72b', true))
      select * from k where n >= {K}""",
    "q_p12_outside_pool": f"""{WITH} select tid, qid from chains where qid in (select qid from pool)
      and tid not in (select tid from pool)""",
    "q_w1_minmax": f"""{WITH}, r as (select *, min(grape) over w as gl, max(grape) over w as gh, min(rsr) over w as rl,
      max(rsr) over w as rh from pool window w as (partition by qid))
      select qid, tid, round(case when gh - gl < 1e-12 then 0.5 else (grape - gl) / (gh - gl) end, 6) as scaled,
        round(1 - case when rsr is null then null when rh - rl < 1e-12 then 0.5 else (rsr - rl) / (rh - rl) end, 6) as fit from r""",
    "q_w3_quality_blend": f"""{WITH}, r as (select q.qid, q.tid, llm_score, case when llm_score is not null then round(rule_score, 6) end as rule
      from quals q where q.tid in (select tid from chains)),
      s as (select *, min(rule) over w as a, max(rule) over w as b, min(llm_score) over w as c, max(llm_score) over w as d
        from r window w as (partition by qid)),
      t as (select qid, tid, case when rule is null then null when b - a < 1e-12 then 0.5 else (rule - a) / (b - a) end as rn,
        case when llm_score is null then null when d - c < 1e-12 then 0.5 else (llm_score - c) / (d - c) end as ln from s)
      select qid, tid, round(rn, 6) as rule_norm, round(ln, 6) as llm_norm, round(0.5 * rn + 0.5 * ln, 6) as qual from t""",
    "q_w4_ranks": f"""{WITH} select qid, tid, round({_norm("llm_score")}, 9) as norm,
      rank() over (partition by qid order by llm_score) + (count(*) over (partition by qid, llm_score) - 1) / 2.0 as average from pool""",
    "q_w7_topk_by_tid": f"""{WITH} select * from (select qid, tid, row_number() over (partition by qid order by qual desc, tid)
      as rn from pool) where rn <= {K}""",
    "q_w11_veto_count": f"""{WITH} select distinct qid, n, greatest(0, least(n - {K}, cast(floor({DROP} * n + 1e-9) as int)))
      as n_drop from pool""",
    "q_w13_quota": f"""{WITH} select qid, teacher, sum(case when pos <= {K} then 1 else 0 end) as quota from pool group by 1, 2""",
    "q_w18_lark": f"{_GHAT} select qid, tid, round(ghat, 9) as ghat from g",
    "q_w19_lark_weights": f"""{_GHAT}, k as (select *, row_number() over (partition by qid order by ghat desc, pos) as rn from g),
      c as (select *, ghat - max(case when rn = {K + 1} then ghat end) over (partition by qid) as gap from k),
      d as (select *, sum(gap) over (partition by qid) as tot from c where rn <= {K})
      select qid, tid, round({K} * case when n <= {K} or tot <= 1e-12 then 1.0 / {K} else gap / tot end, 6) as weight from d""",
    "q_w25_fallback_rank": f"""{WITH}, r as (select *, round((rank() over (partition by qid order by grape) - 1
      + 0.5 * (count(*) over (partition by qid, grape) - 1)) / (n - 1), 9) as share from pool)
      select qid, tid, share from r where finish_reason = 'length'""",
    "q_w27_last_per_key": f"{WITH} select tid, ts, rsr, n_tokens from fits",
    **{n: s for n, (_, s) in {**_TOPK, **_RULES}.items()},
}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """The three best-fitting chains of every question."""
    return QUERIES["q_w6_grape"](spark, root)
