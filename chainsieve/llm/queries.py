"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsieve.llm import (
    bagminhash,
    crosssplit,
    encode,
    leaks,
    outranking,
    pairs,
    repetition,
    stuffing,
    topn,
    varied,
)
from chainsieve.sources.tables import table

#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", encode.TOKENIZERS)
#: Share of repeated content from which on a generation counts as repetitive.
REPEATED = 0.42
#: Chains kept per question and teacher.
BEST = 2


def _ranks(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    return encode.read_ranks(os.path.join(TOKENIZERS, name))


def p1_profile(spark: SparkSession, root: str) -> DataFrame:
    """Encoding measures and repeated share of every generation."""
    return repetition.repetition_profile(table(spark, root, "eval"), ["gen_id", "n_tokens"], "text", _ranks()).distinct()


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Generations that say the same thing over and over."""
    profile = repetition.repetition_profile(table(spark, root, "eval"), ["gen_id"], "text", _ranks())
    return profile.where(F.col("repeated_share") >= REPEATED).select("gen_id").distinct()


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Generations that are no proper answer to their question, with the defect."""
    return pairs.pair_defects(table(spark, root, "eval"), "gen_id", "question", "text", "pred")


def p2_counts(spark: SparkSession, root: str) -> DataFrame:
    """Number of generations by defect."""
    return pairs.defect_counts(p2_found(spark, root))


def p3_ranking(spark: SparkSession, root: str) -> DataFrame:
    """One ranking of the chains of each question from fit and quality, neither outweighing the other.

    Chains that only one of the two tables knows are ranked too; what is missing has flow 0.
    """
    scores = topn.latest(table(spark, root, "fit", "tid", "qid", "ts", "grape"), "tid", "ts", "qid", "grape")
    quality = table(spark, root, "quality", "tid", "qid", "qual").where("tid is not null")
    judged = quality.groupBy("tid").agg(F.max("qual").alias("qual"), F.max("qid").alias("_qid"))
    both = scores.join(judged, "tid", "full").withColumn("qid", F.coalesce("qid", "_qid"))
    return outranking.net_flows(both, "qid", "tid", {"grape": 0.5, "qual": 0.5})


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of chains, and of questions, that are light reworkings of one another."""
    found = None
    for name, key, text in (("candidates", "tid", "text"), ("questions", "qid", "question")):
        near = bagminhash.near_duplicate_pairs(table(spark, root, name, key, text), key, text)
        part = near.select(F.lit(name).alias("tbl"), "id_a", "id_b")
        found = part if found is None else found.unionByName(part)
    return found


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every chain with its near-duplicate class and the number of its links in it."""
    chains = table(spark, root, "candidates", "tid", "text")
    return bagminhash.near_duplicate_classes(chains, "tid", "text")


def _splits(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    held = table(spark, root, "eval", "benchmark", "qid", "question").withColumnRenamed("qid", "eval_qid")
    pool = table(spark, root, "questions", "source", "qid", "question").withColumnRenamed("qid", "train_qid")
    return held, pool


_KEEP = (["eval_qid", "benchmark"], ["train_qid", "source"])


def p6_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Held-out questions that also stand, exactly or almost, in the training pool, with their splits."""
    return crosssplit.cross_split(*_splits(spark, root), "question", _KEEP)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of held-out and training questions."""
    return p6_overlap(spark, root).select("eval_qid", "train_qid").distinct()


def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    """Number of overlapping pairs, held-out and training questions by benchmark and source."""
    return (
        p6_overlap(spark, root)
        .groupBy("benchmark", "source")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.count_distinct("eval_qid").alias("n_eval"),
            F.count_distinct("train_qid").alias("n_train"),
        )
    )


def p6_exact_counts(spark: SparkSession, root: str) -> DataFrame:
    """The same numbers for texts that are equal after normalisation."""
    return (
        crosssplit.exact_overlap(*_splits(spark, root), "question", _KEEP)
        .groupBy("benchmark", "source")
        .agg(F.count(F.lit(1)).alias("n_pairs"))
    )


def _best(spark: SparkSession, root: str) -> DataFrame:
    chains = table(spark, root, "candidates", "tid", "qid", "teacher").dropna()
    owner = chains.groupBy("tid").agg(F.max(F.struct("qid", "teacher")).alias("_o"))
    scores = topn.latest(table(spark, root, "fit", "tid", "ts", "grape"), "tid", "ts", "grape")
    joined = owner.select("tid", "_o.qid", "_o.teacher").join(scores, "tid")
    return topn.top_n(joined, ["qid", "teacher"], F.col("grape"), "tid", BEST, repeated=False)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The best-fitting chains of every question and teacher."""
    return _best(spark, root).select("tid")


def p5_top(spark: SparkSession, root: str) -> DataFrame:
    """The same chains with their score and place."""
    return _best(spark, root).withColumnRenamed("score", "grape")


def p7_subset(spark: SparkSession, root: str) -> DataFrame:
    """A twentieth of all chains that shows the variety of texts and teachers."""
    return varied.varied_subset(table(spark, root, "candidates", "tid", "qid", "teacher", "text"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Every document as a list of token ids."""
    return encode.encode_ids(table(spark, root, "documents"), "doc_id", "text", _ranks())


def p9_passages(spark: SparkSession, root: str) -> DataFrame:
    """Every leaked passage: document, item, part, character offsets and matched words."""
    pages, items = table(spark, root, "documents"), table(spark, root, "eval_items")
    return leaks.leaked_passages(pages, "doc_id", "text", items, "item_id", ["question", "solution"])


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the held-out items that leaked into them."""
    return p9_passages(spark, root).select("doc_id", "item_id").distinct()


def p10_shares(spark: SparkSession, root: str) -> DataFrame:
    """Linked, listed and stuffed share of every page with list evidence."""
    return stuffing.page_shares(table(spark, root, "documents"), "doc_id", "text", "url", "source")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages that are heaps of keywords, links or product tags."""
    return stuffing.stuffed_pages(table(spark, root, "documents"), "doc_id", "text", "url", "source")


_BEST_SQL = f"""
with last as (
  select tid, grape from (
    select tid, grape, row_number() over (partition by tid order by ts desc, grape desc nulls last) as k
    from fit where tid is not null) where k = 1),
owner as (select distinct tid, qid, teacher from candidates
          where tid is not null and qid is not null and teacher is not null),
placed as (
  select o.qid, o.teacher, o.tid, l.grape,
         cast(row_number() over (partition by o.qid, o.teacher order by l.grape desc, o.tid) as integer) as place
  from owner o join last l on o.tid = l.tid
  where l.grape is not null and not isnan(l.grape))
select {{columns}} from placed where place <= {BEST}
"""


_FLOW_SQL = f"""
with last as (
  select tid, qid, grape from (
    select tid, qid, grape, row_number() over (partition by tid order by ts desc, qid desc, grape desc nulls last) as k
    from fit where tid is not null) where k = 1),
judged as (select tid, max(qual) as qual, max(qid) as qid from quality where tid is not null group by tid),
chains as (
  select * from (
    select coalesce(l.tid, j.tid) as tid, coalesce(l.qid, j.qid) as qid, l.grape, j.qual
    from last l full join judged j on l.tid = j.tid) where qid is not null),
long as (
  select qid, tid, 'grape' as s, case when isnan(grape) then null else grape end as v from chains
  union all select qid, tid, 'qual', case when isnan(qual) then null else qual end from chains),
placed as (
  select *, (rank() over w - 1 + count(*) over (partition by qid, s, v) / 2.0) / count(*) over (partition by qid, s) as x,
         count(*) over (partition by qid, s) as n
  from long where v is not null window w as (partition by qid, s order by v)),
flows as (
  select a.qid, a.s, a.tid,
         sum(greatest(0, least(1, (a.x - b.x - {outranking.INDIFFERENT}) / ({outranking.FULL - outranking.INDIFFERENT})))
           - greatest(0, least(1, (b.x - a.x - {outranking.INDIFFERENT}) / ({outranking.FULL - outranking.INDIFFERENT}))))
         / greatest(max(a.n) - 1, 1) as f
  from placed a join placed b on a.qid = b.qid and a.s = b.s group by a.qid, a.s, a.tid),
combined as (
  select l.qid, l.tid, round(sum(0.5 * coalesce(f.f, 0.0)) + 1e-12, {outranking.DECIMALS}) as flow
  from long l left join flows f on l.qid = f.qid and l.s = f.s and l.tid = f.tid group by l.qid, l.tid)
select qid, tid, flow, row_number() over (partition by qid order by flow desc, tid) as place from combined
"""

_EXACT_SQL = r"""
with e as (select distinct benchmark, qid, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g')) as canon
           from eval where question is not null),
t as (select distinct source, qid, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g')) as canon
      from questions where question is not null)
select benchmark, source, count(*) as n_pairs from (
  select distinct e.qid as eval_qid, benchmark, t.qid as train_qid, source
  from e join t on e.canon = t.canon where e.canon <> '')
group by benchmark, source
"""


def queries() -> dict:
    found = (
        p1_profile, p1_found, p2_found, p2_counts, p3_ranking, p4_found, p4_groups, p5_found, p5_top, p6_found, p6_overlap,
        p6_counts, p6_exact_counts, p7_subset, p8_ids, p9_passages, p9_found, p10_shares, p10_found,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _BEST_SQL.format(columns="tid"),
        "p3_ranking": _FLOW_SQL,
        "p6_exact_counts": _EXACT_SQL,
        "p7_subset": varied.SQL,
        "p5_top": _BEST_SQL.format(columns="qid, teacher, tid, grape, place"),
    }
