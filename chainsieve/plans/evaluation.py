"""Accuracy, comparison and agreement queries over generations and scored chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainsieve.operators import metrics, ranks, rules, stats
from chainsieve.plans.base import K, WITH, chains, generations, pool, quality, questions
from chainsieve.sources.tables import table

SAMPLES = 4
BASE, OTHER = "base", "fq.k3"

_ACC = f"""{WITH}, first as (select * exclude (k) from (select *, row_number() over (
    partition by tag, seed, benchmark, qid, sample order by gen_id desc) as k from gens where sample < {SAMPLES}) where k = 1),
qacc as (select tag, seed, benchmark, qid, sum(cast(coalesce(correct, false) as int)) / {SAMPLES}.0 as acc,
    sum(cast(coalesce(correct, false) as int)) > 0 as solved from first group by all having count(*) = {SAMPLES}),
seeds as (select tag, benchmark, count(distinct seed) as s from qacc group by all),
pooled as (select q.tag, q.benchmark, q.qid, avg(q.acc) as acc from qacc q join seeds s
    on q.tag = s.tag and q.benchmark = s.benchmark group by q.tag, q.benchmark, q.qid having count(*) = max(s.s)),
paired as (select a.benchmark, a.qid, a.acc as a, b.acc as b from pooled a join pooled b
    on a.benchmark = b.benchmark and a.qid = b.qid where a.tag = '{BASE}' and b.tag = '{OTHER}')
"""


def _r(column, digits: int = 6):
    return F.round(column, digits)


def accuracy(spark: SparkSession, root: str) -> DataFrame:
    return metrics.run_accuracy(generations(spark, root), SAMPLES).select(
        *metrics.RUN, "n_questions", _r("acc").alias("acc"), _r("passed").alias("passed")
    )


def question_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return metrics.question_accuracy(generations(spark, root), SAMPLES).select(*metrics.RUN, "qid", "acc")


def pooled(spark: SparkSession, root: str) -> DataFrame:
    found = metrics.pooled_question_accuracy(generations(spark, root), SAMPLES)
    return found.select("tag", "benchmark", "qid", _r("acc").alias("acc"))


def by_subset(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy, stops, caps and missing boxes of every benchmark and each of its subsets."""
    items = table(spark, root, "eval_items", "item_id", "subset").distinct()
    rows = generations(spark, root).join(items, F.col("qid") == F.col("item_id"), "left")
    cut = (~F.col("stopped") & (F.col("n_tokens") >= 3072)).cast("double")
    return (
        rows.groupingSets([["benchmark", "subset"], ["benchmark"]], "benchmark", "subset")
        .agg(
            F.grouping("subset").cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("n"),
            _r(F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double"))).alias("acc"),
            _r(F.avg(F.col("n_tokens").cast("double"))).alias("mean_tokens"),
            _r(F.avg(F.col("stopped").cast("double"))).alias("stopped_share"),
            _r(F.avg(F.coalesce(cut, F.lit(0.0)))).alias("cap_share"),
            _r(F.avg(F.col("pred").isNull().cast("double"))).alias("no_box_share"),
        )
        .where("is_total = 1 or subset is not null")
    )


def tier_mean(spark: SparkSession, root: str) -> DataFrame:
    """Unweighted mean of four benchmarks for runs that have all of them."""
    runs = metrics.run_accuracy(generations(spark, root), 1)
    rows = runs.where(F.col("benchmark").isin("gsm8k", "math500", "bbh", "val"))
    found = rows.groupBy("tag", "seed").agg(F.count(F.lit(1)).alias("m"), _r(F.avg("acc")).alias("mean")).where("m = 4")
    return found.select("tag", "seed", "mean")


def mean_sd(spark: SparkSession, root: str) -> DataFrame:
    runs = metrics.run_accuracy(generations(spark, root), 1)
    return runs.groupBy("tag", "benchmark").agg(
        F.count(F.lit(1)).alias("n_seeds"), _r(F.avg("acc")).alias("mean"), _r(F.stddev_samp("acc")).alias("sd")
    )


def correct_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Questions by number of right samples, per benchmark, empty bins too."""
    rows = metrics.first_samples(generations(spark, root), SAMPLES)
    right = F.sum(F.coalesce(F.col("correct").cast("int"), F.lit(0))).alias("n_correct")
    each = rows.groupBy(*metrics.RUN, "qid").agg(right)
    counts = each.groupBy("benchmark", "n_correct").agg(F.count(F.lit(1)).alias("n"))
    bins = each.select("benchmark").distinct().withColumn("n_correct", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES))))
    found = bins.join(counts.withColumn("n_correct", F.col("n_correct").cast("int")), ["benchmark", "n_correct"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("benchmark"))
    n = F.coalesce("n", F.lit(0))
    return found.select("benchmark", "n_correct", n.alias("n"), _r(100.0 * n / total).alias("percent"))


def pool_stats(spark: SparkSession, root: str) -> DataFrame:
    """Chains, questions, share, mean tokens and zero judgements by teacher."""
    rows = pool(spark, root)
    found = rows.groupBy("teacher").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("qid").alias("n_questions"),
        _r(F.avg(F.col("completion_tokens").cast("double"))).alias("mean_tokens"),
        F.count_if(F.col("llm_score") <= 0).alias("judge_zero"),
    )
    return found.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy())))


def selection_summary(spark: SparkSession, root: str) -> DataFrame:
    """Teacher counts, ties, weights and effective samples of a weighted selection."""
    rows = rules.lark_weights(rules.lark(pool(spark, root)), K)
    w = F.col("weight")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("qid").alias("n_questions"),
        F.count_if(F.col("llm_score") <= 0).alias("judge_zero_kept"),
        F.count_if(F.col("finish_reason") == "length").alias("truncated_kept"),
        F.count_if(w < 0.1).alias("light"),
        _r(F.pow(F.sum(w), 2) / F.sum(w * w), 3).alias("effective"),
    )


def zscores(spark: SparkSession, root: str) -> DataFrame:
    return ranks.zscored(quality(spark, root).where("rule_score is not null"), "rule_score").select("tid", _r("z").alias("z"))


def reference_zscores(spark: SparkSession, root: str) -> DataFrame:
    """Rule scores on the scale of the chains that have a judge score."""
    rows = quality(spark, root).where("rule_score is not null")
    scale = rows.where("llm_score is not null").agg(F.avg("rule_score").alias("m"), F.stddev_pop("rule_score").alias("s"))
    z = F.coalesce((F.col("rule_score") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0))
    return rows.crossJoin(F.broadcast(scale)).select("tid", _r(z).alias("z"))


def lengths(spark: SparkSession, root: str) -> DataFrame:
    """Index percentiles of completion tokens by teacher.

    Token counts are integers of a bounded range, so their counts are summed first
    and the percentile found among those.
    """
    rows = chains(spark, root).where("teacher is not null and completion_tokens is not null")
    counts = rows.groupBy("teacher", "completion_tokens").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("teacher")
    upto = F.sum("c").over(w.orderBy("completion_tokens"))
    placed = counts.withColumns({"upto": upto, "n": F.sum("c").over(w)})
    at = lambda p: F.min(
        F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1), F.col("completion_tokens"))
    )
    shares = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    return placed.groupBy("teacher").agg(
        F.max("n").alias("n"), *[at(p).alias(name) for name, p in shares.items()], F.max("completion_tokens").alias("top")
    )


def linear_percentiles(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "quality").distinct().where("llm_score is not null")
    return rows.agg(
        _r(F.percentile("llm_score", F.lit(0.025))).alias("low"), _r(F.percentile("llm_score", F.lit(0.975))).alias("high")
    )


def ceiling(spark: SparkSession, root: str) -> DataFrame:
    """How coarse the judge is: share at the top, constant questions, levels, ties at the cut."""
    rows = pool(spark, root).where("llm_score is not null")
    w = Window.partitionBy("qid").orderBy(F.col("llm_score").desc(), "pos")
    placed = rows.withColumns({"rn": F.row_number().over(w), "nxt": F.lead("llm_score").over(w)})
    each = placed.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("llm_score") >= 1 - 1e-9).alias("top"),
        F.count_distinct("llm_score").alias("levels"),
        F.max(F.when((F.col("rn") == K) & (F.col("llm_score") == F.col("nxt")), 1).otherwise(0)).alias("tie"),
    )
    return each.agg(
        F.count(F.lit(1)).alias("n_questions"),
        _r(F.sum("top") / F.sum("n")).alias("top_share"),
        F.count_if(F.col("levels") == 1).alias("constant"),
        F.sum("tie").cast("bigint").alias("ties"),
    )


def stability(spark: SparkSession, root: str) -> DataFrame:
    """Spread of the scores of chains scored more than once."""
    rows = table(spark, root, "fit", "tid", "ts", "rsr").distinct().where("rsr is not null")
    each = rows.groupBy("tid").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("rsr") - F.min("rsr")).alias("span"),
        F.stddev_pop("rsr").alias("sd"),
    )
    return each.where("n >= 2").agg(
        F.count(F.lit(1)).alias("n_chains"),
        F.count_if(F.col("span") < 1e-9).alias("identical"),
        F.count_if(F.col("span") >= 0.2 - 1e-9).alias("wide"),
        _r(F.max("span")).alias("span_max"),
        _r(F.avg("sd")).alias("mean_sd"),
    )


def truncation_rates(spark: SparkSession, root: str) -> DataFrame:
    """Truncated chains by teacher and question group, with totals."""
    group = F.when(F.col("level").isNull(), F.col("source")).otherwise(F.concat("source", F.lit("-L"), "level"))
    named = questions(spark, root).select("qid", group.alias("grp")).groupBy("qid").agg(F.min("grp").alias("grp"))
    rows = chains(spark, root).join(named, "qid").where("teacher is not null")
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    return rows.rollup("teacher", "grp").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(cut).alias("cut"),
        _r(F.avg(cut.cast("double"))).alias("rate"),
    )


def score_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Judge scores in eleven fixed bins, empty ones too, with the share of each."""
    rows = quality(spark, root).where("llm_score is not null")
    counts = rows.groupBy(F.round(F.col("llm_score") * 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(11).select(F.col("id").cast("int").alias("bin"))
    found = bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    share = F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0))
    return found.select("bin", "n", _r(share).alias("share"), (share > 0.7).alias("dominant"))


def audit(spark: SparkSession, root: str) -> DataFrame:
    """Integrity rules with the number of rows that break each."""
    every, asked, judged = chains(spark, root), questions(spark, root), quality(spark, root)
    scored = table(spark, root, "fit")
    rules_ = {
        "chain_without_question": every.join(asked, "qid", "left_anti"),
        "chain_without_quality": every.join(judged, "tid", "left_anti"),
        "chain_without_fit": every.join(scored, "tid", "left_anti"),
        "repeated_tid": every.groupBy("tid").count().where("count > 1"),
        "repeated_question_text": asked.groupBy("question").count().where("count > 1 and question is not null"),
        "tid_not_its_parts": every.where("teacher is not null and tid <> concat_ws('|', qid, teacher, sample_idx)"),
        "more_than_one_model": scored.select("model").distinct().agg(F.count(F.lit(1)).alias("m")).where("m > 1"),
        "old_signals": scored.where("signals_version < 2"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(n)) for n, df in rules_.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("rule", "violations", (F.col("violations") == 0).alias("ok"))


def flips(spark: SparkSession, root: str) -> DataFrame:
    """Grades that change when the prediction is compared with the gold answer as text."""
    new = F.coalesce(F.trim("pred") == F.trim("gold"), F.lit(False))
    old = F.coalesce(F.col("correct"), F.lit(False))
    return generations(spark, root).groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~old & new).alias("wrong_to_right"),
        F.count_if(old & ~new).alias("right_to_wrong"),
    )


def coverage(spark: SparkSession, root: str) -> DataFrame:
    """Chains present in each score table."""
    wanted = chains(spark, root).select("tid").distinct()
    has = lambda name: table(spark, root, name).select("tid").distinct().withColumn(name, F.lit(1))
    rows = wanted.join(has("quality"), "tid", "left").join(has("fit"), "tid", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("quality").alias("n_quality"),
        F.count("fit").alias("n_fit"),
        F.count_if(F.col("quality").isNotNull() & F.col("fit").isNotNull()).alias("n_both"),
    )


def teacher_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many questions have m chains of a teacher, none included."""
    rows = pool(spark, root).where("teacher is not null")
    every = rows.select("qid").distinct().crossJoin(F.broadcast(rows.select("teacher").distinct()))
    counts = rows.groupBy("qid", "teacher").agg(F.count(F.lit(1)).alias("m"))
    found = every.join(counts, ["qid", "teacher"], "left").select("teacher", F.coalesce("m", F.lit(0)).alias("m"))
    return found.groupBy("teacher", "m").agg(F.count(F.lit(1)).alias("n"))


def usable_size(spark: SparkSession, root: str) -> DataFrame:
    every = chains(spark, root).select("tid", "qid").join(quality(spark, root).select("tid", "qual"), "tid", "left")
    each = every.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count("qual").alias("m"))
    return each.agg(
        F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("m") >= K).alias("usable"), F.sum(F.col("n") - F.col("m")).alias("unjudged")
    )


def chain_totals(spark: SparkSession, root: str) -> DataFrame:
    return pool(spark, root).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("local_nat").alias("with_local"),
        _r(F.avg("local_nat")).alias("mean_local"),
        _r(F.percentile("n_steps", F.lit(0.5))).alias("median_steps"),
        F.sum(F.greatest(F.col("n_steps") * 5 - 10, F.col("n_steps"))).cast("bigint").alias("items"),
    )


def rank_correlation(spark: SparkSession, root: str) -> DataFrame:
    found = stats.spearman_within(pool(spark, root), "grape", "llm_score")
    return found.select("qid", "n", _r("rho", 5).alias("rho"))


def correlation_summary(spark: SparkSession, root: str) -> DataFrame:
    found = stats.spearman_within(pool(spark, root), "grape", "rsr").where("rho is not null")
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.avg("rho"), 5).alias("mean"),
        _r(F.percentile("rho", F.lit(0.5)), 5).alias("median"),
        _r(F.avg((F.col("rho") < -1e-9).cast("double"))).alias("negative"),
    )


def length_bias(spark: SparkSession, root: str) -> DataFrame:
    found = pool(spark, root).agg(stats.pearson(F.col("n_words").cast("double"), F.col("qual")).alias("r"))
    return found.select(_r("r", 5).alias("r"))


def agreement(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root).withColumn("rule_level", F.round("rule_norm", 1))
    return stats.pair_agreement(rows, "llm_score", "rule_level").withColumn("rate", _r("rate"))


def top_one(spark: SparkSession, root: str) -> DataFrame:
    return stats.top_one_agreement(pool(spark, root), "grape", "llm_score")


def topk_agreement(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root).where(F.col("n") > K)
    both = stats.same_sets(rules.top_k_lean(rows, "grape", K), rules.top_k_lean(rows, "qual", K))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    found = both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("same").alias("hits"), _r(F.avg("shared")).alias("mean_shared")
    )
    return found.select("n", "hits", "mean_shared", _r(low).alias("low"), _r(high).alias("high"))


def judge_auc(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root).where("teacher is not null")
    label = F.col("finish_reason").eqNullSafe("length")
    return stats.auc(rows.withColumn("label", label), "n_tokens", "label", "teacher").select("teacher", _r("auc").alias("auc"))


def label_kappa(spark: SparkSession, root: str) -> DataFrame:
    rows = generations(spark, root).select(F.col("correct").alias("x"), (F.trim("pred") == F.trim("gold")).alias("y"))
    return stats.kappa(rows, "x", "y").withColumn("kappa", _r("kappa"))


def split_by_length(spark: SparkSession, root: str) -> DataFrame:
    found = metrics.length_split(generations(spark, root), BASE, OTHER, 3072, SAMPLES)
    return found.select("benchmark", "cut", "n", _r("diff").alias("diff"), _r("contribution").alias("contribution"))


def paired_difference(spark: SparkSession, root: str) -> DataFrame:
    both = metrics.paired(metrics.pooled_question_accuracy(generations(spark, root), SAMPLES), BASE, OTHER)
    d = F.col("b") - F.col("a")
    return both.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(d)).alias("diff"), _r(F.stddev_samp(d)).alias("sd"))


def bootstrap(spark: SparkSession, root: str) -> DataFrame:
    both = metrics.paired(metrics.pooled_question_accuracy(generations(spark, root), SAMPLES), BASE, OTHER)
    return metrics.bootstrap(both)


def teacher_ranks(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root).withColumn("r", ranks.norm_rank(F.col("grape")))
    return rows.where("n >= 4 and teacher is not null").groupBy("teacher").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("r")).alias("mean_rank"))


def rank_meta(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root).withColumns({"fr": ranks.norm_rank(F.col("grape")), "qr": ranks.norm_rank(F.col("qual"))})
    kept = rules.rank_sum(rows, {"grape": (0.5, "max"), "qual": (0.5, "max")}, K).where("n > 1")
    return kept.agg(F.count(F.lit(1)).alias("n"), _r(F.avg("fr")).alias("fit_rank"), _r(F.avg("qr")).alias("quality_rank"))


def swaps(spark: SparkSession, root: str) -> DataFrame:
    """Chains dropped and added by teacher, going from fit alone to the rank sum."""
    rows = pool(spark, root)
    old = rules.top_k_lean(rows, "grape", K).select("qid", "tid", "teacher")
    new = rules.rank_sum(rows, {"grape": (0.5, "max"), "qual": (0.5, "max")}, K).select("qid", "tid", "teacher")
    dropped = old.join(new, ["qid", "tid"], "left_anti").withColumn("change", F.lit("dropped"))
    added = new.join(old, ["qid", "tid"], "left_anti").withColumn("change", F.lit("added"))
    return dropped.unionByName(added).groupBy("change", "teacher").agg(F.count(F.lit(1)).alias("n"))


def overlaps(spark: SparkSession, root: str) -> DataFrame:
    """Of every two selections the share of the first's chains that the second has too.

    One pass over the pool marks each chain for every selection; what is left are sixteen counts.
    """
    w = Window.partitionBy("qid")
    place = lambda *order: F.row_number().over(w.orderBy(*order, "pos"))
    worst = F.row_number().over(w.orderBy("qual", F.col("pos").desc()))
    rows = pool(spark, root).withColumns({"_fit": place(F.col("grape").desc()), "_quality": place(F.col("qual").desc()), "_worst": worst})
    left = F.col("_worst") > rules.veto_count(F.col("n"), K, 0.3333333333)
    rows = rows.withColumn("_veto", F.row_number().over(w.orderBy(left.cast("int").desc(), F.col("grape").desc(), "pos")))
    marks = {
        "random": F.col("pos") <= K,
        "fit": F.col("_fit") <= K,
        "quality": F.col("_quality") <= K,
        "veto": left & (F.col("_veto") <= K),
    }
    names = list(marks)
    counts = rows.agg(*[F.count_if(marks[a] & marks[b]).alias(f"{a}_{b}") for a in names for b in names])
    cells = [
        F.struct(F.lit(a).alias("tag_a"), F.lit(b).alias("tag_b"), F.col(f"{a}_{b}").alias("n"), F.col(f"{a}_{a}").alias("size"))
        for a in names
        for b in names
    ]
    found = counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("n > 0")
    return found.select("tag_a", "tag_b", "n", _r(100.0 * F.col("n") / F.col("size")).alias("percent"))


def teacher_means(spark: SparkSession, root: str) -> DataFrame:
    """Mean fit of every question and teacher, for questions that have all of three teachers."""
    names = ["deepseek", "llama70b", "qwen72b"]
    rows = pool(spark, root).where(F.col("teacher").isin(names))
    wide = rows.groupBy("qid").pivot("teacher", names).agg(F.avg("grape")).na.drop()
    best = F.greatest(*names)
    name = F.coalesce(*[F.when(F.col(n) == best, F.lit(n)) for n in names])
    return wide.select("qid", *[_r(F.col(n) + 1e-9).alias(n) for n in names], name.alias("best"))


def pilot_size(spark: SparkSession, root: str) -> DataFrame:
    """Questions needed to tell two teachers apart, from mean and deviation of their difference."""
    rows = pool(spark, root).where(F.col("teacher").isin("qwen72b", "deepseek"))
    wide = rows.groupBy("qid").pivot("teacher", ["qwen72b", "deepseek"]).agg(F.avg("grape")).na.drop()
    d = F.col("qwen72b") - F.col("deepseek")
    found = wide.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    need = F.when(F.col("m") > 0, F.pow(F.lit(1.645) * F.col("s") / F.nullif(F.col("m"), F.lit(0.0)), 2))
    return found.select("n", _r(need, 3).alias("m"))


def run_settings(spark: SparkSession, root: str) -> DataFrame:
    """Samples per question of every run, to see whether runs can be compared."""
    rows = generations(spark, root).groupBy(*metrics.RUN, "qid").agg(F.count_distinct("sample").alias("m"))
    found = rows.groupBy("benchmark", "m").agg(F.count_distinct("tag", "seed").alias("n_runs"))
    return found.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("benchmark")))


QUERIES = {
    "q_a1_correct_histogram": correct_histogram,
    "q_a2_pool_stats": pool_stats,
    "q_a3_selection_summary": selection_summary,
    "q_a4_accuracy": accuracy,
    "q_a6_by_subset": by_subset,
    "q_a7_question_accuracy": question_accuracy,
    "q_a8_pooled_accuracy": pooled,
    "q_a9_tier_mean": tier_mean,
    "q_a10_mean_sd": mean_sd,
    "q_a11_zscore": zscores,
    "q_a12_reference_zscore": reference_zscores,
    "q_a13_length_percentiles": lengths,
    "q_a14_linear_percentiles": linear_percentiles,
    "q_a16_judge_ceiling": ceiling,
    "q_a18_stability": stability,
    "q_a19_truncation_rates": truncation_rates,
    "q_a21_score_histogram": score_histogram,
    "q_a23_audit": audit,
    "q_a24_flips": flips,
    "q_a26_coverage": coverage,
    "q_a30_teacher_counts": teacher_counts,
    "q_a34_usable_size": usable_size,
    "q_a36_step_plan": chain_totals,
    "q_t1_spearman": rank_correlation,
    "q_t1_spearman_summary": correlation_summary,
    "q_t3_pearson": length_bias,
    "q_t4_paired_difference": paired_difference,
    "q_t4_bootstrap": bootstrap,
    "q_t5_pair_agreement": agreement,
    "q_t6_top_one": top_one,
    "q_t7_topk_agreement": topk_agreement,
    "q_t12_auc": judge_auc,
    "q_t15_kappa": label_kappa,
    "q_t16_length_split": split_by_length,
    "q_t21_teacher_ranks": teacher_ranks,
    "q_t21_swaps": swaps,
    "q_t22_rank_meta": rank_meta,
    "q_t23_teacher_means": teacher_means,
    "q_t25_pilot_size": pilot_size,
    "q_t27_run_settings": run_settings,
    "q_u6_overlap_matrix": overlaps,
}

_RUN1 = _ACC.replace(f"< {SAMPLES}", "< 1").replace(f"/ {SAMPLES}.0", "/ 1.0").replace(f"= {SAMPLES})", "= 1)")
_TOP = "row_number() over (partition by qid order by {} desc, pos)"
_NR = (
    "case when n = 1 then 1.0 else (rank() over (partition by qid order by {0}) - 1 "
    "+ (count(*) over (partition by qid, {0}) - 1) / 2.0) / (n - 1) end"
)
_SUMRANK = f""", rr as (select *, {_NR.format("grape")} as fr, {_NR.format("qual")} as qr from pool),
ss as (select *, row_number() over (partition by qid order by round(0.5 * fr + 0.5 * qr, 9) desc, pos) as srn,
  row_number() over (partition by qid order by grape desc, pos) as grn from rr)"""

SQL = {
    "q_a1_correct_histogram": f"""{_ACC}, each as (select tag, seed, benchmark, qid, sum(cast(coalesce(correct, false) as int)) as n_correct
      from first group by all), c as (select benchmark, n_correct, count(*) as n from each group by all),
      b as (select distinct benchmark, unnest(range(0, {SAMPLES + 1}))::int as n_correct from each)
      select b.benchmark, b.n_correct, coalesce(c.n, 0) as n,
        round(100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) over (partition by b.benchmark), 6) as percent
      from b left join c on b.benchmark = c.benchmark and b.n_correct = c.n_correct""",
    "q_a2_pool_stats": f"""{WITH} select teacher, count(*) as n, count(distinct qid) as n_questions,
      round(avg(cast(completion_tokens as double)), 6) as mean_tokens, count(*) filter (where llm_score <= 0) as judge_zero,
      round(count(*) / sum(count(*)) over (), 6) as share from pool group by teacher""",
    "q_a3_selection_summary": f"""{WITH}, r as (select *, case when mean_surprisal <= 1e-30 then 0.0 else brier / mean_surprisal end as rho from pool),
      s as (select *, sum(mean_surprisal) over (partition by qid) as total, sum(rho * mean_surprisal) over (partition by qid) as wt from r),
      g as (select *, mean_surprisal / total * (2 * rho - wt / total) as ghat from s),
      k as (select *, row_number() over (partition by qid order by ghat desc, pos) as rn from g),
      c as (select *, ghat - max(case when rn = {K + 1} then ghat end) over (partition by qid) as gap from k),
      d as (select *, sum(gap) over (partition by qid) as tot from c where rn <= {K}),
      e as (select *, {K} * case when n <= {K} or tot <= 1e-12 then 1.0 / {K} else gap / tot end as weight from d)
      select count(*) as n, count(distinct qid) as n_questions, count(*) filter (where llm_score <= 0) as judge_zero_kept,
        count(*) filter (where finish_reason = 'length') as truncated_kept, count(*) filter (where weight < 0.1) as light,
        round(pow(sum(weight), 2) / sum(weight * weight), 3) as effective from e""",
    "q_a4_accuracy": f"""{_ACC} select tag, seed, benchmark, count(*) as n_questions, round(avg(acc), 6) as acc,
      round(avg(cast(solved as double)), 6) as passed from qacc group by all""",
    "q_a6_by_subset": f"""{WITH}, r as (select g.*, i.subset from gens g left join (select distinct item_id, subset from eval_items) i on g.qid = i.item_id)
      select * from (select benchmark, subset, cast(grouping(subset) as int) as is_total, count(*) as n,
        round(avg(cast(coalesce(correct, false) as double)), 6) as acc, round(avg(cast(n_tokens as double)), 6) as mean_tokens,
        round(avg(cast(stopped as double)), 6) as stopped_share,
        round(avg(coalesce(cast(not stopped and n_tokens >= 3072 as double), 0.0)), 6) as cap_share,
        round(avg(cast(pred is null as double)), 6) as no_box_share
      from r group by grouping sets ((benchmark, subset), (benchmark))) where is_total = 1 or subset is not null""",
    "q_a7_question_accuracy": f"{_ACC} select tag, seed, benchmark, qid, acc from qacc",
    "q_a8_pooled_accuracy": f"{_ACC} select tag, benchmark, qid, round(acc, 6) as acc from pooled",
    "q_a9_tier_mean": f"""{_RUN1}, runs as (select tag, seed, benchmark, avg(acc) as acc from qacc group by all)
      select tag, seed, round(avg(acc), 6) as mean from runs where benchmark in ('gsm8k', 'math500', 'bbh', 'val')
      group by tag, seed having count(*) = 4""",
    "q_a10_mean_sd": f"""{_RUN1}, runs as (select tag, seed, benchmark, avg(acc) as acc from qacc group by all)
      select tag, benchmark, count(*) as n_seeds, round(avg(acc), 6) as mean, round(stddev_samp(acc), 6) as sd from runs group by all""",
    "q_a11_zscore": f"""{WITH} select tid, round((rule_score - avg(rule_score) over ()) / stddev_pop(rule_score) over (), 6) as z
      from quals where rule_score is not null""",
    "q_a12_reference_zscore": f"""{WITH} select tid, round((rule_score - (select avg(rule_score) from quals where llm_score is not null))
      / (select stddev_pop(rule_score) from quals where llm_score is not null), 6) as z from quals where rule_score is not null""",
    "q_a13_length_percentiles": f"""{WITH}, l as (select teacher, list_sort(list(completion_tokens)) as v from chains
      where teacher is not null and completion_tokens is not null group by teacher)
      select teacher, len(v) as n, {", ".join(f"v[least(cast(floor({p} * len(v)) as int), len(v) - 1) + 1] as {n}" for n, p in {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}.items())},
      v[len(v)] as top from l""",
    "q_a14_linear_percentiles": f"""{WITH} select round(quantile_cont(cast(llm_score as double), 0.025), 6) as low,
      round(quantile_cont(cast(llm_score as double), 0.975), 6) as high from quals where llm_score is not null""",
    "q_a16_judge_ceiling": f"""{WITH}, p as (select *, {_TOP.format("llm_score")} as rn, lead(llm_score) over (partition by qid order by llm_score desc, pos) as nxt
      from pool where llm_score is not null), e as (select qid, count(*) as n, count(*) filter (where llm_score >= 1 - 1e-9) as top,
      count(distinct llm_score) as levels, max(case when rn = {K} and llm_score = nxt then 1 else 0 end) as tie from p group by qid)
      select count(*) as n_questions, round(sum(top) / sum(n), 6) as top_share, count(*) filter (where levels = 1) as constant,
        sum(tie) as ties from e""",
    "q_a18_stability": """with r as (select distinct tid, ts, rsr from fit where rsr is not null),
      e as (select tid, count(*) as n, max(rsr) - min(rsr) as span, stddev_pop(rsr) as sd from r group by tid having count(*) >= 2)
      select count(*) as n_chains, count(*) filter (where span < 1e-9) as identical,
        count(*) filter (where span >= 0.2 - 1e-9) as wide, round(max(span), 6) as span_max, round(avg(sd), 6) as mean_sd from e""",
    "q_a19_truncation_rates": f"""{WITH}, q as (select qid, min(case when level is null then source else source || '-L' || level end) as grp from asked group by qid),
      r as (select c.teacher, q.grp, coalesce(finish_reason = 'length', false) as cut from chains c join q on c.qid = q.qid where c.teacher is not null)
      select teacher, grp, cast(grouping(teacher, grp) as int) as level, count(*) as n, count(*) filter (where cut) as cut,
        round(avg(cast(cut as double)), 6) as rate from r group by rollup (teacher, grp)""",
    "q_a21_score_histogram": f"""{WITH}, c as (select cast(round(llm_score * 10) as int) as bin, count(*) as n from quals where llm_score is not null group by 1),
      b as (select unnest(range(0, 11))::int as bin), f as (select b.bin, coalesce(c.n, 0) as n from b left join c on b.bin = c.bin)
      select bin, n, round(n / sum(n) over (), 6) as share, n / sum(n) over () > 0.7 as dominant from f""",
    "q_a23_audit": f"""{WITH}, v as (
      select 'chain_without_question' as rule, count(*) as violations from chains where qid not in (select qid from asked where qid is not null)
      union all select 'chain_without_quality', count(*) from chains where tid not in (select tid from quals)
      union all select 'chain_without_fit', count(*) from chains where tid not in (select tid from fits)
      union all select 'repeated_tid', count(*) from (select tid from chains group by tid having count(*) > 1)
      union all select 'repeated_question_text', count(*) from (select question from asked where question is not null group by question having count(*) > 1)
      union all select 'tid_not_its_parts', count(*) from chains where teacher is not null and tid <> qid || '|' || teacher || '|' || sample_idx
      union all select 'more_than_one_model', cast(count(distinct model) > 1 as bigint) from fit
      union all select 'old_signals', count(*) from fit where signals_version < 2)
      select rule, violations, violations = 0 as ok from v""",
    "q_a24_flips": f"""{WITH}, r as (select benchmark, coalesce(trim(pred) = trim(gold), false) as new, coalesce(correct, false) as old from gens)
      select benchmark, count(*) as n, count(*) filter (where not old and new) as wrong_to_right,
        count(*) filter (where old and not new) as right_to_wrong from r group by benchmark""",
    "q_a26_coverage": f"""{WITH}, t as (select distinct tid, tid in (select tid from quals) as q, tid in (select tid from fits) as f from chains)
      select count(*) as n, count(*) filter (where q) as n_quality, count(*) filter (where f) as n_fit,
        count(*) filter (where q and f) as n_both from t""",
    "q_a30_teacher_counts": f"""{WITH}, p as (select * from pool where teacher is not null), c as (select qid, teacher, count(*) as m from p group by all)
      select t.teacher, coalesce(c.m, 0) as m, count(*) as n from (select distinct qid from p) q cross join (select distinct teacher from p) t
      left join c on c.qid = q.qid and c.teacher = t.teacher group by all""",
    "q_a34_usable_size": f"""{WITH}, e as (select c.qid, count(*) as n, count(q.qual) as m from chains c left join quals q on c.tid = q.tid group by c.qid)
      select count(*) as n_questions, count(*) filter (where m >= {K}) as usable, sum(n - m) as unjudged from e""",
    "q_a36_step_plan": f"""{WITH} select count(*) as n, count(local_nat) as with_local, round(avg(local_nat), 6) as mean_local,
      round(quantile_cont(cast(n_steps as double), 0.5), 6) as median_steps, sum(greatest(n_steps * 5 - 10, n_steps)) as items from pool""",
    "q_t4_paired_difference": f"""{_ACC} select benchmark, count(*) as n, round(avg(b - a), 6) as diff, round(stddev_samp(b - a), 6) as sd
      from paired group by benchmark""",
    "q_t6_top_one": f"""{WITH}, p as (select *, {_TOP.format("grape")} as rn, max(llm_score) over (partition by qid) as top,
      count(*) over (partition by qid) as m from pool where llm_score is not null)
      select count(*) as n_groups, sum(cast(llm_score = top as bigint)) as n_hits from p where rn = 1 and m >= 2""",
    "q_t12_auc": f"""{WITH}, p as (select teacher, n_tokens, coalesce(finish_reason = 'length', false) as label from pool
        where teacher is not null and n_tokens is not null),
      r as (select *, rank() over (partition by teacher order by n_tokens) + (count(*) over (partition by teacher, n_tokens) - 1) / 2.0 as r from p)
      select teacher, round(case when count(*) filter (where label) * count(*) filter (where not label) > 0 then
        (sum(case when label then r else 0 end) - count(*) filter (where label) * (count(*) filter (where label) + 1) / 2)
        / (count(*) filter (where label) * count(*) filter (where not label)) end, 6) as auc from r group by teacher""",
    "q_t15_kappa": f"""{WITH}, r as (select correct as x, trim(pred) = trim(gold) as y from gens where correct is not null and pred is not null and gold is not null),
      s as (select count(*) as n, avg(cast(x = y as double)) as po,
        avg(cast(x as double)) * avg(cast(y as double)) + avg(cast(not x as double)) * avg(cast(not y as double)) as pe from r)
      select n, round((po - pe) / nullif(1 - pe, 0), 6) as kappa from s""",
    "q_t16_length_split": f"""{_ACC}, cut as (select distinct benchmark, qid from first where tag in ('{BASE}', '{OTHER}')
        and not stopped and n_tokens >= 3072),
      m as (select p.*, case when c.qid is null then 'clean' else 'cut' end as cut from paired p left join cut c on p.benchmark = c.benchmark and p.qid = c.qid),
      g as (select benchmark, cut, count(*) as n, avg(b - a) as diff from m group by all)
      select benchmark, cut, n, round(diff, 6) as diff, round(n / sum(n) over (partition by benchmark) * diff, 6) as contribution from g
      union all select benchmark, 'all', count(*), round(avg(b - a), 6), round(avg(b - a), 6) from m group by benchmark""",
    "q_t21_teacher_ranks": f"""{WITH}, r as (select *, {_NR.format("grape")} as r from pool)
      select teacher, count(*) as n, round(avg(r), 6) as mean_rank from r where n >= 4 and teacher is not null group by teacher""",
    "q_t21_swaps": f"""{WITH}{_SUMRANK} select case when grn <= {K} then 'dropped' else 'added' end as change, teacher, count(*) as n
      from ss where (grn <= {K}) <> (srn <= {K}) group by all""",
    "q_t22_rank_meta": f"""{WITH}{_SUMRANK} select count(*) as n, round(avg(fr), 6) as fit_rank, round(avg(qr), 6) as quality_rank
      from ss where srn <= {K} and n > 1""",
    "q_t23_teacher_means": f"""{WITH}, m as (select qid, avg(grape) filter (where teacher = 'deepseek') as d,
        avg(grape) filter (where teacher = 'llama70b') as l, avg(grape) filter (where teacher = 'qwen72b') as q from pool group by qid)
      select qid, round(d + 1e-9, 6) as deepseek, round(l + 1e-9, 6) as llama70b, round(q + 1e-9, 6) as qwen72b,
        case when d = greatest(d, l, q) then 'deepseek' when l = greatest(d, l, q) then 'llama70b' else 'qwen72b' end as best
      from m where d is not null and l is not null and q is not null""",
    "q_t25_pilot_size": f"""{WITH}, m as (select qid, avg(grape) filter (where teacher = 'qwen72b') - avg(grape) filter (where teacher = 'deepseek') as d
        from pool group by qid)
      select count(d) as n, round(case when avg(d) > 0 then pow(1.645 * stddev_samp(d) / avg(d), 2) end, 3) as m from m""",
    "q_t27_run_settings": f"""{WITH}, r as (select tag, seed, benchmark, qid, count(distinct sample) as m from gens group by all),
      f as (select benchmark, m, count(distinct tag || '/' || seed) as n_runs from r group by all)
      select *, count(*) over (partition by benchmark) as kinds from f""",
    "q_u6_overlap_matrix": f"""{WITH}, v as (select *, greatest(0, least(n - {K}, cast(floor(0.3333333333 * n + 1e-9) as int))) as nd,
        row_number() over (partition by qid order by qual, pos desc) as vr from pool),
      s as (select 'random' as tag, qid, tid from pool where pos <= {K}
        union all select 'fit', qid, tid from (select *, {_TOP.format("grape")} as rn from pool) where rn <= {K}
        union all select 'quality', qid, tid from (select *, {_TOP.format("qual")} as rn from pool) where rn <= {K}
        union all select 'veto', qid, tid from (select *, {_TOP.format("grape")} as rn from v where vr > nd) where rn <= {K})
      select a.tag as tag_a, b.tag as tag_b, count(*) as n,
        round(100.0 * count(*) / (select count(*) from s where tag = a.tag), 6) as percent
      from s a join s b on a.qid = b.qid and a.tid = b.tid group by a.tag, b.tag""",
    "q_t7_topk_agreement": f"""{WITH}, p as (select *, {_TOP.format("grape")} as a, {_TOP.format("qual")} as b from pool where n > {K}),
      e as (select qid, count(*) filter (where a <= {K} and b <= {K}) as shared from p group by qid),
      s as (select cast(count(*) as double) as n, cast(count(*) filter (where shared = {K}) as double) as hits, avg(shared) as ms from e)
      select cast(n as bigint) as n, cast(hits as bigint) as hits, round(ms, 6) as mean_shared,
        round(greatest(0, (hits / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as low,
        round(least(1, (hits / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as high from s""",
    "q_t5_pair_agreement": f"""{WITH}, p as (select qid, tid, llm_score as x, round(rule_norm, 1) as y from pool where llm_score is not null and rule_norm is not null),
      j as (select a.x as ax, a.y as ay, b.x as bx, b.y as by_ from p a join p b on a.qid = b.qid and a.tid < b.tid)
      select count(*) filter (where (ax < bx and ay < by_) or (ax > bx and ay > by_)) as same,
        count(*) filter (where (ax < bx and ay > by_) or (ax > bx and ay < by_)) as diff,
        count(*) filter (where ax = bx) as tie_a, count(*) filter (where ay = by_) as tie_b,
        round(count(*) filter (where (ax < bx and ay < by_) or (ax > bx and ay > by_))
          / nullif(count(*) filter (where ax <> bx and ay <> by_), 0), 6) as rate from j""",
    "q_t3_pearson": f"""{WITH} select round(corr(cast(n_words as double), qual), 5) as r from pool""",
    "q_t1_spearman": f"""{WITH}, p as (select * from pool where llm_score is not null),
      r as (select qid, rank() over (partition by qid order by grape) + (count(*) over (partition by qid, grape) - 1) / 2.0 as x,
        rank() over (partition by qid order by llm_score) + (count(*) over (partition by qid, llm_score) - 1) / 2.0 as y from p)
      select qid, count(*) as n, round(case when var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end, 5) as rho
      from r group by qid having count(*) >= 3""",
    "q_t1_spearman_summary": f"""{WITH}, p as (select * from pool where rsr is not null),
      r as (select qid, rank() over (partition by qid order by grape) + (count(*) over (partition by qid, grape) - 1) / 2.0 as x,
        rank() over (partition by qid order by rsr) + (count(*) over (partition by qid, rsr) - 1) / 2.0 as y from p),
      s as (select case when var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as rho
        from r group by qid having count(*) >= 3)
      select count(rho) as n, round(avg(rho), 5) as mean, round(quantile_cont(rho, 0.5), 5) as median,
        round(avg(cast(rho < -1e-9 as double)), 6) as negative from s where rho is not null""",
}
