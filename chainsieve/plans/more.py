"""Joins, reports, samples and comparisons beyond the rules and the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainsieve.functions import text
from chainsieve.operators import methods, metrics, ranks, rules, samples, stats
from chainsieve.plans import selection
from chainsieve.operators.prefix import running_sums
from chainsieve.plans.base import K, WITH, chains, fits, generations, pool, quality, questions
from chainsieve.sources.tables import table


def _r(column, digits: int = 6):
    return F.round(column, digits)


def dispatch(spark: SparkSession, root: str) -> DataFrame:
    """Chains and questions that each method takes."""
    rows = pool(spark, root).where(F.col("llm_score").isNotNull())
    found = None
    for name in methods.method_list(exploratory=True):
        taken = methods.select(rows, name, K)
        part = taken.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("n_questions")).withColumn("method", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found.select("method", "n", "n_questions")


def excluded_method(spark: SparkSession, root: str) -> DataFrame:
    return methods.select(pool(spark, root), "grape_noqwen", K)


def orphans(spark: SparkSession, root: str) -> DataFrame:
    """Chains by source of their question; chains without one as such."""
    named = questions(spark, root).groupBy("qid").agg(F.min("source").alias("source"))
    found = chains(spark, root).select("tid", "qid").join(named, "qid", "left")
    return found.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def judged(spark: SparkSession, root: str) -> DataFrame:
    """Chains with their judgement; chains without keep a null score."""
    scores = quality(spark, root).select("tid", "llm_score", "qual")
    return chains(spark, root).select("tid", "qid", "teacher").join(scores, "tid", "left")


def assembled(spark: SparkSession, root: str) -> DataFrame:
    """The pool with local naturalness, which a whole question loses if one of its chains lacks it."""
    rows = pool(spark, root)
    w = Window.partitionBy("qid")
    whole = F.count("local_nat").over(w) == F.count(F.lit(1)).over(w)
    return rows.select("qid", "tid", "pos", F.when(whole, F.col("local_nat")).alias("local_nat"))


def merged(spark: SparkSession, root: str) -> DataFrame:
    """Chains with local naturalness, with the weight signal taken anew over just those."""
    rows = pool(spark, root).where("local_nat is not null")
    return rules.lark(rows).select("qid", "tid", _r("ghat", 9).alias("ghat"))


def disjoint(spark: SparkSession, root: str) -> DataFrame:
    """Main and extra chains put together, with a check that no chain is in both."""
    rows = chains(spark, root).select("tid", "finish_reason")
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    main, extra = rows.where(~cut).select("tid"), rows.where(cut).select("tid")
    both = main.intersect(extra).agg(F.count(F.lit(1)).alias("shared"))
    return main.unionByName(extra).agg(F.count(F.lit(1)).alias("n")).crossJoin(both)


def shared_report(spark: SparkSession, root: str) -> DataFrame:
    """Right answers of two tags on shared questions, by benchmark and in all."""
    rows = generations(spark, root).where("tag in ('base', 'fq.k3')")
    mine = lambda t: rows.where(F.col("tag") == t).select("benchmark", "qid").distinct()
    common = mine("base").intersect(mine("fq.k3"))
    kept = rows.join(common, ["benchmark", "qid"], "left_semi")
    right = F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double"))
    return kept.groupingSets([["benchmark", "tag"], ["tag"]], "benchmark", "tag").agg(
        F.count(F.lit(1)).alias("n"), _r(right).alias("acc")
    )


def same_sets(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root)
    return stats.same_sets(rules.top_k_lean(rows, "grape", K), rules.random_k(rows, K))


def salvaged(spark: SparkSession, root: str) -> DataFrame:
    """Judged and unjudged chains with their mean rule score."""
    kind = F.when(F.col("llm_score").isNull(), "none").when(F.col("llm_score") <= 0, "zero").otherwise("normal")
    return quality(spark, root).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("rule_score")).alias("mean_rule")
    )


def cost(spark: SparkSession, root: str) -> DataFrame:
    """What judging the truncated chains would cost, by their length against the others'."""
    size = F.length(F.coalesce("text", F.lit("")))
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    found = chains(spark, root, text=True).agg(
        F.count_if(cut).alias("n"), F.avg(F.when(cut, size)).alias("a"), F.avg(F.when(~cut, size)).alias("b")
    )
    ratio = F.greatest(F.lit(1.0), F.coalesce(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), F.lit(1.0)))
    return found.select("n", _r(ratio, 4).alias("ratio"), _r(F.col("n") * 0.00047 * ratio, 4).alias("usd"))


def usage(spark: SparkSession, root: str) -> DataFrame:
    return chains(spark, root).groupBy(F.coalesce("finish_reason", F.lit("none")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("completion_tokens").alias("tokens")
    )


def self_preference(spark: SparkSession, root: str) -> DataFrame:
    """Mean of two judges by teacher, over chains both have scored, and the spread of each."""
    rows = pool(spark, root).where("teacher is not null and llm_norm is not null and rule_norm is not null")
    found = rows.groupBy("teacher").agg(
        F.count(F.lit(1)).alias("n"), F.avg("llm_norm").alias("a"), F.avg("rule_norm").alias("b")
    ).where("n >= 10")
    w = Window.partitionBy()
    spread = lambda c: _r(F.max(c).over(w) - F.min(c).over(w) + 1e-9)
    return found.select(
        "teacher", "n", _r(F.col("a") + 1e-9).alias("judge_a"), _r(F.col("b") + 1e-9).alias("judge_b"), spread("a").alias("spread_a"), spread("b").alias("spread_b")
    )


def drift(spark: SparkSession, root: str) -> DataFrame:
    """Stored blends against those computed anew: rows whose blend moved, and by how much at most."""
    rows = selection.blended(spark, root).withColumnRenamed("qual", "again")
    old = quality(spark, root).select("tid", "qual")
    gap = F.abs(F.col("again") - F.col("qual"))
    return rows.join(old, "tid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gap > 1e-5).alias("moved"),
        F.count_if(F.col("again").isNull() != F.col("qual").isNull()).alias("lost"),
    )


def top_tenth(spark: SparkSession, root: str) -> DataFrame:
    """The tenth of all chains with the best rule scores: their judge mean and share of poor ones.

    Rows are placed in blocks, so they are never all in one task.
    """
    rows = quality(spark, root).where("rule_score is not null and llm_score is not null")
    keyed = rows.select("tid", "llm_score", (-F.col("rule_score")).alias("down"), F.lit("all").alias("grp"), F.lit(1).alias("one"))
    placed = running_sums(keyed, "grp", "down", "tid", {"one": "place"})
    whole = rows.agg(F.floor(F.count(F.lit(1)) / 10).alias("tenth"))
    best = placed.crossJoin(F.broadcast(whole)).where("place <= tenth")
    poor = (F.col("llm_score") <= 0.5).cast("double")
    return best.agg(F.count(F.lit(1)).alias("n"), _r(F.avg("llm_score")).alias("mean"), _r(F.avg(poor)).alias("poor"))


def correlation_matrix(spark: SparkSession, root: str) -> DataFrame:
    """Mean within-question rank correlation of every two signals."""
    names = ["grape", "rsr", "qual", "n_tokens"]
    rows = pool(spark, root).where("rsr is not null and n_tokens is not null")
    ranked = rows.select("qid", *[ranks.average_rank(F.col(n).cast("double"), "qid").alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = ranked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), *[stats.pearson(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in pairs]
    )
    return found.where("n >= 3").agg(*[_r(F.avg(f"{a}_{b}"), 5).alias(f"{a}_{b}") for a, b in pairs])


def lost_steps(spark: SparkSession, root: str) -> DataFrame:
    """Steps counted by the scorer against lines of the text."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""))
    rows = chains(spark, root, text=True).where("text is not null").select("tid", lines.alias("lines"))
    both = rows.join(fits(spark, root).select("tid", "n_steps"), "tid").where("n_steps is not null")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_steps") < F.col("lines")).alias("fewer"), _r(F.avg(F.col("n_steps").cast("double"))).alias("mean_steps")
    )


def rates(spark: SparkSession, root: str) -> DataFrame:
    """Median and mean characters a token of the generations, by tag."""
    rows = generations(spark, root, text=True).where("n_tokens > 0 and text is not null")
    rate = F.length("text") / F.col("n_tokens")
    return rows.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), _r(F.percentile(rate, F.lit(0.5))).alias("median"), _r(F.avg(rate)).alias("mean")
    )


def chunk_totals(spark: SparkSession, root: str) -> DataFrame:
    """Generations in chunks of 64 by benchmark, with tokens of each chunk and the sum so far."""
    w = Window.partitionBy("benchmark").orderBy("gen_id")
    rows = table(spark, root, "eval", "gen_id", "benchmark", "n_tokens").distinct()
    chunk = F.floor((F.row_number().over(w) - 1) / 64).alias("chunk")
    sums = rows.select("benchmark", "n_tokens", chunk).groupBy("benchmark", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")
    )
    return sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("benchmark").orderBy("chunk")))


def method_order(spark: SparkSession, root: str) -> DataFrame:
    """Tags in their fixed order; unknown ones after them by name."""
    known = F.array(*map(F.lit, ["base", "correct_only.k3", "random.k3", "grape.k3", "fq.k3"]))
    tags = table(spark, root, "eval", "tag").distinct()
    place = F.array_position(known, F.col("tag"))
    w = Window.orderBy(F.when(place == 0, 99).otherwise(place), "tag")
    return tags.select("tag", F.row_number().over(w).alias("place"))


def extremes(spark: SparkSession, root: str) -> DataFrame:
    """The five chains of the best and of the worst rule scores."""
    rows = quality(spark, root).where("rule_score is not null").select("tid", "rule_score")
    high = rows.orderBy(F.col("rule_score").desc(), "tid").limit(5).withColumn("end", F.lit("high"))
    low = rows.orderBy("rule_score", "tid").limit(5).withColumn("end", F.lit("low"))
    return high.unionByName(low)


def stratified(spark: SparkSession, root: str) -> DataFrame:
    """Ten questions of every level and of the other source, by hashed order."""
    rows = questions(spark, root).select("qid", "source", "level").distinct()
    return samples.first_by_hash(rows, "qid", 10, "source", "level")


def matched(spark: SparkSession, root: str) -> DataFrame:
    """Questions without chains and with a text no question with chains has, in the others' strata."""
    rows = questions(spark, root)
    used = rows.join(chains(spark, root).select("qid").distinct(), "qid", "left_semi")
    key = text.norm(F.col("question"))
    free = rows.join(used.select("qid").distinct(), "qid", "left_anti").withColumn("k", key)
    return free.join(used.select(key.alias("k")).distinct(), "k", "left_anti").select("qid", "source").distinct()


def pair_sample(spark: SparkSession, root: str) -> DataFrame:
    """Three chains of every question with three and more, as three pairs."""
    rows = rules.random_k(pool(spark, root), 3).groupBy("qid").agg(F.sort_array(F.collect_list("tid")).alias("t"))
    at = lambda i: F.element_at("t", i)
    pairs = F.array(*[F.struct(at(i).alias("a"), at(j).alias("b")) for i, j in ((1, 2), (1, 3), (2, 3))])
    return rows.select("qid", F.explode(pairs).alias("p")).select("qid", "p.a", "p.b")


def repeated(spark: SparkSession, root: str) -> DataFrame:
    """Keys that stand in more than one row of each table, before and after dropping equal rows."""
    found = None
    for name, key in (("candidates", "tid"), ("questions", "qid"), ("eval", "gen_id"), ("quality", "tid")):
        rows = table(spark, root, name)
        twice = lambda df: df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))  # noqa: B023, E731
        part = twice(rows).crossJoin(twice(rows.distinct()).withColumnRenamed("n", "left")).withColumn("name", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found.select("name", "n", "left")


def compared(spark: SparkSession, root: str) -> DataFrame:
    """First and last score of chains scored again: relative error and change of place."""
    rows = table(spark, root, "fit", "tid", "ts", "rsr").distinct().where("rsr is not null")
    both = rows.groupBy("tid").agg(F.count_distinct("ts").alias("m"), F.min_by("rsr", "ts").alias("a"), F.max_by("rsr", "ts").alias("b"))
    error = F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-9))
    return both.where("m = 2").agg(
        F.count(F.lit(1)).alias("n"), _r(F.percentile(error, F.lit(0.5))).alias("median"), _r(F.max(error)).alias("worst"), F.count_if(error < 0.01).alias("close")
    )


def decomposition(spark: SparkSession, root: str) -> DataFrame:
    """The gain of one tag over another split into two steps through a third; the steps add up."""
    acc = metrics.run_accuracy(generations(spark, root), 1).groupBy("tag", "benchmark").agg(F.avg("acc").alias("acc"))
    named = acc.withColumn("tag", F.replace("tag", F.lit(".k3"), F.lit("")))
    wide = named.groupBy("benchmark").pivot("tag", ["base", "correct_only", "fq"]).agg(F.first("acc")).na.drop()
    a, b, c = (F.col(t) for t in ("base", "correct_only", "fq"))
    return wide.select("benchmark", _r(c - a).alias("total"), _r(b - a).alias("first"), _r(c - b).alias("second"))


def stable_size(spark: SparkSession, root: str) -> DataFrame:
    """The least number of steps from which on every share of finished chains is above nine tenths."""
    rows = pool(spark, root).where("n_steps is not null")
    done = (~F.col("finish_reason").eqNullSafe("length")).cast("double")
    by = rows.groupBy("n_steps").agg(F.avg(done).alias("p"))
    after = F.min("p").over(Window.orderBy("n_steps").rowsBetween(0, Window.unboundedFollowing))
    return by.withColumn("low", after).agg(F.min(F.when(F.col("low") >= 0.9, F.col("n_steps"))).alias("m"))


def grader_check(spark: SparkSession, root: str) -> DataFrame:
    """Stored verdicts against text equality, tallied."""
    rows = generations(spark, root)
    case = F.concat(
        F.when(F.coalesce(F.col("correct"), F.lit(False)), "right").otherwise("wrong"),
        F.lit("/"),
        F.when(F.col("pred").isNull(), "none").when(F.trim("pred") == F.trim("gold"), "same").otherwise("other"),
    )
    return rows.groupBy(case.alias("case")).agg(F.count(F.lit(1)).alias("n"))


def levels(spark: SparkSession, root: str) -> DataFrame:
    """Levels written out and read back."""
    rows = questions(spark, root).select("qid", F.concat(F.lit("Level "), F.coalesce(F.col("level").cast("string"), F.lit("?"))).alias("written"))
    return rows.select("qid", text.parse_level(F.col("written")).alias("level"))


def clean_golds(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "eval_items", "item_id", "gold").distinct()
    spoilt = F.concat(F.lit(" $"), F.col("gold"), F.lit("^\\circ$ "))
    return rows.select("item_id", text.clean_gold(spoilt).alias("gold"))


def records(spark: SparkSession, root: str) -> DataFrame:
    """Running numbers of questions per source, counted before rows without gold are dropped."""
    w = Window.partitionBy("source").orderBy("qid")
    rows = questions(spark, root).withColumn("n", F.row_number().over(w) - 1)
    return rows.where("gold is not null").select("qid", F.format_string("%s_%05d", "source", F.col("n")).alias("number"))


def prompts(spark: SparkSession, root: str) -> DataFrame:
    """A prompt template filled in by plain replacement, so braces in texts do no harm."""
    rows = questions(spark, root).select("qid", "question").where("question is not null")
    filled = F.replace(F.lit("Question: {q}\nAnswer {inside} the box."), F.lit("{q}"), F.col("question"))
    return rows.select("qid", F.md5(filled).alias("digest"), F.length(filled).alias("n"))


def schedule(spark: SparkSession, root: str) -> DataFrame:
    """Learning-rate factor of each of 100 steps: ten of warm-up, then half a cosine."""
    s = F.col("id").cast("double")
    factor = F.when(s < 10, (s + 1) / 10).otherwise(0.5 * (1 + F.cos(F.pi() * (s - 10) / 90)))
    return spark.range(100).select(F.col("id").alias("step"), _r(factor).alias("factor"))


def windows(spark: SparkSession, root: str) -> DataFrame:
    """Training windows of 32 chains in hashed order, with tokens of each; chains are placed in blocks."""
    rows = rules.top_k_lean(pool(spark, root), "grape", K).where("n_tokens is not null")
    number = F.conv(F.substring(samples.hashed("tid"), 1, 12), 16, 10).cast("double")
    keyed = rows.select("tid", "n_tokens", number.alias("h"), F.lit("all").alias("grp"), F.lit(1).alias("one"))
    placed = running_sums(keyed, "grp", "h", "tid", {"one": "place"})
    return placed.select(F.floor((F.col("place") - 1) / 32).alias("window"), "n_tokens").groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("widest")
    )


def rank_correlation_zero(spark: SparkSession, root: str) -> DataFrame:
    found = stats.spearman_within(pool(spark, root), "llm_score", "n_words", least=2)
    return found.select("qid", _r(F.coalesce("rho", F.lit(0.0)), 5).alias("rho"))


def decision(spark: SparkSession, root: str) -> DataFrame:
    """Whether two rankings take the same set in four fifths of the questions."""
    rows = pool(spark, root).where(F.col("n") > K)
    both = stats.same_sets(rules.top_k_lean(rows, "grape", K), rules.top_k_lean(rows, "rsr", K, "min"))
    rate = F.avg(F.col("same").cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), _r(rate).alias("rate"), F.when(rate >= 0.8 - 1e-12, "keep").otherwise("differs").alias("verdict"))


QUERIES = {
    "q_w24_dispatch": dispatch,
    "q_w24_excluded_method": excluded_method,
    "q_j1_orphans": orphans,
    "q_j2_judged": judged,
    "q_j3_assembled": assembled,
    "q_j4_merged": merged,
    "q_j12_disjoint_union": disjoint,
    "q_j13_shared_report": shared_report,
    "q_u5_same_sets": same_sets,
    "q_u4_repeated": repeated,
    "q_a17_salvaged": salvaged,
    "q_a25_cost": cost,
    "q_a27_usage": usage,
    "q_a29_self_preference": self_preference,
    "q_a31_drift": drift,
    "q_a32_top_tenth": top_tenth,
    "q_a35_correlation_matrix": correlation_matrix,
    "q_a37_lost_steps": lost_steps,
    "q_a38_rates": rates,
    "q_a39_chunk_totals": chunk_totals,
    "q_o2_method_order": method_order,
    "q_o4_extremes": extremes,
    "q_x2_stratified": stratified,
    "q_x8_matched": matched,
    "q_x9_pair_sample": pair_sample,
    "q_t2_spearman_zero": rank_correlation_zero,
    "q_t10_decision": decision,
    "q_t17_decomposition": decomposition,
    "q_t24_stable_size": stable_size,
    "q_t26_grader_check": grader_check,
    "q_t28_compared": compared,
    "q_f2_levels": levels,
    "q_f19_clean_gold": clean_golds,
    "q_f23_prompts": prompts,
    "q_f26_records": records,
    "q_m8_windows": windows,
    "q_m9_schedule": schedule,
}

_TOP = "row_number() over (partition by qid order by {} desc, pos)"
_ACC1 = f"""{WITH}, first as (select * exclude (k) from (select *, row_number() over (
    partition by tag, seed, benchmark, qid, sample order by gen_id desc) as k from gens where sample < 1) where k = 1),
runs as (select tag, seed, benchmark, avg(cast(coalesce(correct, false) as double)) as acc from first group by all),
acc as (select tag, benchmark, avg(acc) as acc from runs group by all)"""
_NOQWEN = f"""{WITH}, k as (select *, count(*) over (partition by qid) as m from pool where coalesce(teacher <> 'qwen72b', true)),
r as (select *, row_number() over (partition by qid order by grape desc, pos) as rn from k where m >= {K})"""
_NORM = r"lower(trim(regexp_replace({}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ' ', 'g')))"
_RANK = "rank() over (partition by qid order by {0}) + (count(*) over (partition by qid, {0}) - 1) / 2.0"
_COR = "case when var_pop({0}) > 1e-9 and var_pop({1}) > 1e-9 then covar_pop({0}, {1}) / sqrt(var_pop({0}) * var_pop({1})) end"
_PAIRS = [("grape", "rsr"), ("grape", "qual"), ("grape", "n_tokens"), ("rsr", "qual"), ("rsr", "n_tokens"), ("qual", "n_tokens")]

SQL = {
    "q_w24_excluded_method": f"{_NOQWEN} select qid, tid from r where rn <= {K}",
    "q_j1_orphans": f"""{WITH} select coalesce(s.source, 'none') as source, count(*) as n from chains c
      left join (select qid, min(source) as source from asked group by qid) s on c.qid = s.qid group by 1""",
    "q_j2_judged": f"{WITH} select c.tid, c.qid, c.teacher, q.llm_score, q.qual from chains c left join quals q on c.tid = q.tid",
    "q_j3_assembled": f"""{WITH} select qid, tid, pos, case when count(local_nat) over (partition by qid) = count(*) over (partition by qid)
      then local_nat end as local_nat from pool""",
    "q_j4_merged": f"""{WITH}, r as (select *, case when mean_surprisal <= 1e-30 then 0.0 else brier / mean_surprisal end as rho from pool where local_nat is not null),
      s as (select *, sum(mean_surprisal) over (partition by qid) as total, sum(rho * mean_surprisal) over (partition by qid) as wt from r)
      select qid, tid, round(mean_surprisal / total * (2 * rho - wt / total), 9) as ghat from s""",
    "q_j12_disjoint_union": f"{WITH} select count(*) as n, 0 as shared from chains",
    "q_j13_shared_report": f"""{WITH}, r as (select * from gens where tag in ('base', 'fq.k3')),
      c as (select benchmark, qid from r where tag = 'base' intersect select benchmark, qid from r where tag = 'fq.k3')
      select benchmark, tag, count(*) as n, round(avg(cast(coalesce(correct, false) as double)), 6) as acc
      from r semi join c using (benchmark, qid) group by grouping sets ((benchmark, tag), (tag))""",
    "q_u5_same_sets": f"""{WITH}, p as (select *, {_TOP.format("grape")} as g from pool),
      e as (select qid, sum(cast(g <= {K} and pos <= {K} as int)) as shared, sum(cast(g <= {K} as int)) as na, sum(cast(pos <= {K} as int)) as nb from p group by qid)
      select qid, shared, shared = na and na = nb as same from e""",
    "q_u4_repeated": " union all ".join(
        f"""select '{n}' as name, (select count(*) from (select {k} from {n} group by {k} having count(*) > 1)) as n,
        (select count(*) from (select {k} from (select distinct * from {n}) group by {k} having count(*) > 1)) as "left" """
        for n, k in (("candidates", "tid"), ("questions", "qid"), ("eval", "gen_id"), ("quality", "tid"))
    ),
    "q_a17_salvaged": f"""{WITH} select case when llm_score is null then 'none' when llm_score <= 0 then 'zero' else 'normal' end as kind,
      count(*) as n, round(avg(rule_score), 6) as mean_rule from quals group by 1""",
    "q_a25_cost": f"""{WITH}, c as (select coalesce(finish_reason = 'length', false) as cut, length(coalesce(text, '')) as s from chains),
      r as (select count(*) filter (where cut) as n, greatest(1.0, coalesce(avg(s) filter (where cut) / nullif(avg(s) filter (where not cut), 0), 1.0)) as ratio from c)
      select n, round(ratio, 4) as ratio, round(n * 0.00047 * ratio, 4) as usd from r""",
    "q_a27_usage": f"{WITH} select coalesce(finish_reason, 'none') as status, count(*) as n, sum(completion_tokens) as tokens from chains group by 1",
    "q_a29_self_preference": f"""{WITH}, t as (select teacher, count(*) as n, avg(llm_norm) as a, avg(rule_norm) as b from pool
        where teacher is not null and llm_norm is not null and rule_norm is not null group by teacher having count(*) >= 10)
      select teacher, n, round(a + 1e-9, 6) as judge_a, round(b + 1e-9, 6) as judge_b, round(max(a) over () - min(a) over () + 1e-9, 6) as spread_a,
        round(max(b) over () - min(b) over () + 1e-9, 6) as spread_b from t""",
    "q_a31_drift": selection.SQL["q_w3_quality_blend"].replace(
        "select qid, tid, round(rn, 6) as rule_norm, round(ln, 6) as llm_norm, round(0.5 * rn + 0.5 * ln, 6) as qual from t",
        """, n as (select tid, round(0.5 * rn + 0.5 * ln, 6) as again from t)
        select count(*) as n, count(*) filter (where abs(n.again - q.qual) > 1e-5) as moved,
          count(*) filter (where (n.again is null) <> (q.qual is null)) as lost from n join quals q on n.tid = q.tid""",
    ).replace("from s)\n      , n", "from s), n"),
    "q_a32_top_tenth": f"""{WITH}, r as (select llm_score, count(*) over () as n, row_number() over (order by rule_score desc, tid) as place from quals
        where rule_score is not null and llm_score is not null)
      select count(*) as n, round(avg(llm_score), 6) as mean, round(avg(cast(llm_score <= 0.5 as double)), 6) as poor from r where place <= n // 10""",
    "q_a35_correlation_matrix": f"""{WITH}, p as (select * from pool where rsr is not null and n_tokens is not null),
      r as (select qid, {", ".join(f"{_RANK.format(c)} as {c}" for c in ("grape", "rsr", "qual", "n_tokens"))} from p),
      s as (select qid, {", ".join(f"{_COR.format(a, b)} as {a}_{b}" for a, b in _PAIRS)} from r group by qid having count(*) >= 3)
      select {", ".join(f"round(avg({a}_{b}), 5) as {a}_{b}" for a, b in _PAIRS)} from s""",
    "q_a37_lost_steps": f"""{WITH}, l as (select c.tid, f.n_steps, len(list_filter(string_split(c.text, chr(10)), lambda s: trim(s) <> '')) as lines
        from chains c join fits f on c.tid = f.tid where c.text is not null and f.n_steps is not null)
      select count(*) as n, count(*) filter (where n_steps < lines) as fewer, round(avg(cast(n_steps as double)), 6) as mean_steps from l""",
    "q_a38_rates": f"""{WITH} select tag, count(*) as n, round(quantile_cont(cast(length(text) as double) / n_tokens, 0.5), 6) as median,
      round(avg(cast(length(text) as double) / n_tokens), 6) as mean from gens where n_tokens > 0 and text is not null group by tag""",
    "q_a39_chunk_totals": """with r as (select benchmark, n_tokens, (row_number() over (partition by benchmark order by gen_id) - 1) // 64 as chunk
        from (select distinct gen_id, benchmark, n_tokens from eval)),
      s as (select benchmark, chunk, count(*) as n, coalesce(sum(n_tokens), 0) as tokens from r group by all)
      select *, sum(tokens) over (partition by benchmark order by chunk) as upto from s""",
    "q_o2_method_order": """select tag, row_number() over (order by coalesce(list_position(['base', 'correct_only.k3', 'random.k3', 'grape.k3', 'fq.k3'], tag), 99), tag) as place
      from (select distinct tag from eval)""",
    "q_o4_extremes": f"""{WITH}, r as (select tid, rule_score from quals where rule_score is not null)
      select * from (select tid, rule_score, 'high' as "end" from r order by rule_score desc, tid limit 5)
      union all select * from (select tid, rule_score, 'low' from r order by rule_score, tid limit 5)""",
    "q_x2_stratified": f"""{WITH} select qid, source, level from (select *, row_number() over (partition by source, level order by sha256('42|' || qid), qid) as rn
      from (select distinct qid, source, level from asked)) where rn <= 10""",
    "q_x8_matched": f"""{WITH}, u as (select * from asked where qid in (select qid from chains))
      select distinct qid, source from asked where qid not in (select qid from u)
        and coalesce({_NORM.format("question")} not in (select {_NORM.format("question")} from u where question is not null), true)""",
    "q_x9_pair_sample": f"""{WITH}, t as (select qid, list_sort(list(tid)) as t from pool where pos <= 3 group by qid)
      select qid, t[1] as a, t[2] as b from t union all select qid, t[1], t[3] from t union all select qid, t[2], t[3] from t""",
    "q_t2_spearman_zero": f"""{WITH}, r as (select qid, {_RANK.format("llm_score")} as x, {_RANK.format("n_words")} as y from pool where llm_score is not null and n_words is not null)
      select qid, round(coalesce({_COR.format("x", "y")}, 0.0), 5) as rho from r group by qid having count(*) >= 2""",
    "q_t10_decision": f"""{WITH}, p as (select *, {_TOP.format("grape")} as a, row_number() over (partition by qid order by -rsr desc nulls last, pos) as b from pool where n > {K}),
      e as (select qid, count(*) filter (where a <= {K} and b <= {K}) = {K} as same from p group by qid)
      select count(*) as n, round(avg(cast(same as double)), 6) as rate,
        case when avg(cast(same as double)) >= 0.8 - 1e-12 then 'keep' else 'differs' end as verdict from e""",
    "q_t17_decomposition": f"""{_ACC1}, w as (select benchmark, max(acc) filter (where tag = 'base') as a,
        max(acc) filter (where tag = 'correct_only.k3') as b, max(acc) filter (where tag = 'fq.k3') as c from acc group by benchmark)
      select benchmark, round(c - a, 6) as total, round(b - a, 6) as first, round(c - b, 6) as second from w
      where a is not null and b is not null and c is not null""",
    "q_t24_stable_size": f"""{WITH}, b as (select n_steps, avg(cast(coalesce(finish_reason, '') <> 'length' as double)) as p from pool where n_steps is not null group by n_steps),
      l as (select n_steps, min(p) over (order by n_steps rows between current row and unbounded following) as low from b)
      select min(case when low >= 0.9 then n_steps end) as m from l""",
    "q_t26_grader_check": f"""{WITH} select (case when coalesce(correct, false) then 'right' else 'wrong' end) || '/' ||
      (case when pred is null then 'none' when trim(pred) = trim(gold) then 'same' else 'other' end) as "case", count(*) as n from gens group by 1""",
    "q_t28_compared": """with r as (select tid, count(distinct ts) as m, arg_min(rsr, ts) as a, arg_max(rsr, ts) as b from (select distinct tid, ts, rsr from fit where rsr is not null) group by tid),
      e as (select abs(b - a) / greatest(abs(a), 1e-9) as e from r where m = 2)
      select count(*) as n, round(quantile_cont(e, 0.5), 6) as median, round(max(e), 6) as worst, count(*) filter (where e < 0.01) as close from e""",
    "q_f2_levels": f"{WITH} select qid, case when level between 0 and 9 then level end as level from asked",
    "q_f19_clean_gold": """select distinct item_id, regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(' $' || gold || '^\\circ$ '),
      '\\^\\s*\\{?\\s*\\\\circ\\s*\\}?|°', '', 'g')), '^\\$+|\\$+$', '', 'g')), '^(-?\\d+)\\.0+$', '\\1') as gold from eval_items""",
    "q_f23_prompts": f"""{WITH}, f as (select qid, replace('Question: {{q}}' || chr(10) || 'Answer {{inside}} the box.', '{{q}}', question) as t from asked where question is not null)
      select qid, md5(t) as digest, length(t) as n from f""",
    "q_f26_records": f"""{WITH} select qid, source || '_' || lpad(cast(n as varchar), 5, '0') as number
      from (select *, row_number() over (partition by source order by qid) - 1 as n from asked) where gold is not null""",
    "q_m8_windows": f"""{WITH}, p as (select *, {_TOP.format("grape")} as rn from pool),
      w as (select n_tokens, (row_number() over (order by sha256('42|' || tid), tid) - 1) // 32 as "window" from p where rn <= {K} and n_tokens is not null)
      select "window", count(*) as n, sum(n_tokens) as tokens, max(n_tokens) as widest from w group by 1""",
    "q_m9_schedule": """select s as step, round(case when s < 10 then (s + 1) / 10 else 0.5 * (1 + cos(pi() * (s - 10) / 90)) end, 6) as factor
      from (select unnest(range(0, 100)) as s)""",
}
