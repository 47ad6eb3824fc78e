"""Text, answer, JSON, vector, sample, join, file and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainsieve.functions import answers, steps, text
from chainsieve.operators import objective, ranks, samples
from chainsieve.plans.base import K, WITH, chains, fits, generations, pool, quality, questions
from chainsieve.session import checkpoint_dir
from chainsieve.sources import files
from chainsieve.sources.tables import table
from chainsieve.streaming import logs


#: Most items one side of the fuzzy comparison may have.
MOST_ITEMS = 10_000


def _r(column, digits: int = 6):
    return F.round(column, digits)


def normalised(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents", "doc_id", "text")
    return rows.select("doc_id", F.md5(text.norm(F.col("text"))).alias("digest"), F.length(text.norm(F.col("text"))).alias("n"))


def golds(spark: SparkSession, root: str) -> DataFrame:
    """Gold answers read from solutions: the last box, or what follows the last mark."""
    rows = questions(spark, root).select("qid", "source", "solution")
    boxed = answers.last_boxed_col("solution")
    return rows.select("qid", F.when(F.col("source") == "math", boxed).otherwise(text.gsm_gold(F.col("solution"))).alias("found"))


def boxes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "candidates", "tid", "text").distinct()
    return rows.select("tid", answers.last_boxed_col("text").alias("pred"))


def graded(spark: SparkSession, root: str) -> DataFrame:
    """Predictions compared with their gold answers; texts first, values on what is left."""
    rows = table(spark, root, "eval", "gen_id", "benchmark", "pred", "gold").distinct()
    same = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    plain = rows.where(same).select("gen_id", F.lit(True).alias("right"))
    rest = rows.where(~same)
    right = F.when(F.col("benchmark") == "bbh", answers.bbh_equal_col("pred", "gold")).otherwise(answers.equiv_col("pred", "gold"))
    return plain.unionByName(rest.select("gen_id", right.alias("right")))


def answer_norm(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "eval", "gold").distinct().where("gold is not null")
    return rows.select("gold", answers.normalize_col("gold").alias("plain"))


def tokens(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents", "doc_id", "text")
    found = text.words(F.col("text"))
    return rows.select("doc_id", F.size(found).alias("n_words"), F.size(F.array_distinct(found)).alias("n_distinct"))


_FEATURES = ["n_words", "self_verification", "exploratory", "adaptive"]


def raw_features(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "candidates", "tid", "text").distinct()
    found = text.features(F.col("text"))
    return rows.select("tid", found["n_words"].alias("n_words"), *[_r(found[c], 9).alias(c) for c in _FEATURES[1:]])


def rule_score(spark: SparkSession, root: str) -> DataFrame:
    """Weighted sum of the features' z-scores over all chains."""
    # Words are cut once, and equal rows are dropped by features and a hash, so no text is moved.
    rows = table(spark, root, "candidates", "tid", "text")
    rows = rows.select("tid", F.md5("text").alias("_h"), text.words(F.coalesce("text", F.lit(""))).alias("_words"))
    found = text.word_features(F.col("_words"))
    flat = rows.select("tid", "_h", *[found[c].cast("double").alias(c) for c in _FEATURES]).distinct()
    scale = flat.agg(*[F.avg(c).alias(f"m_{c}") for c in _FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in _FEATURES])
    names = dict(zip(text.WEIGHTS, _FEATURES))
    z = lambda c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0))
    score = sum((F.lit(w) * z(names[n]) for n, w in text.WEIGHTS.items()), F.lit(0.0))
    return flat.crossJoin(F.broadcast(scale)).select("tid", _r(score).alias("score"))


def sentences(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "candidates", "tid", "text").distinct()
    return rows.select("tid", F.size(steps.sentence_ends_col("text")).alias("n_steps"))


def step_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row per step of every chain, with the rule that cut it and its context of one and four steps."""
    rows = table(spark, root, "candidates", "tid", "text").distinct().withColumn("s", steps.fallback_col("text"))
    flat = rows.select("tid", F.col("s.rule").alias("rule"), F.posexplode("s.ends").alias("step", "stop"))
    w = Window.partitionBy("tid").orderBy("step")
    start = F.coalesce(F.lag("stop").over(w), F.lit(0))
    flat = flat.withColumn("start", start)
    first = F.first("start").over(w)
    context = lambda k: F.coalesce(F.lag("start", k).over(w), first)
    return flat.select("tid", "rule", "step", context(1).alias("context1"), context(4).alias("context4"), "start", "stop")


def line_context(spark: SparkSession, root: str) -> DataFrame:
    """Of the text before a line, the share that the last two lines make up."""
    rows = table(spark, root, "candidates", "tid", "text").distinct().where("text is not null")
    flat = rows.select("tid", F.posexplode(F.split("text", "\n")).alias("line", "part")).withColumn("size", F.length("part"))
    w = Window.partitionBy("tid").orderBy("line")
    near = F.sum("size").over(w.rowsBetween(-2, -1))
    before = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return flat.select(
        "tid", "line", _r(F.when(before > 0, near / F.nullif(before, F.lit(0))).otherwise(1.0)).alias("share")
    ).where("line > 0")


def repeats(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "eval", "gen_id", "text").distinct().where("text is not null")
    return rows.select("gen_id", _r(text.repeat_share(F.col("text"))).alias("share"))


def row_checks(spark: SparkSession, root: str) -> DataFrame:
    """Counts of what can be wrong with the held-out items, by benchmark."""
    rows = table(spark, root, "eval_items").distinct()
    same = F.count(F.lit(1)).over(Window.partitionBy("benchmark", text.norm(F.col("question"))))
    rows = rows.withColumn("twins", same)
    number = F.col("gold").rlike(r"^-?\d+$")
    return rows.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.trim("question"), F.lit("")) == "").alias("empty"),
        F.count_if(F.col("gold").isNull()).alias("no_gold"),
        F.count_if(F.col("twins") > 1).alias("twins"),
        F.count_if(~number).alias("not_whole"),
        F.count_if(number & ~F.col("gold").try_cast("bigint").between(0, 999)).alias("out_of_range"),
        F.count_if(text.control_chars(F.col("question")) > 0).alias("control"),
    )


def judge_json(spark: SparkSession, root: str) -> DataFrame:
    """Judge answers rebuilt from the quality table, clean and broken, and read again."""
    rows = quality(spark, root).where("llm_score is not null")
    body = F.concat(F.lit('{"overall_score": '), F.format_number("llm_score", 1), F.lit(', "overall_reason": "so \\left( it \\frac is"}'))
    kind = F.pmod(F.length("tid"), F.lit(4))
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .otherwise(F.substring(body, 1, 40))
    )
    found = text.judge_score(raw)
    return rows.select("tid", found["score"].alias("score"), found["how"].alias("how"))


def token_signals(spark: SparkSession, root: str) -> DataFrame:
    """Rank, surprisal and Brier sums over token arrays (here: word lengths stand in for token ranks)."""
    rows = table(spark, root, "candidates", "tid", "text").distinct()
    rows = rows.withColumn("ranks", F.transform(text.words(F.col("text")), F.length)).where(F.size("ranks") > 0)
    total = lambda f: F.aggregate("ranks", F.lit(0.0), lambda s, r: s + f(r))
    n = F.size("ranks")
    p = lambda r: 1.0 / (1.0 + r)
    return rows.select(
        "tid",
        _r(total(lambda r: F.least(r + 1, F.lit(100)).cast("double")) / F.greatest(total(lambda r: r / 10.0), F.lit(1e-6))).alias("rsr"),
        _r(-total(lambda r: r / 10.0) / n).alias("grape"),
        _r(total(lambda r: 1 - 2 * p(r) + p(r) * p(r)) / n).alias("brier"),
        _r(F.exp(total(lambda r: r / 10.0) / n)).alias("perplexity"),
    )


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings in groups of eight, with two made-up scores: the shape of a question's candidates."""
    rows = table(spark, root, "embeddings", "vec_id", "embedding", "label")
    return rows.select(
        F.floor(F.col("vec_id") / 8).alias("qid"),
        (F.col("vec_id") % 8).cast("int").alias("pos"),
        objective.l2_normalize(F.col("embedding")).alias("vec"),
        (F.col("vec_id") * 7919 % 101 / 100.0).alias("fit"),
        (F.col("vec_id") * 104729 % 97 / 96.0).alias("qual"),
        "label",
    )


def distances(spark: SparkSession, root: str) -> DataFrame:
    return objective.pair_distances(_vectors(spark, root)).select("qid", "i", "j", _r("d").alias("d"))


def distance_summary(spark: SparkSession, root: str) -> DataFrame:
    """Distances of pairs with the same and with different labels."""
    rows = _vectors(spark, root)
    d = objective.pair_distances(rows)
    label = lambda c: rows.select("qid", F.col("pos").alias(c), F.col("label").alias(f"l_{c}"))
    both = d.join(label("i"), ["qid", "i"]).join(label("j"), ["qid", "j"])
    kind = F.when(F.col("l_i") == F.col("l_j"), "same").otherwise("different").alias("kind")
    # Rounded distances are few values: they are counted, and percentiles found among the counts.
    counts = both.groupBy(kind, _r("d", 4).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("kind").orderBy("v"))
    placed = counts.withColumns({"upto": upto, "all": F.sum("c").over(Window.partitionBy("kind"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("all")), F.col("all") - 1), F.col("v")))
    picks = placed.groupBy("kind").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    return both.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.min("d"), 4).alias("low"),
        _r(F.max("d"), 4).alias("high"),
        _r(F.avg("d"), 4).alias("mean"),
        _r(F.stddev_pop("d"), 4).alias("sd"),
    ).join(picks, "kind")


def _objective(a: float, b: float, lam: float, scale: str = "raw"):
    def query(spark: SparkSession, root: str) -> DataFrame:
        found = objective.best_triple(objective.scored_triples(_vectors(spark, root), a, b, lam, scale))
        return found.select("qid", "p1", "p2", "p3", _r("div").alias("div"), _r("value").alias("value"))

    return query


def greedy(spark: SparkSession, root: str) -> DataFrame:
    return objective.greedy_sets(_vectors(spark, root), 0.4, K)


LAMBDAS = [0.0, 0.15, 0.4, 1.0]


def lambda_scan(spark: SparkSession, root: str) -> DataFrame:
    """Per weight of diversity: groups whose best set changes, and the mean diversity."""
    base = objective.scored_triples(_vectors(spark, root), 1, 1, 0.0)
    every = base.withColumn("lam", F.explode(F.array(*[F.lit(x) for x in LAMBDAS])))
    scored = every.withColumn("value", F.round(F.col("value") + F.col("lam") * F.col("div"), 9))
    best = objective.best_triple(scored, "qid", "lam")
    zero = best.where("lam = 0").select("qid", F.struct("p1", "p2", "p3").alias("z"))
    both = best.join(zero, "qid")
    changed = (F.struct("p1", "p2", "p3") != F.col("z")).cast("double")
    return both.groupBy("lam").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(changed)).alias("changed"), _r(F.avg("div")).alias("mean_div"))


def lambda_grid(spark: SparkSession, root: str) -> DataFrame:
    """The smallest weight that changes a tenth, a quarter, a half of the groups."""
    found = lambda_scan(spark, root)
    targets = [0.1, 0.25, 0.5]
    return found.agg(*[F.min(F.when(F.col("changed") >= t, F.col("lam"))).alias(f"at_{int(100 * t)}") for t in targets])


def banned(spark: SparkSession, root: str) -> DataFrame:
    """Training questions whose text is none of the held-out ones."""
    rows = questions(spark, root)
    held = table(spark, root, "eval_items", "question").select(text.norm(F.col("question")).alias("k")).distinct()
    return rows.join(held, text.norm(F.col("question")) == F.col("k"), "left_anti").select("qid").distinct()


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """Question, teacher and sample still to be generated: three of each, less those done."""
    names = ["deepseek", "llama70b", "qwen72b"]
    every = questions(spark, root).select("qid").distinct()
    every = every.withColumn("teacher", F.explode(F.array(*map(F.lit, names)))).withColumn(
        "sample_idx", F.explode(F.sequence(F.lit(0), F.lit(2)))
    )
    todo = every.withColumn("tid", F.concat_ws("|", "qid", "teacher", "sample_idx"))
    return files.skip_done(todo, chains(spark, root), "tid").select("tid", "qid", "teacher", "sample_idx")


def shared_runs(spark: SparkSession, root: str) -> DataFrame:
    """Seeds that two tags have in common."""
    rows = table(spark, root, "eval", "tag", "seed").distinct()
    seeds = lambda t: rows.where(F.col("tag") == t).select("seed")
    return seeds("base").intersect(seeds("fq.k3"))


def set_difference(spark: SparkSession, root: str) -> DataFrame:
    """Questions in one table and not in the other, each way."""
    asked, answered = questions(spark, root).select("qid"), chains(spark, root).select("qid")
    only = lambda a, b, name: a.distinct().exceptAll(b.distinct()).withColumn("only_in", F.lit(name))
    return only(asked, answered, "questions").unionByName(only(answered, asked, "candidates"))


def nearest(spark: SparkSession, root: str) -> DataFrame:
    """For every item of one contest the most similar one of the other; both are fixed small sets."""
    import difflib

    import pandas as pd

    rows = table(spark, root, "eval_items", "item_id", "benchmark", "question").distinct().where("question is not null")
    right = rows.where("benchmark = 'aime25'").select("item_id", "question").orderBy("item_id").limit(MOST_ITEMS + 1).collect()
    if len(right) > MOST_ITEMS:
        raise ValueError(f"the fuzzy comparison is meant for at most {MOST_ITEMS} items")
    others = [(r["item_id"], r["question"]) for r in right]

    def match(batches):
        for frame in batches:
            out = []
            for item, question in zip(frame["item_id"], frame["question"]):
                best = max(
                    ((difflib.SequenceMatcher(None, question, q, autojunk=False).ratio(), n) for n, (_, q) in enumerate(others)),
                    key=lambda x: (x[0], -x[1]),
                    default=None,
                )
                if best:
                    out.append((item, others[best[1]][0], round(best[0], 6)))
            yield pd.DataFrame(out, columns=["item_id", "other_id", "ratio"])

    left = rows.where("benchmark = 'aime24'").select("item_id", "question")
    return left.mapInPandas(match, "item_id string, other_id string, ratio double")


def hashed_sample(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "eval_items", "item_id", "benchmark", "subset").distinct().where("benchmark = 'bbh'")
    return samples.first_by_hash(rows, "item_id", 5, "subset").select("item_id", "subset")


def allocated(spark: SparkSession, root: str) -> DataFrame:
    rows = questions(spark, root).select("qid", F.concat_ws("-L", "source", "level").alias("stratum")).distinct()
    return samples.proportional(rows, "qid", "stratum", 50).select("qid", "stratum")


def group_sample(spark: SparkSession, root: str) -> DataFrame:
    return samples.whole_groups(chains(spark, root).select("tid", "qid"), "qid", 300)


def equal_sample(spark: SparkSession, root: str) -> DataFrame:
    rows = chains(spark, root).select("tid", "teacher").where("teacher is not null")
    return samples.equal_per_group(rows, "tid", "teacher", 60)


def packed(spark: SparkSession, root: str) -> DataFrame:
    """Quality and fit side by side, each with its prefix, chains of either table."""
    q = quality(spark, root).select("tid", F.col("qual").alias("quality_qual"), F.col("llm_score").alias("quality_llm_score"))
    f = fits(spark, root).select("tid", F.col("rsr").alias("student_rsr"), F.col("n_tokens").alias("student_n_tokens"))
    return q.join(f, "tid", "full")


def packed_generations(spark: SparkSession, root: str) -> DataFrame:
    """The first row of every run, question and sample, with its item's benchmark, and what has no item."""
    first = Window.partitionBy("tag", "seed", "qid", "sample").orderBy("gen_id")
    rows = generations(spark, root).withColumn("k", F.row_number().over(first)).where("k = 1")
    items = table(spark, root, "eval_items", "item_id", F.col("benchmark").alias("of")).distinct()
    joined = rows.join(items, F.col("qid") == F.col("item_id"), "left")
    return joined.groupBy(F.coalesce("of", F.lit("no item")).alias("of")).agg(F.count(F.lit(1)).alias("n"))


def round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Questions written as JSON Lines and read again."""
    folder = f"{checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(questions(spark, root), folder)
    schema = "qid string, source string, level int, question string, solution string, gold string"
    return files.read_jsonl(spark, f"{folder}/*.json", schema)


def table_hash(spark: SparkSession, root: str) -> DataFrame:
    """Whether a table and its shuffled copy have one fingerprint, and its number of rows."""
    rows = questions(spark, root)
    a = files.fingerprint(rows).select("n", F.col("digest").alias("a"))
    b = files.fingerprint(rows.repartition(7, "question")).select(F.col("digest").alias("b"))
    return a.crossJoin(b).select("n", (F.col("a") == F.col("b")).alias("same"))


def budget(spark: SparkSession, root: str) -> DataFrame:
    """Tokens spent by day, and the running sum up to each."""
    rows = chains(spark, root).where("ts is not null")
    days = rows.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum("completion_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("upto", upto)


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    return logs.windowed_counts(spark, f"{root}/events.parquet", "ts", "event_type", "1 day")


def stream_compacted(spark: SparkSession, root: str) -> DataFrame:
    rows = logs.compacted(spark, f"{root}/fit.parquet", ["tid"], ["ts", "grape", "rsr", "n_tokens"])
    return rows.select("tid", "ts", "rsr", "n_tokens")


QUERIES = {
    "q_f1_norm": normalised,
    "q_f3_gold": golds,
    "q_f4_last_boxed": boxes,
    "q_f6_normalize_answer": answer_norm,
    "q_f7_grade": graded,
    "q_f10_tokenize": tokens,
    "q_f11_features": raw_features,
    "q_f12_rule_score": rule_score,
    "q_f13_sentences": sentences,
    "q_f14_steps": step_rows,
    "q_f21_repeat_share": repeats,
    "q_f27_row_checks": row_checks,
    "q_n1_judge_json": judge_json,
    "q_m1_token_signals": token_signals,
    "q_m4_pair_distances": distances,
    "q_a15_distance_summary": distance_summary,
    "q_w20_objective": _objective(1, 1, 0.4),
    "q_w20_fit_only": _objective(1, 0, 0.0),
    "q_w20_quality_only": _objective(0, 1, 0.0),
    "q_w20_diversity_only": _objective(0, 0, 1.0),
    "q_w22_scaled_diversity": _objective(1, 1, 0.4, "minmax"),
    "q_w23_greedy": greedy,
    "q_t19_lambda_scan": lambda_scan,
    "q_t20_lambda_grid": lambda_grid,
    "q_w26_context_share": line_context,
    "q_j7_banned": banned,
    "q_j8_tasks": tasks,
    "q_j11_nearest": nearest,
    "q_u2_shared_runs": shared_runs,
    "q_u3_set_difference": set_difference,
    "q_x4_hashed_sample": hashed_sample,
    "q_x3_allocated_sample": allocated,
    "q_x5_group_sample": group_sample,
    "q_x6_equal_sample": equal_sample,
    "q_k6_fingerprint": table_hash,
    "q_k8_packed": packed,
    "q_k9_packed_generations": packed_generations,
    "q_s1_jsonl_round_trip": round_trip,
    "q_s14_budget": budget,
    "q_s14_stream_windows": stream_windows,
    "q_s14_stream_compacted": stream_compacted,
}

# The content of a box, braces nested six deep at most.
_NESTED = r"(?:[^{}\\]|\\[{}]|\\)"
for _ in range(5):
    _NESTED = rf"(?:[^{{}}\\]|\\[{{}}]|\\|\{{{_NESTED}*\}})"


def _tail(column: str) -> str:
    """What stands from the last box opened on."""
    return rf"regexp_extract({column}, '(?s)^.*(\\(?:boxed|fbox).*)$', 1)"


def _boxed(column: str) -> str:
    braced = rf"regexp_extract(tail, '(?s)^\\(?:boxed|fbox) *\{{({_NESTED}*)\}}', 1)"
    bare = r"regexp_extract(tail, '^\\(?:boxed|fbox) *([^\s$]+)', 1)"
    return rf"case when {column} is not null then nullif(trim(case when regexp_matches(tail, '^\\(?:boxed|fbox) *\{{') then {braced} else {bare} end), '') end"


_V = """with v as (select vec_id // 8 as qid, cast(vec_id % 8 as int) as pos, cast(embedding as double[]) as e, label,
  vec_id * 7919 % 101 / 100.0 as fit, vec_id * 104729 % 97 / 96.0 as qual from embeddings),
d as (select a.qid, a.pos as i, b.pos as j, a.label as li, b.label as lj,
  sqrt(greatest(0, 2 - 2 * list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)))) as d
  from v a join v b on a.qid = b.qid and a.pos < b.pos),
t as (select x.qid, x.i as p1, x.j as p2, y.j as p3, least(x.d, y.d) + least(x.d, z.d) + least(y.d, z.d) as div
  from d x join d y on x.qid = y.qid and x.i = y.i and x.j < y.j join d z on z.qid = x.qid and z.i = x.j and z.j = y.j)"""


def _objective_sql(a: float, b: float, lam: float, scale: str = "raw") -> str:
    div = "div" if scale == "raw" else (
        "case when max(div) over w - min(div) over w < 1e-12 then 0.0 else (div - min(div) over w) / (max(div) over w - min(div) over w) end"
    )
    g = lambda n: f"pow(v{n}.fit, {a}) * pow(v{n}.qual, {b})"
    return f"""{_V}, s as (select t.*, {g(1)} + {g(2)} + {g(3)} as g from t join v v1 on t.qid = v1.qid and t.p1 = v1.pos
      join v v2 on t.qid = v2.qid and t.p2 = v2.pos join v v3 on t.qid = v3.qid and t.p3 = v3.pos),
      f as (select *, round(g + {lam} * {div}, 9) as value from s window w as (partition by qid)),
      r as (select *, row_number() over (partition by qid order by value desc, p1, p2, p3) as rn from f)
      select qid, p1, p2, p3, round(div, 6) as div, round(value, 6) as value from r where rn = 1"""


_SCAN = f"""{_V}, s as (select t.*, v1.fit * v1.qual + v2.fit * v2.qual + v3.fit * v3.qual as g from t join v v1 on t.qid = v1.qid and t.p1 = v1.pos
  join v v2 on t.qid = v2.qid and t.p2 = v2.pos join v v3 on t.qid = v3.qid and t.p3 = v3.pos),
f as (select s.*, lam, round(round(g, 9) + lam * div, 9) as value from s cross join (select cast(unnest({LAMBDAS}) as double) as lam)),
r as (select *, row_number() over (partition by qid, lam order by value desc, p1, p2, p3) as rn from f),
b as (select * from r where rn = 1),
scan as (select b.lam, count(*) as n, round(avg(cast((b.p1, b.p2, b.p3) <> (z.p1, z.p2, z.p3) as double)), 6) as changed,
  round(avg(b.div), 6) as mean_div from b join b z on b.qid = z.qid and z.lam = 0 group by b.lam)"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_SHARE = "coalesce(len(list_filter(w, lambda x: x in ({}))) / nullif(len(w), 0), 0.0)"
_KW = {n: ", ".join(f"'{k}'" for k in ks) for n, ks in text.KEYWORDS.items()}
_FEAT = f"""with r as (select tid, {_WORDS} as w from (select distinct tid, text from candidates)),
f as (select tid, cast(len(w) as int) as n_words, {", ".join(f"{_SHARE.format(_KW[n])} as {n}" for n in text.KEYWORDS)} from r)"""
_NORM = r"lower(trim(regexp_replace({}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ' ', 'g')))"

SQL = {
    "q_f1_norm": f"select doc_id, md5({_NORM.format('text')}) as digest, length({_NORM.format('text')}) as n from documents",
    "q_f3_gold": f"""{WITH}, t as (select qid, source, solution, {_tail("solution")} as tail from asked)
      select qid, case when source = 'math' then {_boxed("solution")}
        when contains(solution, '####') then nullif(replace(trim(list_last(string_split(solution, '####'))), ',', ''), '') end as found from t""",
    "q_f4_last_boxed": f"""with t as (select distinct tid, text, {_tail("text")} as tail from candidates)
      select tid, {_boxed("text")} as pred from t""",
    "q_f10_tokenize": rf"""with r as (select doc_id, case when text is null then null else {_WORDS} end as w from documents)
      select doc_id, cast(len(w) as int) as n_words, cast(len(list_distinct(w)) as int) as n_distinct from r""",
    "q_f11_features": f"{_FEAT} select tid, n_words, {', '.join(f'round({n}, 9) as {n}' for n in text.KEYWORDS)} from f",
    "q_f12_rule_score": f"""{_FEAT} select tid, round({" + ".join(
        f"{w} * coalesce(({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0), 0)"
        for w, c in zip(text.WEIGHTS.values(), _FEATURES)
    )}, 6) as score from f""",
    "q_f21_repeat_share": """with l as (select gen_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) >= 12) as v
      from (select distinct gen_id, text from eval where text is not null))
      select gen_id, round(case when len(v) < 4 then 0.0 else 1 - len(list_distinct(v)) / len(v) end, 6) as share from l""",
    "q_w26_context_share": """with c as (select distinct tid, text from candidates where text is not null),
      l as (select tid, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from c),
      s as (select tid, cast(line as int) as line, sum(length(part)) over (w rows between 2 preceding and 1 preceding) as near,
        sum(length(part)) over (w rows between unbounded preceding and 1 preceding) as before from l window w as (partition by tid order by line))
      select tid, line, round(case when before > 0 then near / before else 1.0 end, 6) as share from s where line > 0""",
    "q_n1_judge_json": f"""{WITH} select tid, round(llm_score, 1) as score,
      case when length(tid) % 4 = 3 then 'regex_overall' else 'json' end as how from quals where llm_score is not null""",
    "q_m1_token_signals": rf"""with r as (select tid, list_transform({_WORDS}, lambda x: length(x)) as w from (select distinct tid, text from candidates)),
      s as (select tid, w, len(w) as n, list_sum(list_transform(w, lambda r: r / 10.0)) as u from r where len(w) > 0)
      select tid, round(list_sum(list_transform(w, lambda r: cast(least(r + 1, 100) as double))) / greatest(u, 1e-6), 6) as rsr,
        round(-u / n, 6) as grape,
        round(list_sum(list_transform(w, lambda r: 1 - 2 / (1.0 + r) + 1 / ((1.0 + r) * (1.0 + r)))) / n, 6) as brier,
        round(exp(u / n), 6) as perplexity from s""",
    "q_m4_pair_distances": f"{_V} select qid, i, j, round(d, 6) as d from d",
    "q_a15_distance_summary": f"""{_V}, k as (select case when li = lj then 'same' else 'different' end as kind, list_sort(list(d)) as v,
        avg(d) as m, stddev_pop(d) as s from d group by 1)
      select kind, len(v) as n, round(v[1], 4) as low, round(v[least(cast(floor(0.25 * len(v)) as int), len(v) - 1) + 1], 4) as p25,
        round(v[least(cast(floor(0.5 * len(v)) as int), len(v) - 1) + 1], 4) as p50,
        round(v[least(cast(floor(0.75 * len(v)) as int), len(v) - 1) + 1], 4) as p75,
        round(v[len(v)], 4) as high, round(m, 4) as mean, round(s, 4) as sd from k""",
    "q_w20_objective": _objective_sql(1, 1, 0.4),
    "q_w20_fit_only": _objective_sql(1, 0, 0.0),
    "q_w20_quality_only": _objective_sql(0, 1, 0.0),
    "q_w20_diversity_only": _objective_sql(0, 0, 1.0),
    "q_w22_scaled_diversity": _objective_sql(1, 1, 0.4, "minmax"),
    "q_t19_lambda_scan": f"{_SCAN} select * from scan",
    "q_t20_lambda_grid": f"""{_SCAN} select min(case when changed >= 0.1 then lam end) as at_10,
      min(case when changed >= 0.25 then lam end) as at_25, min(case when changed >= 0.5 then lam end) as at_50 from scan""",
    "q_j7_banned": f"""{WITH} select distinct qid from asked where question is null or {_NORM.format("question")}
      not in (select {_NORM.format("question")} from eval_items where question is not null)""",
    "q_j8_tasks": f"""{WITH}, e as (select q.qid, t.teacher, s.sample_idx, q.qid || '|' || t.teacher || '|' || s.sample_idx as tid
      from (select distinct qid from asked) q, (select unnest(['deepseek', 'llama70b', 'qwen72b']) as teacher) t,
        (select unnest(range(0, 3))::int as sample_idx) s)
      select tid, qid, teacher, sample_idx from e where tid not in (select tid from chains)""",
    "q_u2_shared_runs": "select seed from eval where tag = 'base' intersect select seed from eval where tag = 'fq.k3'",
    "q_u3_set_difference": f"""{WITH} select qid, 'questions' as only_in from (select qid from asked except select qid from chains)
      union all select qid, 'candidates' from (select qid from chains except select qid from asked)""",
    "q_x4_hashed_sample": """select item_id, subset from (select *, row_number() over (partition by subset order by sha256('42|' || item_id), item_id) as rn
      from (select distinct item_id, subset from eval_items where benchmark = 'bbh')) where rn <= 5""",
    "q_x3_allocated_sample": f"""{WITH}, r as (select distinct qid, concat_ws('-L', source, level) as stratum from asked),
      z as (select stratum, count(*) * 50 / sum(count(*)) over () as e from r group by stratum),
      f as (select stratum, floor(e) as q, e - floor(e) as part from z),
      a as (select stratum, q + case when row_number() over (order by round(part, 9) desc, stratum) <= 50 - sum(q) over () then 1 else 0 end as quota from f),
      o as (select *, row_number() over (partition by stratum order by sha256('42|' || qid), qid) as rn from r)
      select o.qid, o.stratum from o join a on o.stratum = a.stratum where rn <= quota""",
    "q_x5_group_sample": f"""{WITH}, z as (select qid, count(*) as c from chains group by qid),
      b as (select qid, coalesce(sum(c) over (order by sha256('42|' || qid), qid rows between unbounded preceding and 1 preceding), 0) as b from z)
      select tid, qid from chains where qid in (select qid from b where b < 300)""",
    "q_x6_equal_sample": f"""{WITH}, t as (select tid, teacher, row_number() over (partition by teacher order by sha256('42|' || tid), tid) as rn
      from chains where teacher is not null)
      select tid, teacher from t where rn <= greatest(1, 60 // (select count(distinct teacher) from t)) order by sha256('42|' || tid), tid limit 60""",
    "q_k6_fingerprint": f"{WITH} select count(*) as n, true as same from asked",
    "q_k8_packed": f"""{WITH} select coalesce(q.tid, f.tid) as tid, q.qual as quality_qual, q.llm_score as quality_llm_score,
      f.rsr as student_rsr, f.n_tokens as student_n_tokens from quals q full join fits f on q.tid = f.tid""",
    "q_k9_packed_generations": f"""{WITH}, g as (select *, row_number() over (partition by tag, seed, qid, sample order by gen_id) as k from gens)
      select coalesce(i.benchmark, 'no item') as of, count(*) as n from g left join (select distinct item_id, benchmark from eval_items) i
      on g.qid = i.item_id where k = 1 group by 1""",
    "q_s1_jsonl_round_trip": f"{WITH} select * from asked",
    "q_s14_budget": f"""{WITH}, d as (select cast(cast(ts as date) as varchar) as day, sum(completion_tokens) as tokens from chains where ts is not null group by 1)
      select *, sum(tokens) over (order by day) as upto from d""",
    "q_s14_stream_windows": "select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "q_s14_stream_compacted": f"{WITH} select tid, ts, rsr, n_tokens from fits",
    "q_f27_row_checks": f"""with r as (select *, count(*) over (partition by benchmark, {_NORM.format("question")}) as twins from (select distinct * from eval_items))
      select benchmark, count(*) as n, count(*) filter (where coalesce(trim(question), '') = '') as empty, count(*) filter (where gold is null) as no_gold,
        count(*) filter (where twins > 1) as twins, count(*) filter (where not regexp_matches(gold, '^-?\\d+$')) as not_whole,
        count(*) filter (where regexp_matches(gold, '^-?\\d+$') and try_cast(gold as bigint) not between 0 and 999) as out_of_range,
        count(*) filter (where regexp_matches(question, '[\\x00-\\x09\\x0B-\\x1F\\x7F]')) as control from r group by benchmark""",
}
