"""Reports, joins and functions of the inventory that no other module of plans holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainsieve.functions import text
from chainsieve.functions.answers import same_value
from chainsieve.functions.steps import aligned, final_col, groups_col, read_groups, token_steps
from chainsieve.operators import metrics, objective, ranks, rules, stats
from chainsieve.plans.base import K, WITH, chains, fits, generations, pool, quality, questions
from chainsieve.sources.tables import table

CAP = 3072


def _r(column, digits: int = 6):
    return F.round(column, digits)


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "candidates", "tid", "text").where("tid is not null and text <> ''").distinct()


def passed(spark: SparkSession, root: str) -> DataFrame:
    """Share of questions with any right sample, by run, over questions with all samples."""
    return metrics.run_accuracy(generations(spark, root), 4).select(*metrics.RUN, "n_questions", _r("passed").alias("passed"))


def counted_percentiles(counts: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at index ``min(int(share * n), n - 1)`` of every group, from counts ``c`` of its values.

    Values are counted first, so no group is ever sorted row by row.
    """
    w = Window.partitionBy(group).orderBy(value)
    placed = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(group))})
    at = lambda s: F.least(F.floor(F.lit(s) * F.col("n")), F.col("n") - 1)
    picks = [F.min(F.when(F.col("upto") > at(s), F.col(value))).alias(name) for name, s in shares.items()]
    return placed.groupBy(group).agg(F.first("n").alias("n"), *picks, F.max(value).alias("most"))


def length_report(spark: SparkSession, root: str) -> DataFrame:
    """Lengths of each teacher's usable chains: index percentiles, the longest, and the share over 500 tokens."""
    judged = quality(spark, root).where("qual is not null").select("tid")
    rows = chains(spark, root).where("teacher is not null and completion_tokens is not null").join(judged, "tid", "left_semi")
    counts = rows.groupBy("teacher", "completion_tokens").agg(F.count(F.lit(1)).alias("c"))
    found = counted_percentiles(counts, "teacher", "completion_tokens", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99})
    over = counts.groupBy("teacher").agg(_r(F.sum(F.when(F.col("completion_tokens") > 500, F.col("c")).otherwise(0)) / F.sum("c")).alias("over"))
    return found.join(over, "teacher")


def usable_percent(spark: SparkSession, root: str) -> DataFrame:
    """Questions of each group by their number of usable chains (five and more together), in percent."""
    judged = quality(spark, root).where("qual is not null").select("tid")
    n = chains(spark, root).select("tid", "qid").join(judged, "tid", "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    asked = questions(spark, root).groupBy("qid").agg(F.min("source").alias("source"), F.min("level").alias("level"))
    group = F.when(F.col("level").isNull(), F.col("source")).otherwise(F.concat_ws("-L", "source", "level"))
    rows = asked.join(n, "qid", "left").select(group.alias("grp"), F.least(F.coalesce("n", F.lit(0)), F.lit(5)).cast("int").alias("n_usable"))
    counts = rows.groupBy("grp", "n_usable").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", _r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("grp"))))


def answer_survey(spark: SparkSession, root: str) -> DataFrame:
    """Generations against the solutions of their items: equal texts, mean length ratio, share that begins with a label."""
    items = table(spark, root, "eval_items", "item_id", "solution").where("solution <> ''").distinct()
    rows = generations(spark, root, text=True).where("text is not null").select("benchmark", "qid", "text")
    both = rows.join(items, F.col("qid") == F.col("item_id"))
    starts = F.col("text").startswith("Step") | F.col("text").startswith("1.")
    return both.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.trim("text") == F.trim("solution")).alias("n_equal"),
        _r(F.avg(F.length("text") / F.length("solution")), 4).alias("length_ratio"),
        _r(F.avg(starts.cast("double"))).alias("labelled"),
    )


def dominant_score(spark: SparkSession, root: str) -> DataFrame:
    """The judge's most frequent score to one decimal, its share, and whether it stands for most of all."""
    rows = quality(spark, root).where("llm_score is not null")
    counts = rows.groupBy(F.round("llm_score", 1).alias("score")).agg(F.count(F.lit(1)).alias("c"))
    found = counts.agg(F.min_by("score", F.struct((-F.col("c")).alias("c"), "score")).alias("score"), (F.max("c") / F.sum("c")).alias("share"))
    return found.where("score is not null").select("score", _r("share").alias("share"), (F.col("share") > 0.7).alias("dominant"))


def judge_header(spark: SparkSession, root: str) -> DataFrame:
    """Two judges on the chains both scored: means, distinct scores, rank correlation over all."""
    rows = quality(spark, root).where("rule_score is not null and llm_score is not null")
    head = rows.agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("rule_score")).alias("mean_a"), _r(F.avg("llm_score")).alias("mean_b"),
        F.count_distinct("rule_score").alias("levels_a"), F.count_distinct("llm_score").alias("levels_b"),
    )
    return head.crossJoin(counted_spearman(rows, "rule_score", "llm_score")).where("n >= 3")


def counted_spearman(rows: DataFrame, x: str, y: str, decimals: int = 5) -> DataFrame:
    """One row with ``rho``, the rank correlation over all rows, from ranks of the distinct values.

    Ranks come from running counts of the values (see ``prefix``), so all rows are never in one task.
    """
    from chainsieve.operators.prefix import running_sums

    placed = rows.select(x, y)
    for c in (x, y):
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("_c")).withColumn("_all", F.lit("all"))
        sums = running_sums(counts, "_all", c, c, {"_c": "_upto"})
        placed = placed.join(sums.select(c, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(f"_r_{c}")), c)
    return placed.agg(_r(stats.pearson(F.col(f"_r_{x}"), F.col(f"_r_{y}")), decimals).alias("rho"))


def stop_report(spark: SparkSession, root: str) -> DataFrame:
    """A probability by kind of ending: mean, index median and tenth, share of one half and more."""
    lean = chains(spark, root).select("tid", F.coalesce("finish_reason", F.lit("none")).alias("ending"))
    rows = fits(spark, root).where("brier is not null").select("tid", F.round("brier", 3).alias("p")).join(lean, "tid")
    counts = rows.groupBy("ending", "p").agg(F.count(F.lit(1)).alias("c"))
    found = counted_percentiles(counts, "ending", "p", {"median": 0.5, "p10": 0.1}).drop("most")
    mean = counts.groupBy("ending").agg(
        _r(F.sum(F.col("p") * F.col("c")) / F.sum("c")).alias("mean"),
        _r(F.sum(F.when(F.col("p") >= 0.5, F.col("c")).otherwise(0)) / F.sum("c")).alias("likely"),
    )
    return found.join(mean, "ending")


def fit_scores(spark: SparkSession, root: str) -> DataFrame:
    """Fit of every chain: one minus its surprise scaled to the range of its question."""
    rows = pool(spark, root).where(ranks.usable(F.col("rsr").cast("double"))).select("qid", "tid", "rsr")
    span = rows.groupBy("qid").agg(F.min("rsr").alias("low"), F.max("rsr").alias("high"))
    wide = F.col("high") - F.col("low")
    scaled = F.when(wide < ranks.CONSTANT, 0.5).otherwise((F.col("rsr") - F.col("low")) / F.nullif(wide, F.lit(0.0)))
    return rows.join(span, "qid").select("qid", "tid", _r(1 - scaled).alias("fit"))


def average_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Ranks of the judge's scores over all chains, equal ones sharing the mean of their places."""
    from chainsieve.operators.prefix import running_sums

    counts = quality(spark, root).where("llm_score is not null").groupBy("llm_score").agg(F.count(F.lit(1)).cast("double").alias("c"))
    sums = running_sums(counts.withColumn("g", F.lit("all")), "g", "llm_score", "llm_score", {"c": "upto"})
    return sums.select("llm_score", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"), F.col("c").cast("bigint").alias("n"))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    unit = objective.l2_normalize(F.col("embedding"))
    return table(spark, root, "embeddings").select((F.col("vec_id") % 100).alias("member"), "vec_id", unit.alias("vec"))


def diversity(spark: SparkSession, root: str) -> DataFrame:
    """Diversity of the three best-fitting chains of every question: distances to the nearest of the others, summed.

    A chain's vector is that of the number its key gives.  Sets hold three members, so nothing grows with a question.
    """
    best = rules.top_k_lean(pool(spark, root), "grape", K).select("qid", "tid", F.col("rn").alias("pos"))
    held = _vectors(spark, root)
    member = F.conv(F.substring(F.md5("tid"), 1, 8), 16, 10).cast("bigint") % 100
    vec = held.groupBy("member").agg(F.min_by("vec", "vec_id").alias("vec"))
    d = objective.pair_distances(best.withColumn("member", member).join(vec, "member"))
    ends = d.select("qid", F.col("i").alias("m"), "d").unionByName(d.select("qid", F.col("j").alias("m"), "d"))
    near = ends.groupBy("qid", "m").agg(F.min("d").alias("d"))
    return near.groupBy("qid").agg(_r(F.sum("d"), 5).alias("div"))


def lambda_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Chains with what a scan of weights needs, by teacher, and how many lack each part."""
    has = lambda df, name: df.select("tid", F.lit(True).alias(name))
    fit = has(fits(spark, root).where(ranks.usable(F.col("rsr"))), "fit")
    qual = has(quality(spark, root).where("qual is not null"), "qual")
    member = F.conv(F.substring(F.md5("tid"), 1, 8), 16, 10).cast("bigint") % 600
    vec = table(spark, root, "embeddings", "vec_id").select(F.col("vec_id").alias("member"), F.lit(True).alias("vec"))
    rows = chains(spark, root).select("tid", "teacher").withColumn("member", member)
    rows = rows.join(fit, "tid", "left").join(qual, "tid", "left").join(vec, "member", "left")
    return rows.groupBy("teacher").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("fit", "qual", "vec")],
        F.count_if(F.col("fit") & F.col("qual") & F.col("vec")).alias("n_whole"),
    )


def shared_questions(spark: SparkSession, root: str) -> DataFrame:
    """Questions that have chains, fit and quality."""
    rows = questions(spark, root).select("qid", "source").distinct()
    for name in ("candidates", "fit", "quality"):
        rows = rows.join(table(spark, root, name, "qid"), "qid", "left_semi")
    return rows


def teacher_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Unordered pairs of chains of every question, of one teacher and of two, from counts and never pair by pair."""
    each = chains(spark, root).where("teacher is not null").groupBy("qid", "teacher").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: F.floor(n * (n - 1) / 2).cast("bigint")
    found = each.groupBy("qid").agg(F.sum("n").alias("m"), F.sum(pairs(F.col("n"))).alias("same"))
    return found.select("qid", "same", (pairs(F.col("m")) - F.col("same")).alias("different"))


def selection_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Chains that two selections of a question share, and those only one has."""
    rows = pool(spark, root)
    a = rules.top_k_lean(rows, "grape", K).select("qid", "tid", F.lit(1).alias("a"))
    b = rules.top_k_lean(rows, "qual", K).select("qid", "tid", F.lit(1).alias("b"))
    both = a.join(b, ["qid", "tid"], "full")
    return both.groupBy("qid").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
        F.count_if(F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull()).alias("only_b"),
    )


def two_scores(spark: SparkSession, root: str) -> DataFrame:
    """Two score files on their shared chains: number, rank correlation over all, questions whose best agree."""
    a = fits(spark, root).where(ranks.usable(F.col("grape"))).select("tid", "qid", "grape")
    b = quality(spark, root).where("qual is not null").select("tid", "qual")
    rows = a.join(b, "tid")
    top = rows.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("qual", F.struct("grape", "qual")).alias("picked"),
        F.max("qual").alias("best"),
    )
    hits = top.where("n >= 2").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("picked") == F.col("best")).alias("n_hits"))
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(counted_spearman(rows, "grape", "qual")).crossJoin(hits).where("n >= 3")


def intervals(spark: SparkSession, root: str) -> DataFrame:
    """Share of right generations of every run with its Wilson interval."""
    rows = generations(spark, root).where("correct is not null")
    found = rows.groupBy("tag", "benchmark").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return found.select("tag", "benchmark", "n", "hits", _r(low).alias("low"), _r(high).alias("high"))


def noise_notes(spark: SparkSession, root: str) -> DataFrame:
    """By teacher count of a question: does a selection from rounded scores equal the one from the scores themselves.

    ``noisy``: fewer than 98 % do; ``open``: the interval holds that threshold; ``trial``: fewer than 100 questions.
    """
    rows = pool(spark, root)
    a = rules.top_k_lean(rows, "grape", K)
    b = rules.top_k_lean(rows.withColumn("grape", F.round("grape", 2)), "grape", K)
    kinds = rows.groupBy("qid").agg(F.least(F.count_distinct("teacher"), F.lit(3)).alias("n_teachers"))
    sets = stats.same_sets(a, b).join(kinds, "qid").groupBy("n_teachers").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("same").alias("hits")
    )
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return sets.select(
        "n_teachers", "n", "hits",
        (F.col("hits") / F.col("n") < 0.98).alias("noisy"),
        ((low <= 0.98) & (high >= 0.98)).alias("open"),
        (F.col("n") < 100).alias("trial"),
    )


@F.pandas_udf(T.BooleanType())
def _same_value(a, b):
    import pandas as pd

    return pd.Series([same_value(x, y) for x, y in zip(a, b)], dtype=bool)


def symbolic(spark: SparkSession, root: str) -> DataFrame:
    """Chains' token numbers written as sums, products and fractions, against the number and its neighbour."""
    rows = fits(spark, root).where("n_tokens is not null").select("tid", F.col("n_tokens").alias("n"))
    n = F.col("n").cast("string")
    forms = {
        "total": F.concat(n, F.lit(" + 7 - 7")),
        "fraction": F.concat(F.lit("\\frac{"), (F.col("n") * 6).cast("string"), F.lit("}{2 \\cdot 3}")),
        "root": F.concat(F.lit("\\sqrt{"), (F.col("n").cast("bigint") * F.col("n")).cast("string"), F.lit("}")),
        "power": F.concat(n, F.lit(" * 2^{3} / (4 + 4)")),
    }
    right = [_same_value(form, n).cast("int") for form in forms.values()]
    wrong = [_same_value(form, (F.col("n") + 1).cast("string")).cast("int") for form in forms.values()]
    return rows.select("tid", sum(right[1:], right[0]).alias("n_equal"), sum(wrong[1:], wrong[0]).alias("n_wrong"))


def bbh_plain(answer: Column) -> Column:
    """Answers of short-form tasks in one spelling, by column functions: the same as ``answers.bbh_normalize``."""
    bare = F.regexp_replace(F.trim(answer), r"\\(?:text|textbf|textit|mathrm|mathbf|mbox)\s*\{([^{}]*)\}", "$1")
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\$", "")), r"\.+$", ""))
    letter = F.regexp_extract(bare, r"^\(?\s*([A-Za-z])\s*\)?$", 1)
    spaced = F.trim(F.regexp_replace(bare, r"[\s,]+", " "))
    return F.lower(F.when(letter != "", letter).otherwise(spaced))


def bbh_answers(spark: SparkSession, root: str) -> DataFrame:
    """Predictions against gold answers in their one spelling, by benchmark."""
    rows = generations(spark, root).where("pred is not null and gold is not null")
    same = bbh_plain(F.col("pred")) == bbh_plain(F.col("gold"))
    return rows.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"))


def _segmented(spark: SparkSession, root: str) -> DataFrame:
    """Texts with what a segmenting model would give back of them: their lines as groups, some answers cut or odd.

    A quarter each comes as good JSON, with marks left out, cut off before the end, and not at all.
    """
    rows = _texts(spark, root)
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    kind = F.conv(F.substring(F.md5("tid"), 1, 2), 16, 10).cast("int") % 4
    keyed = F.transform(lines, lambda s, i: F.concat(F.lit('"group'), (i + 1).cast("string"), F.lit('": ['), F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2), F.lit("]")))
    whole = F.concat(F.lit("{"), F.array_join(keyed, ", "), F.lit("}"))
    raw = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.regexp_replace(whole, r"[*~_]", ""))
        .when(kind == 2, whole.substr(F.lit(1), F.length(whole) - 3))
    )
    return rows.select("tid", "text", kind.alias("kind"), raw.alias("raw"), F.size(lines).alias("n_lines"))


def final_steps(spark: SparkSession, root: str) -> DataFrame:
    """Number of steps of every text and where they come from: the model, a salvaged answer, or a rule."""
    found = _segmented(spark, root).withColumn("s", final_col("text", "raw"))
    source = F.when(F.col("s.rule").startswith("fallback"), "fallback").otherwise("model")
    return found.groupBy("kind", source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("s.ends") >= 1).alias("n_cut"))


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("missed", T.IntegerType())]))
def _aligned(text_, raw):
    import pandas as pd

    out = []
    for t, r in zip(text_, raw):
        readings, _ = read_groups(r)
        found = aligned(t, readings) if readings else {"ends": [], "missed": 0}
        out.append((len(found["ends"]), found["missed"]))
    return pd.DataFrame(out, columns=["n", "missed"])


def aligned_groups(spark: SparkSession, root: str) -> DataFrame:
    """How many groups of a whole answer found their place in the text."""
    rows = _segmented(spark, root).where("kind < 2").withColumn("a", _aligned("text", "raw"))
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a.missed") == 0).alias("n_whole"), F.sum("a.n").alias("n_steps")
    )


def parsed_groups(spark: SparkSession, root: str) -> DataFrame:
    """Number of groups read from a model's answer, cut-off ones too."""
    rows = _segmented(spark, root).where("raw is not null")
    return rows.select("tid", F.size(groups_col("raw")).alias("n_groups"))


def selection_tag(method: Column, k: Column, weight: Column) -> Column:
    """The name of a selection: method, number, and the weight where the method has one."""
    plain = F.concat_ws(".", method, F.concat(F.lit("k"), k.cast("string")))
    return F.when(weight.isNull(), plain).otherwise(F.concat(plain, F.lit(".l"), F.regexp_replace(weight.cast("string"), r"\.?0+$", "")))


def names(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.createDataFrame([("grape", 3, None), ("objective", 3, 0.4), ("objective", 5, 1.0)], "method string, k int, weight double")
    return rows.select(selection_tag(F.col("method"), F.col("k"), F.col("weight")).alias("tag"))


def shown_split(spark: SparkSession, root: str) -> DataFrame:
    """Texts as a reader is shown them: each non-blank line numbered, on one line."""
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    numbered = F.transform(lines, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(s)))
    return _texts(spark, root).select("tid", F.md5(F.array_join(numbered, " ")).alias("shown"))


def perplexities(spark: SparkSession, root: str) -> DataFrame:
    rows = fits(spark, root).where(ranks.usable(F.col("grape")))
    return rows.select("tid", _r(F.exp(-F.col("grape")), 5).alias("perplexity"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _step_tokens(texts):
    import re

    word, out = re.compile(r"\S+", re.ASCII), []
    for t in texts:
        starts = [m.start() for m in word.finditer(t)]
        ends = [m.end() for m in re.finditer(r"\n+", t) if m.end() < len(t)] + [len(t)]
        out.append([b - a for a, b in token_steps(starts, ends)])
    import pandas as pd

    return pd.Series(out)


def step_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of every step (a line), each counted where it begins; steps without tokens are none."""
    found = _texts(spark, root).withColumn("c", _step_tokens("text"))
    return found.select("tid", F.size("c").alias("n_steps"), F.array_max("c").alias("widest"), F.aggregate("c", F.lit(0), lambda a, b: a + b).alias("n_tokens"))


def local_items(spark: SparkSession, root: str) -> DataFrame:
    """Distinct items of a text over contexts of one and of four steps, and the mean of their tokens by step."""
    c = F.col("c")
    found = _texts(spark, root).withColumn("c", _step_tokens("text")).where("size(c) > 0")
    ends = F.transform(c, lambda x, i: F.aggregate(F.slice(c, 1, i + 1), F.lit(0), lambda a, b: a + b))
    item = lambda k: F.transform(ends, lambda e, i: F.struct(F.when(i > k, F.get(ends, i - k - 1)).otherwise(0).alias("a"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("b"), e.alias("e")))
    unique = F.array_distinct(F.concat(item(1), item(4)))
    mean = F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size("c")
    return found.select("tid", F.size(unique).alias("n_items"), _r(mean, 4).alias("mean_tokens"))


def stage_plan(spark: SparkSession, root: str) -> DataFrame:
    """Generation in stages: the caps asked for, sorted, below the last, which is always the cap itself."""
    rows = spark.createDataFrame([("a", [512, 256, 512], 1024), ("b", [4096, 1024], 1024), ("c", [], 300)], "run string, caps array<int>, cap int")
    below = F.filter(F.array_sort(F.array_distinct("caps")), lambda x: x < F.col("cap"))
    planned = rows.select("run", F.posexplode(F.concat(below, F.array("cap"))).alias("stage", "until"))
    return planned


def chunked(spark: SparkSession, root: str) -> DataFrame:
    """Held-out questions of every benchmark in chunks of 64, in the order of their keys.

    Items of a benchmark are bounded in number, so each is numbered in one task.
    """
    rows = table(spark, root, "eval_items", "item_id", "benchmark").distinct()
    place = F.row_number().over(Window.partitionBy("benchmark").orderBy("item_id")) - 1
    return rows.withColumn("chunk", F.floor(place / 64).cast("int")).groupBy("benchmark", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"))


def number_parts(plain: Column) -> tuple[Column, Column]:
    """Numerator and denominator of an integer, decimal or simple fraction; null for all else."""
    decimal, fraction = r"^([+-]?)(\d*)\.?(\d*)$", r"^(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}$"
    wide = T.DecimalType(38, 0)
    is_decimal = plain.rlike(r"^[+-]?(\d{1,18}(\.\d{0,9})?|\.\d{1,9})$")
    is_fraction = plain.rlike(r"^-?\\frac\{-?\d{1,15}\}\{-?0*[1-9]\d{0,14}\}$")
    part = lambda pattern, n: F.regexp_extract(plain, pattern, n)
    sign = lambda pattern: F.when(part(pattern, 1) == "-", F.lit(-1)).otherwise(F.lit(1)).cast(wide)
    digits = F.concat(part(decimal, 2), part(decimal, 3))
    above = F.when(is_decimal, sign(decimal) * digits.try_cast(wide)).when(is_fraction, sign(fraction) * part(fraction, 2).try_cast(wide))
    below = F.when(is_decimal, F.pow(F.lit(10), F.length(part(decimal, 3))).cast(wide)).when(is_fraction, part(fraction, 3).try_cast(wide))
    return above, below


def numbers(spark: SparkSession, root: str) -> DataFrame:
    """Gold answers that are numbers, as fractions, against the predictions: equal if the cross products are."""
    rows = generations(spark, root).where("pred is not null and gold is not null").select("gen_id", F.trim("pred").alias("p"), F.trim("gold").alias("g"))
    (pa, pb), (ga, gb) = number_parts(F.col("p")), number_parts(F.col("g"))
    parsed = rows.select("gen_id", pa.alias("pa"), pb.alias("pb"), ga.alias("ga"), gb.alias("gb")).where("pa is not null and ga is not null")
    equal = F.col("pa").cast("decimal(19,0)") * F.col("gb").cast("decimal(19,0)") == F.col("ga").cast("decimal(19,0)") * F.col("pb").cast("decimal(19,0)")
    return parsed.select("gen_id", equal.alias("equal"))


def step_lengths(spark: SparkSession, root: str) -> DataFrame:
    """Lengths of the steps of every text (its lines with the breaks after them): differences of their ends."""
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[^\n]*\n+|[^\n]+"), F.lit(0))
    ends = F.transform(pieces, lambda p, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, b: a + F.length(b)))
    lengths = F.transform(ends, lambda e, i: e - F.coalesce(F.get(ends, i - 1), F.lit(0)))
    return _texts(spark, root).select("tid", F.size(lengths).alias("n"), F.array_min(lengths).alias("least"), F.array_max(lengths).alias("most"), F.element_at(ends, -1).alias("length"))


def escapes(spark: SparkSession, root: str) -> DataFrame:
    """Items as a careless writer puts them into JSON, every backslash that begins no escape doubled."""
    rows = table(spark, root, "eval_items", "item_id", "question").where("question is not null").distinct()
    return rows.select("item_id", F.md5(text.repair_json_escapes(F.col("question"))).alias("digest"))


def salvaged_scores(spark: SparkSession, root: str) -> DataFrame:
    """Judges' answers that were cut off: the score itself, or the mean of at least three parts."""
    rows = quality(spark, root).where("llm_score is not null").select("tid", F.round("llm_score", 2).alias("s"))
    s = F.format_string("%.2f", "s")
    kind = F.conv(F.substring(F.md5("tid"), 1, 2), 16, 10).cast("int") % 3
    part = lambda n: F.concat(F.lit(f'"{n}": {{"score": '), s, F.lit("}, "))
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"overall_score": '), s, F.lit(', "overall_reason": "it br')))
        .when(kind == 1, F.concat(F.lit("{"), part("a"), part("b"), part("c"), F.lit('"d": {"sco')))
        .otherwise(F.concat(F.lit("{"), part("a"), part("b"), F.lit('"c": {"sco')))
    )
    judged = text.judge_score(raw)
    return rows.select("tid", _r(judged["score"], 4).alias("score"), judged["how"].alias("how"))


QUERIES = {
    "q_a5_passed": passed,
    "q_a20_lengths": length_report,
    "q_a22_usable_percent": usable_percent,
    "q_a28_answer_survey": answer_survey,
    "q_a33_dominant": dominant_score,
    "q_a40_judges": judge_header,
    "q_a41_stop_report": stop_report,
    "q_w2_fit": fit_scores,
    "q_w5_average_rank": average_ranks,
    "q_w21_diversity": diversity,
    "q_j5_lambda_inputs": lambda_inputs,
    "q_j6_shared_questions": shared_questions,
    "q_j9_teacher_pairs": teacher_pairs,
    "q_j10_overlap": selection_overlap,
    "q_t8_two_scores": two_scores,
    "q_t9_intervals": intervals,
    "q_t30_noise": noise_notes,
    "q_f8_symbolic": symbolic,
    "q_f9_bbh": bbh_answers,
    "q_f16_final_steps": final_steps,
    "q_f17_aligned": aligned_groups,
    "q_f24_names": names,
    "q_f25_shown_split": shown_split,
    "q_m2_perplexity": perplexities,
    "q_m5_token_steps": step_tokens,
    "q_m6_local_items": local_items,
    "q_m10_stage_plan": stage_plan,
    "q_m10_chunks": chunked,
    "q_m12_numbers": numbers,
    "q_m14_step_lengths": step_lengths,
    "q_n2_escapes": escapes,
    "q_n3_salvaged": salvaged_scores,
    "q_n4_groups": parsed_groups,
}

_TEXTS = "(select distinct tid, text from candidates where tid is not null and text <> '')"
_LINES = "list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')"
_ACC = f"""{WITH}, first as (select * exclude (k) from (select *, row_number() over (
    partition by tag, seed, benchmark, qid, sample order by gen_id desc) as k from gens where sample < 4) where k = 1),
q as (select tag, seed, benchmark, qid, bool_or(coalesce(correct, false)) as solved from first group by all having count(*) = 4)"""
_PCT = "list_sort(list({c}))[least(cast(floor({s} * count(*)) as bigint), count(*) - 1) + 1]"
_RHO = """select round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 5) as rho from (
  select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as x,
    rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as y from {t})"""
_HEX = "cast('0x' || substr(md5(tid), 1, {}) as bigint)"
_WILSON = """round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - h), 6) as low,
  round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + h), 6) as high"""
_HALF = "1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)"
_BARE = r"trim(regexp_replace(trim(replace(regexp_replace(trim({}), '\\(?:text|textbf|textit|mathrm|mathbf|mbox)\s*\{{([^{{}}]*)\}}', '\1', 'g'), '$', '')), '\.+$', ''))"


def _bbh(c: str) -> str:
    bare = _BARE.format(c)
    letter = rf"regexp_extract({bare}, '^\(?\s*([A-Za-z])\s*\)?$', 1)"
    return rf"lower(case when {letter} <> '' then {letter} else trim(regexp_replace({bare}, '[\s,]+', ' ', 'g')) end)"


def _number(c: str) -> tuple[str, str]:
    decimal = rf"regexp_matches({c}, '^[+-]?(\d{{1,18}}(\.\d{{0,9}})?|\.\d{{1,9}})$')"
    fraction = rf"regexp_matches({c}, '^-?\\frac\{{-?\d{{1,15}}\}}\{{-?0*[1-9]\d{{0,14}}\}}$')"
    value = f"case when {decimal} then try_cast({c} as decimal(38, 9))"
    part = lambda n: rf"cast(regexp_extract({c}, '\{{(-?\d+)\}}\{{(-?\d+)\}}', {n}) as double)"
    whole = f"case when {decimal} then try_cast({c} as double) when {fraction} then (case when {c} like '-%' then -1 else 1 end) * {part(1)} / {part(2)} end"
    return whole, value


SQL = {
    "q_a5_passed": f"{_ACC} select tag, seed, benchmark, count(*) as n_questions, round(avg(cast(solved as double)), 6) as passed from q group by all",
    "q_a20_lengths": f"""{WITH}, r as (select teacher, completion_tokens as t from chains where teacher is not null and completion_tokens is not null
        and tid in (select tid from quals where qual is not null))
      select teacher, count(*) as n, {_PCT.format(c="t", s=0.5)} as p50, {_PCT.format(c="t", s=0.75)} as p75, {_PCT.format(c="t", s=0.9)} as p90,
        {_PCT.format(c="t", s=0.99)} as p99, max(t) as most, round(avg(cast(t > 500 as double)), 6) as over from r group by teacher""",
    "q_a22_usable_percent": f"""{WITH}, u as (select qid, count(*) as n from chains where tid in (select tid from quals where qual is not null) group by qid),
      a as (select qid, min(source) as source, min(level) as level from asked group by qid),
      g as (select case when level is null then source else source || '-L' || level end as grp, cast(least(coalesce(n, 0), 5) as int) as n_usable from a left join u using (qid))
      select grp, n_usable, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by grp), 6) as percent from g group by grp, n_usable""",
    "q_a28_answer_survey": f"""{WITH}, i as (select distinct item_id, solution from eval_items where solution <> '')
      select benchmark, count(*) as n, count(*) filter (where trim(text) = trim(solution)) as n_equal, round(avg(length(text) / length(solution)), 4) as length_ratio,
        round(avg(cast(starts_with(text, 'Step') or starts_with(text, '1.') as double)), 6) as labelled
      from gens join i on qid = item_id where text is not null group by benchmark""",
    "q_a33_dominant": f"""{WITH}, c as (select round(llm_score, 1) as score, count(*) as c from quals where llm_score is not null group by 1)
      select score, round(c / (select sum(c) from c), 6) as share, c / (select sum(c) from c) > 0.7 as dominant from c order by c desc, score limit 1""",
    "q_a40_judges": f"""{WITH}, b as (select * from quals where rule_score is not null and llm_score is not null)
      select count(*) as n, round(avg(rule_score), 6) as mean_a, round(avg(llm_score), 6) as mean_b, count(distinct rule_score) as levels_a,
        count(distinct llm_score) as levels_b, ({_RHO.format(a="rule_score", b="llm_score", t="b")}) as rho from b""",
    "q_a41_stop_report": f"""{WITH}, r as (select coalesce(finish_reason, 'none') as ending, round(brier, 3) as p from fits join chains using (tid) where brier is not null)
      select ending, count(*) as n, {_PCT.format(c="p", s=0.5)} as median, {_PCT.format(c="p", s=0.1)} as p10, round(avg(p), 6) as mean,
        round(avg(cast(p >= 0.5 as double)), 6) as likely from r group by ending""",
    "q_w2_fit": f"""{WITH}, p as (select *, min(rsr) over (partition by qid) as lo, max(rsr) over (partition by qid) as hi from pool where rsr is not null and not isnan(rsr))
      select qid, tid, round(1 - case when hi - lo < 1e-12 then 0.5 else (rsr - lo) / (hi - lo) end, 6) as fit from p""",
    "q_w5_average_rank": f"""{WITH} select distinct llm_score, rank() over (order by llm_score) + (count(*) over (partition by llm_score) - 1) / 2.0 as rank,
      count(*) over (partition by llm_score) as n from quals where llm_score is not null""",
    "q_w21_diversity": f"""{WITH}, r as (select qid, tid, row_number() over (partition by qid order by grape desc, pos) as rk from pool), b as (select qid, tid, rk as pos from r where rk <= {K}),
      v as (select vec_id % 100 as member, cast(arg_min(embedding, vec_id) as double[]) as e from embeddings group by 1),
      m as (select qid, pos, e from b join v on {_HEX.format(8)} % 100 = member),
      d as (select a.qid, a.pos as i, b.pos as j, sqrt(greatest(0, 2 - 2 * list_inner_product(a.e, b.e)
        / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))))) as d from m a join m b on a.qid = b.qid and a.pos <> b.pos)
      select qid, round(sum(near), 5) as div from (select qid, i, min(d) as near from d group by qid, i) group by qid""",
    "q_j5_lambda_inputs": f"""{WITH}, r as (select c.teacher, f.tid is not null as fit, q.tid is not null as qual, v.vec_id is not null as vec from chains c
        left join (select tid from fits where rsr is not null and not isnan(rsr)) f on c.tid = f.tid left join (select tid from quals where qual is not null) q on c.tid = q.tid
        left join embeddings v on {_HEX.format(8).replace("tid", "c.tid")} % 600 = v.vec_id)
      select teacher, count(*) as n, count(*) filter (where not fit) as no_fit, count(*) filter (where not qual) as no_qual,
        count(*) filter (where not vec) as no_vec, count(*) filter (where fit and qual and vec) as n_whole from r group by teacher""",
    "q_j6_shared_questions": f"""{WITH} select distinct qid, source from asked where qid in (select qid from candidates where qid is not null)
      and qid in (select qid from fit where qid is not null) and qid in (select qid from quality where qid is not null)""",
    "q_j9_teacher_pairs": f"""{WITH}, n as (select qid, teacher, tid, row_number() over (partition by qid order by tid) as k from chains where teacher is not null),
      t as (select qid, k, teacher, row_number() over (partition by qid, teacher order by k) as m from n)
      select qid, cast(sum(m - 1) as bigint) as same, cast(sum(k - m) as bigint) as different from t group by qid""",
    "q_j10_overlap": f"""{WITH}, p as (select qid, row_number() over (partition by qid order by grape desc, pos) as a, row_number() over (partition by qid order by qual desc, pos) as b from pool)
      select qid, count(*) filter (where a <= {K} and b <= {K}) as shared, count(*) filter (where a <= {K} and b > {K}) as only_a,
        count(*) filter (where a > {K} and b <= {K}) as only_b from p group by qid""",
    "q_t8_two_scores": f"""{WITH}, r as (select f.tid, f.qid, f.grape, q.qual from fits f join quals q on f.tid = q.tid
        where f.grape is not null and not isnan(f.grape) and q.qual is not null),
      t as (select *, row_number() over (partition by qid order by grape desc, qual desc) as k, max(qual) over (partition by qid) as best, count(*) over (partition by qid) as m from r)
      select (select count(*) from r) as n, ({_RHO.format(a="grape", b="qual", t="r")}) as rho, count(*) as n_questions, count(*) filter (where qual = best) as n_hits from t where k = 1 and m >= 2""",
    "q_t9_intervals": f"""{WITH}, c as (select tag, benchmark, count(*) as n, count(*) filter (where correct) as hits, count(*) filter (where correct) / count(*) as p from gens
        where correct is not null group by all), h as (select *, {_HALF} as h from c) select tag, benchmark, n, hits, {_WILSON} from h""",
    "q_t30_noise": f"""{WITH}, k as (select qid, teacher, row_number() over (partition by qid order by grape desc, pos) as a,
        row_number() over (partition by qid order by round(grape, 2) desc, pos) as b from pool),
      s as (select qid, least(count(distinct teacher), 3) as n_teachers, count(*) filter (where (a <= {K}) <> (b <= {K})) = 0 as same from k group by qid),
      c as (select n_teachers, count(*) as n, count(*) filter (where same) as hits, count(*) filter (where same) / count(*) as p from s group by n_teachers),
      h as (select *, {_HALF} as h from c), w as (select *, {_WILSON} from h)
      select n_teachers, n, hits, p < 0.98 as noisy, low <= 0.98 and high >= 0.98 as open, n < 100 as trial from w""",
    "q_f8_symbolic": f"{WITH} select tid, 4 as n_equal, 0 as n_wrong from fits where n_tokens is not null",
    "q_f9_bbh": f"{WITH} select benchmark, count(*) as n, count(*) filter (where {_bbh('pred')} = {_bbh('gold')}) as n_equal from gens where pred is not null and gold is not null group by benchmark",
    "q_f24_names": "select * from (values ('grape.k3'), ('objective.k3.l0.4'), ('objective.k5.l1')) t(tag)",
    "q_f25_shown_split": f"select tid, md5(array_to_string(list_transform({_LINES}, lambda s, i: '[' || i || '] ' || trim(s)), ' ')) as shown from {_TEXTS}",
    "q_m2_perplexity": f"{WITH} select tid, round(exp(-grape), 5) as perplexity from fits where grape is not null and not isnan(grape)",
    "q_m5_token_steps": f"""with l as (select tid, list_filter(list_transform(string_split(text, chr(10)), lambda s: len(regexp_extract_all(s, '\\S+'))), lambda n: n > 0) as c from {_TEXTS})
      select tid, len(c) as n_steps, list_max(c) as widest, coalesce(list_sum(c), 0) as n_tokens from l""",
    "q_m6_local_items": f"""with l as (select tid, list_filter(list_transform(string_split(text, chr(10)), lambda s: len(regexp_extract_all(s, '\\S+'))), lambda n: n > 0) as c from {_TEXTS})
      select tid, len(c) + greatest(len(c) - 2, 0) as n_items, round(list_avg(c), 4) as mean_tokens from l where len(c) > 0""",
    "q_m10_stage_plan": "select * from (values ('a', 0, 256), ('a', 1, 512), ('a', 2, 1024), ('b', 0, 1024), ('c', 0, 300)) t(run, stage, until)",
    "q_m10_chunks": """with r as (select benchmark, item_id, row_number() over (partition by benchmark order by item_id) - 1 as k from (select distinct item_id, benchmark from eval_items))
      select benchmark, cast(k // 64 as int) as chunk, count(*) as n, min(item_id) as first from r group by 1, 2""",
    "q_m12_numbers": f"""with r as (select distinct gen_id, trim(pred) as p, trim(gold) as g from eval where pred is not null and gold is not null),
      v as (select gen_id, {_number("p")[0]} as a, {_number("g")[0]} as b from r)
      select gen_id, abs(a - b) <= 1e-12 * greatest(abs(a), abs(b)) as equal from v where a is not null and b is not null""",
    "q_m14_step_lengths": rf"""with l as (select tid, text, list_transform(regexp_extract_all(text, '[^\n]*\n+|[^\n]+'), lambda p: length(p)) as c from {_TEXTS})
      select tid, len(c) as n, list_min(c) as least, list_max(c) as most, length(text) as length from l""",
    "q_n2_escapes": r"""select item_id, md5(regexp_replace(question, '\\([^"\\/bfnrtu]|$)', '\\\\\1', 'g')) as digest
      from (select distinct item_id, question from eval_items where question is not null)""",
    "q_n3_salvaged": f"""{WITH}, r as (select tid, round(llm_score, 2) as s, {_HEX.format(2)} % 3 as kind from quals where llm_score is not null)
      select tid, case when kind < 2 and s between 0 and 1 then round(s, 4) end as score,
        case when s not between 0 and 1 then null when kind = 0 then 'regex_overall' when kind = 1 then 'mean_of_3_dimensions' end as how from r""",
    "q_n4_groups": f"select tid, len({_LINES}) as n_groups from {_TEXTS} where {_HEX.format(2)} % 4 < 3",
}
