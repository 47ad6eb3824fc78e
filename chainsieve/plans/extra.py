"""Run discovery, gates, step audits, batching and set comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainsieve.functions import batching, text
from chainsieve.functions.answers import boxed_spans as spans_of
from chainsieve.functions.steps import covers, place_of, rule_ends, tidied
from chainsieve.operators import metrics, objective, rules, stats
from chainsieve.operators.prefix import running_sums
from chainsieve.plans.base import K, WITH, chains, fits, generations, pool, questions
from chainsieve.plans.textual import _V, _vectors
from chainsieve.session import checkpoint_dir
from chainsieve.sources import files
from chainsieve.sources.tables import table


def _r(column, digits: int = 6):
    return F.round(column, digits)


def find_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs found as folders ``tag=.../seed=...``: partition columns come from the paths."""
    folder = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    generations(spark, root).select("tag", "seed", "gen_id").write.partitionBy("tag", "seed").parquet(folder)
    return spark.read.parquet(folder).groupBy("tag", "seed").agg(F.count(F.lit(1)).alias("n"))


def shards(spark: SparkSession, root: str) -> DataFrame:
    """Chains written as one file group a teacher and read back through a pattern."""
    folder = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = chains(spark, root).where("teacher is not null").select("tid", "teacher")
    rows.write.partitionBy("teacher").json(folder)
    found = files.read_jsonl(spark, f"{folder}/*/*.json", "tid string")
    return found.groupBy(F.regexp_extract("tid", r"\|([^|]*)\|\d+$", 1).alias("teacher")).agg(F.count(F.lit(1)).alias("n"))


def messages(spark: SparkSession, root: str) -> DataFrame:
    """Chat logs whose messages are a list or the text of one, read with either schema."""
    turn = "array<struct<role: string, content: string>>"
    rows = questions(spark, root).where("question is not null").select("qid", "question")
    log = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))))
    odd = F.length("qid") % 2 == 0
    raw = F.when(odd, F.to_json(F.struct(log.alias("messages")))).otherwise(F.concat(F.lit('{"messages": '), log, F.lit("}")))
    as_list = F.from_json(raw, f"messages {turn}")["messages"]
    as_text = F.from_json(F.get_json_object(raw, "$.messages"), turn)
    found = F.coalesce(as_list, as_text)
    return rows.select("qid", F.md5(F.element_at(found, 1)["content"]).alias("digest"))


def version_gate(spark: SparkSession, root: str) -> DataFrame:
    """Fit rows whose signals are of an older version lose the signals that changed since."""
    rows = fits(spark, root)
    old = F.coalesce(F.col("signals_version") < 3, F.lit(True))
    return rows.select("tid", F.when(~old, F.col("local_nat")).alias("local_nat"), old.alias("dropped"))


def stale(spark: SparkSession, root: str) -> DataFrame:
    """Texts whose stored fingerprint no longer holds: those of cut chains were stored before the cut."""
    rows = table(spark, root, "candidates", "tid", "text", "finish_reason").distinct().where("text is not null")
    whole = F.when(F.col("finish_reason").eqNullSafe("length"), F.concat("text", F.lit("..."))).otherwise(F.col("text"))
    stored = rows.select("tid", "text", F.md5(whole).alias("stored"))
    return stored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.md5("text") != F.col("stored")).alias("changed"))


def clipped(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "quality", "tid", "rule_score").distinct().where("rule_score is not null")
    return rows.select("tid", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("rule_score"))).alias("score"))


def boxed_spans(spark: SparkSession, root: str) -> DataFrame:
    """All boxes of every chain and what kind of ending follows the last one."""
    rows = table(spark, root, "candidates", "tid", "text").distinct().where("text is not null")

    def run(batches):
        import pandas as pd

        for frame in batches:
            spans = [spans_of(t) for t in frame["text"]]
            tails = [t[s[-1][1] :] if s else t for t, s in zip(frame["text"], spans)]
            yield pd.DataFrame(
                {
                    "tid": frame["tid"],
                    "n_boxes": [len(s) for s in spans],
                    "words_follow": [sum(c.isalpha() for c in t) >= 2 for t in tails],
                }
            )

    return rows.mapInPandas(run, "tid string, n_boxes int, words_follow boolean")


def step_audit(spark: SparkSession, root: str) -> DataFrame:
    """Where the ends by sentences lie: at line starts, after list markers or within lines."""
    rows = table(spark, root, "candidates", "tid", "text").distinct().where("text is not null and text <> ''")

    def run(batches):
        import pandas as pd

        for frame in batches:
            kinds = [place_of(t, e) for t in frame["text"] for e in rule_ends(t, "sentence")[:-1]]
            yield pd.DataFrame({"kind": kinds})

    return rows.mapInPandas(run, "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def tidy_steps(spark: SparkSession, root: str) -> DataFrame:
    """Sentence steps after cuts were moved before markers and blanks."""
    rows = table(spark, root, "candidates", "tid", "text").distinct().where("text is not null and text <> ''")

    def run(batches):
        import pandas as pd

        for frame in batches:
            ends = [tidied(t, rule_ends(t, "sentence")) for t in frame["text"]]
            ok = [covers(e, len(t)) for e, t in zip(ends, frame["text"])]
            yield pd.DataFrame({"tid": frame["tid"], "n_steps": [len(e) for e in ends], "valid": ok})

    return rows.mapInPandas(run, "tid string, n_steps int, valid boolean")


def listed(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "candidates", "tid", "text").distinct()
    found = batching.listed_steps_col("text")
    return rows.select("tid", F.size(found).alias("n"), F.md5(F.array_join(found, "\n")).alias("digest"))


def differences(spark: SparkSession, root: str) -> DataFrame:
    """What differs most between each question and its solution."""
    rows = questions(spark, root).where("question is not null and solution is not null")
    d = batching.longest_difference_col("question", "solution")
    return rows.select("qid", d["only_a"].alias("only_a"), d["only_b"].alias("only_b"))


#: Commands a careless reader spoils, and what it leaves of them.
SPOILT = {"\\times": "\times", "\\frac": "\x0crac", "\\text{": "\text{", "\\binom": "\x08inom", "\\right": "\right", "\\alpha": "\x07lpha"}


def control(spark: SparkSession, root: str) -> DataFrame:
    """Items whose commands lost their first letters, repaired again."""
    rows = table(spark, root, "eval_items", "item_id", "question").distinct()
    spoilt = F.col("question")
    for command, eaten in SPOILT.items():
        spoilt = F.replace(spoilt, F.lit(command), F.lit(eaten))
    return rows.select(
        "item_id",
        text.control_chars(spoilt).cast("int").alias("spoilt"),
        F.md5(text.repair_latex(spoilt)).alias("restored"),
    )


def batches(spark: SparkSession, root: str) -> DataFrame:
    """Chains of every question packed by the square of their widest."""
    rows = pool(spark, root).where("n_tokens is not null")
    counts = rows.groupBy("qid", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("n"))
    packed = counts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n_tokens", "n"))).alias("w"))
    sizes = batching.batch_sizes(F.col("w.n_tokens"), F.col("w.n"))
    return packed.select("qid", F.size(sizes).alias("n_batches"), F.array_max(sizes).alias("largest"))


def sample_encoding(spark: SparkSession, root: str) -> DataFrame:
    """Prompt and answer as ids (word lengths stand in), masked and cut to 160."""
    rows = table(spark, root, "eval", "gen_id", "question", "text").distinct().where("question is not null and text is not null")
    ids = lambda c: F.transform(text.words(F.col(c)), lambda w: F.length(w))
    found = batching.encode_sample(ids("question"), ids("text"), 160, 0)
    return rows.select(
        "gen_id",
        F.size(found["ids"]).alias("n"),
        F.size(F.filter(found["labels"], lambda x: x >= 0)).alias("n_answer"),
        (F.element_at(found["ids"], -1) == 0).alias("closed"),
    ).where("n > 0")


def before_stop(spark: SparkSession, root: str) -> DataFrame:
    """Word lengths before the first one-letter word."""
    rows = table(spark, root, "candidates", "tid", "text").distinct().where("text is not null")
    ids = F.transform(text.words(F.col("text")), lambda w: F.length(w))
    return rows.select("tid", F.size(batching.split_at(ids, 1)).alias("n"))


def chamfer(spark: SparkSession, root: str) -> DataFrame:
    """Distance of the two halves of every group: the mean of both directed mean nearest distances."""
    d = objective.pair_distances(_vectors(spark, root)).where("i < 4 and j >= 4")
    near = lambda c: d.groupBy("qid", c).agg(F.min("d").alias("m")).groupBy("qid").agg(F.avg("m").alias(f"d_{c}"))
    return near("i").join(near("j"), "qid").select("qid", _r((F.col("d_i") + F.col("d_j")) / 2).alias("chamfer"))


def top_pair(spark: SparkSession, root: str) -> DataFrame:
    """Groups with exactly one pair of equal labels, and whether it is the closest pair."""
    rows = _vectors(spark, root)
    label = lambda c: rows.select("qid", F.col("pos").alias(c), F.col("label").alias(f"l_{c}"))
    d = objective.pair_distances(rows).join(label("i"), ["qid", "i"]).join(label("j"), ["qid", "j"])
    w = Window.partitionBy("qid")
    same = (F.col("l_i") == F.col("l_j")).cast("int")
    placed = d.withColumns({"same": same, "rn": F.row_number().over(w.orderBy("d", "i", "j")), "total": F.sum(same).over(w)})
    return placed.where("rn = 1 and total = 1").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("same"), F.lit(0)).alias("hits"))


def cosine_groups(spark: SparkSession, root: str) -> DataFrame:
    """Cosine of every vector with the mean vector of its label, by label."""
    rows = _vectors(spark, root)
    flat = rows.select("label", F.posexplode("vec").alias("d", "x"))
    means = flat.groupBy("label", "d").agg(F.avg("x").alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"))
    near = rows.join(F.broadcast(centre), "label")
    cos = objective.dot(F.col("vec"), F.col("c")) / F.sqrt(objective.dot(F.col("c"), F.col("c")))
    return near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(cos), 5).alias("mean"), _r(F.min(cos), 5).alias("least"))


def norms(spark: SparkSession, root: str) -> DataFrame:
    rows = _vectors(spark, root)
    return rows.select("qid", "pos", _r(objective.dot(F.col("vec"), F.col("vec")), 5).alias("norm"))


def pick_rate(spark: SparkSession, root: str) -> DataFrame:
    """How often drawing m questions puts the best teacher of all first, over 200 draws each."""
    names = ["deepseek", "llama70b", "qwen72b"]
    rows = pool(spark, root).where(F.col("teacher").isin(names))
    wide = rows.groupBy("qid").pivot("teacher", names).agg(F.avg("grape")).na.drop()

    hashed = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
    keyed = wide.withColumns({"all": F.lit("all"), "h": hashed(F.col("qid")), "one": F.lit(1)})
    numbered = running_sums(keyed, "all", "h", "qid", {"one": "place"}).checkpoint()
    whole = numbered.agg(F.count(F.lit(1)).alias("q"), *[F.avg(n).alias(n) for n in names])
    first = lambda: F.coalesce(*[F.when(F.col(n) == F.greatest(*names), F.lit(n)) for n in names])
    best = whole.select("q", first().alias("best"))
    sizes = F.explode(F.array(*map(F.lit, (5, 10, 20, 40))))
    picks = (
        spark.range(200)
        .select(F.col("id").alias("draw"), sizes.alias("m"))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m"))))
        .crossJoin(F.broadcast(best))
        .where("q > 0")
        .withColumn("place", hashed(F.concat_ws("|", "m", "draw", "i")) % F.col("q") + 1)
    )
    drawn = picks.join(numbered.select("place", *names), "place")
    each = drawn.groupBy("m", "draw", "best").agg(*[F.avg(n).alias(n) for n in names])
    return each.groupBy("m").agg(_r(F.avg((first() == F.col("best")).cast("double"))).alias("rate"))


def result_rows(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy, seeds and difference from the base of every tag and benchmark."""
    runs = metrics.run_accuracy(generations(spark, root), 1)
    by = runs.groupBy("tag", "benchmark").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("acc").alias("acc"))
    base = by.where("tag = 'base'").select("benchmark", F.col("acc").alias("base"))
    return by.join(base, "benchmark", "left").select(
        "tag", "benchmark", "n_seeds", _r("acc").alias("acc"), _r(F.col("acc") - F.col("base")).alias("diff")
    )


def cells(spark: SparkSession, root: str) -> DataFrame:
    """Report cells: percent with the spread of seeds, where there are two."""
    runs = metrics.run_accuracy(generations(spark, root), 1)
    by = runs.groupBy("tag", "benchmark").agg(F.avg("acc").alias("m"), F.stddev_samp("acc").alias("s"))
    m, s = F.round(100 * F.col("m") + 1e-9, 1).cast("decimal(10,1)"), F.round(100 * F.col("s") + 1e-9, 1).cast("decimal(10,1)")
    cell = F.when(s.isNull(), m.cast("string")).otherwise(F.concat_ws(" ± ", m.cast("string"), s.cast("string")))
    return by.select("tag", "benchmark", cell.alias("cell"))


def compare_report(spark: SparkSession, root: str) -> DataFrame:
    """Two signals in one line: same sets, chains shared, mean rank correlation, teachers and tokens of each pick."""
    rows = pool(spark, root).where(F.col("n") > K)
    a, b = rules.top_k_lean(rows, "grape", K), rules.top_k_lean(rows, "qual", K)
    sets = stats.same_sets(a, b).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg(F.col("same").cast("double"))).alias("rate"), _r(F.avg("shared")).alias("mean_shared")
    )
    rho = stats.spearman_within(rows, "grape", "qual").agg(_r(F.avg("rho"), 5).alias("rho"))
    side = lambda d, s: d.agg(
        _r(F.avg((F.col("teacher") == "qwen72b").cast("double"))).alias(f"qwen_{s}"), _r(F.avg(F.col("completion_tokens").cast("double"))).alias(f"tokens_{s}")
    )
    return sets.crossJoin(rho).crossJoin(side(a, "a")).crossJoin(side(b, "b"))


def train_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows that go to training: the picked chains with weight, tokens and question, in fixed order."""
    picked = rules.lark_weights(rules.lark(pool(spark, root)), K).select("qid", "tid", "teacher", _r("weight").alias("weight"), "n_tokens")
    asked = questions(spark, root).groupBy("qid").agg(F.md5(F.min("question")).alias("question"))
    return picked.join(asked, "qid").orderBy("qid", "tid")


def failures(spark: SparkSession, root: str) -> DataFrame:
    """Events by whether a failed one is worth another try."""
    rows = table(spark, root, "events", "event_type", "value").distinct()
    kind = F.when(F.col("event_type") != "error", "ok").when(F.col("value") < 50, "retry").otherwise("final")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "q_s8_find_runs": find_runs,
    "q_s3_shards": shards,
    "q_s10_messages": messages,
    "q_p14_version_gate": version_gate,
    "q_p15_stale_texts": stale,
    "q_p17_clipped": clipped,
    "q_p18_failures": failures,
    "q_f5_boxed_spans": boxed_spans,
    "q_f15_tidy_steps": tidy_steps,
    "q_f18_repaired": control,
    "q_f20_differences": differences,
    "q_f22_listed_steps": listed,
    "q_t29_step_audit": step_audit,
    "q_m3_norms": norms,
    "q_m7_batches": batches,
    "q_m11_before_stop": before_stop,
    "q_m13_sample_encoding": sample_encoding,
    "q_t13_chamfer": chamfer,
    "q_t14_top_pair": top_pair,
    "q_t31_cosine_groups": cosine_groups,
    "q_x11_pick_rate": pick_rate,
    "q_t18_result_rows": result_rows,
    "q_k10_cells": cells,
    "q_t11_compare_report": compare_report,
    "q_o1_train_rows": train_rows,
}

_ACC1 = f"""{WITH}, first as (select * exclude (k) from (select *, row_number() over (
    partition by tag, seed, benchmark, qid, sample order by gen_id desc) as k from gens where sample < 1) where k = 1),
runs as (select tag, seed, benchmark, avg(cast(coalesce(correct, false) as double)) as acc from first group by all)"""
_TOP = "row_number() over (partition by qid order by {} desc, pos)"
_LEN = r"list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w))"
_GHAT = f"""{WITH}, r as (select *, case when mean_surprisal <= 1e-30 then 0.0 else brier / mean_surprisal end as rho from pool),
s as (select *, sum(mean_surprisal) over (partition by qid) as total, sum(rho * mean_surprisal) over (partition by qid) as wt from r),
g as (select *, mean_surprisal / total * (2 * rho - wt / total) as ghat from s),
k as (select *, row_number() over (partition by qid order by ghat desc, pos) as rn from g),
c as (select *, ghat - max(case when rn = {K + 1} then ghat end) over (partition by qid) as gap from k),
d as (select *, sum(gap) over (partition by qid) as tot from c where rn <= {K})"""

SQL = {
    "q_s8_find_runs": "select tag, seed, count(*) as n from (select distinct * from eval) group by all",
    "q_s3_shards": f"{WITH} select teacher, count(*) as n from chains where teacher is not null group by teacher",
    "q_s10_messages": f"{WITH} select qid, md5(question) as digest from asked where question is not null",
    "q_p14_version_gate": f"""{WITH} select tid, case when signals_version >= 3 then local_nat end as local_nat,
      coalesce(signals_version < 3, true) as dropped from fits""",
    "q_p15_stale_texts": f"{WITH} select count(*) as n, count(*) filter (where finish_reason = 'length') as changed from (select distinct tid, text, finish_reason from candidates) where text is not null",
    "q_p17_clipped": "select tid, greatest(-3.0, least(3.0, rule_score)) as score from (select distinct tid, rule_score from quality where rule_score is not null)",
    "q_p18_failures": """select case when event_type <> 'error' then 'ok' when value < 50 then 'retry' else 'final' end as kind, count(*) as n
      from (select distinct event_type, value from events) group by 1""",
    "q_m3_norms": f"""{_V}, u as (select qid, pos, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as u from v)
      select qid, pos, round(list_inner_product(u, u), 5) as norm from u""",
    "q_m11_before_stop": f"""with c as (select tid, {_LEN.format("text")} as v from (select distinct tid, text from candidates where text is not null))
      select tid, cast(case when list_position(v, 1) > 0 then list_position(v, 1) - 1 else len(v) end as int) as n from c""",
    "q_m13_sample_encoding": f"""with c as (select gen_id, len({_LEN.format("question")}) as p, len({_LEN.format("text")}) as a
        from (select distinct gen_id, question, text from eval where question is not null and text is not null)),
      t as (select *, case when a + 1 <= 160 - p then a + 1 else least(a, greatest(160 - p, 0)) end as tail, a + 1 <= 160 - p as closed from c)
      select gen_id, cast(p + tail as int) as n, cast(tail as int) as n_answer, closed from t where 160 - p >= 2 and tail >= 2""",
    "q_t13_chamfer": f"""{_V}, h as (select * from d where i < 4 and j >= 4), a as (select qid, i, min(d) as m from h group by all), b as (select qid, j, min(d) as m from h group by all)
      select x.qid, round((x.m + y.m) / 2, 6) as chamfer from (select qid, avg(m) as m from a group by qid) x join (select qid, avg(m) as m from b group by qid) y on x.qid = y.qid""",
    "q_t14_top_pair": f"""{_V}, p as (select *, cast(li = lj as int) as same, row_number() over (partition by qid order by d, i, j) as rn,
        sum(cast(li = lj as int)) over (partition by qid) as total from d)
      select count(*) as n, coalesce(sum(same), 0) as hits from p where rn = 1 and total = 1""",
    "q_t31_cosine_groups": """with u as (select vec_id, label, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[])))) as v from embeddings),
      f as (select vec_id, label, unnest(v) as x, generate_subscripts(v, 1) as d from u), m as (select label, d, avg(x) as m from f group by all),
      c as (select label, sqrt(sum(m * m)) as len from m group by label),
      s as (select f.vec_id, f.label, sum(f.x * m.m) as dot from f join m on f.label = m.label and f.d = m.d group by all)
      select s.label, count(*) as n, round(avg(dot / len), 5) as mean, round(min(dot / len), 5) as least from s join c on s.label = c.label group by s.label""",
    "q_x11_pick_rate": f"""{WITH}, w as (select qid, avg(grape) filter (where teacher = 'deepseek') as d, avg(grape) filter (where teacher = 'llama70b') as l,
        avg(grape) filter (where teacher = 'qwen72b') as q from pool group by qid),
      n as (select *, row_number() over (order by cast('0x' || substr(md5(qid), 1, 8) as bigint), qid) as place, count(*) over () as c from w
        where d is not null and l is not null and q is not null),
      b as (select case when avg(d) = greatest(avg(d), avg(l), avg(q)) then 'd' when avg(l) = greatest(avg(d), avg(l), avg(q)) then 'l' else 'q' end as best, max(c) as c from n),
      s as (select m, r.draw, unnest(range(1, m + 1)) as i from (select unnest([5, 10, 20, 40]) as m), (select unnest(range(0, 200)) as draw) r),
      p as (select s.*, b.best, cast('0x' || substr(md5(s.m || '|' || s.draw || '|' || s.i), 1, 8) as bigint) % b.c + 1 as place from s, b),
      e as (select p.m, p.draw, p.best, avg(n.d) as d, avg(n.l) as l, avg(n.q) as q from p join n on p.place = n.place group by all)
      select m, round(avg(cast((case when d = greatest(d, l, q) then 'd' when l = greatest(d, l, q) then 'l' else 'q' end) = best as double)), 6) as rate from e group by m""",
    "q_t18_result_rows": f"""{_ACC1}, b as (select tag, benchmark, count(*) as n_seeds, avg(acc) as acc from runs group by all)
      select b.tag, b.benchmark, b.n_seeds, round(b.acc, 6) as acc, round(b.acc - z.acc, 6) as diff from b
      left join b z on z.tag = 'base' and z.benchmark = b.benchmark""",
    "q_k10_cells": f"""{_ACC1}, b as (select tag, benchmark, cast(round(100 * avg(acc) + 1e-9, 1) as decimal(10,1)) as m,
        cast(round(100 * stddev_samp(acc) + 1e-9, 1) as decimal(10,1)) as s from runs group by all)
      select tag, benchmark, case when s is null then cast(m as varchar) else m || ' ± ' || s end as cell from b""",
    "q_t11_compare_report": f"""{WITH}, p as (select *, {_TOP.format("grape")} as a, {_TOP.format("qual")} as b from pool where n > {K}),
      e as (select qid, count(*) filter (where a <= {K} and b <= {K}) as shared from p group by qid),
      r as (select qid, rank() over (partition by qid order by grape) + (count(*) over (partition by qid, grape) - 1) / 2.0 as x,
        rank() over (partition by qid order by qual) + (count(*) over (partition by qid, qual) - 1) / 2.0 as y from p),
      s as (select case when var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as rho from r group by qid having count(*) >= 3)
      select (select count(*) from e) as n, (select round(avg(cast(shared = {K} as double)), 6) from e) as rate, (select round(avg(shared), 6) from e) as mean_shared,
        (select round(avg(rho), 5) from s) as rho, (select round(avg(cast(teacher = 'qwen72b' as double)), 6) from p where a <= {K}) as qwen_a,
        (select round(avg(cast(completion_tokens as double)), 6) from p where a <= {K}) as tokens_a,
        (select round(avg(cast(teacher = 'qwen72b' as double)), 6) from p where b <= {K}) as qwen_b,
        (select round(avg(cast(completion_tokens as double)), 6) from p where b <= {K}) as tokens_b""",
    "q_o1_train_rows": f"""{_GHAT} select d.qid, d.tid, d.teacher, round({K} * case when d.n <= {K} or d.tot <= 1e-12 then 1.0 / {K} else d.gap / d.tot end, 6) as weight,
      d.n_tokens, md5(a.question) as question from d join (select qid, min(question) as question from asked group by qid) a on d.qid = a.qid""",
    "q_f18_repaired": "select item_id, cast("
    + " + ".join(f"(length(question) - length(replace(question, '{c}', ''))) / {len(c)}" for c in SPOILT)
    + " as int) as spoilt, md5(question) as restored from (select distinct item_id, question from eval_items)",
}
