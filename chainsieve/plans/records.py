"""Sources, sinks, settings, projections, samples and exclusions as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainsieve import config
from chainsieve.functions import text
from chainsieve.operators import methods, ranks, samples
from chainsieve.plans.base import WITH, chains, fits, generations, pool, quality, questions
from chainsieve.session import checkpoint_dir
from chainsieve.sources import files
from chainsieve.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "eval_items", *columns).distinct()


def document(spark: SparkSession, root: str) -> DataFrame:
    """The number of held-out items by benchmark, written as one JSON document and read again."""
    path = _folder(spark, "document") + ".json"
    counts = _items(spark, root, "item_id", "benchmark").groupBy("benchmark").count().collect()  # one row a benchmark
    files.write_document(spark, path, {"items": [{"benchmark": r["benchmark"], "n": r["count"]} for r in counts]})
    found = files.read_document(spark, path, "items array<struct<benchmark: string, n: bigint>>")
    return found.select(F.explode("items").alias("i")).select("i.benchmark", "i.n")


def replaced_document(spark: SparkSession, root: str) -> DataFrame:
    """A document written twice: what is read is the whole second one."""
    path = _folder(spark, "document") + ".json"
    n = questions(spark, root).count()
    files.write_document(spark, path, {"state": "first", "n": -1, "filler": "x" * 5000})
    files.write_document(spark, path, {"state": "second", "n": n})
    return files.read_document(spark, path, "state string, n bigint, filler string")


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors packed as one NumPy archive a label and unpacked again."""

    def pack(frame):
        import io

        import numpy as np
        import pandas as pd

        out = io.BytesIO()
        np.savez(out, tids=frame["vec_id"].astype(str).to_numpy(str), vectors=np.array(frame["embedding"].tolist(), np.float32))
        return pd.DataFrame({"content": [out.getvalue()]})

    # An archive holds what one writer held; the archives of a label are cut by number.
    rows = table(spark, root, "embeddings").withColumn("shard", F.col("vec_id") % 16)
    found = files.unpack_npz(rows.groupBy("label", "shard").applyInPandas(pack, "content binary"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select(F.col("tid").cast("bigint").alias("vec_id"), F.size("vec").alias("d"), F.round(total, 3).alias("total"))


def pinned(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark files fetched under a pinned md5: a right pin passes after failures, a wrong one stops."""
    import hashlib

    bodies = [(r["benchmark"], r["ids"]) for r in _items(spark, root, "item_id", "benchmark").groupBy("benchmark").agg(F.count(F.lit(1)).cast("string").alias("ids")).collect()]
    out = []
    for name, body in sorted(bodies):
        raw, asked = body.encode(), []

        def read(raw=raw, asked=asked) -> bytes:
            asked.append(1)
            if len(asked) < 3:
                raise OSError("not yet")
            return raw

        fetched = files.fetch(read, hashlib.md5(raw).hexdigest(), wait=0.0)
        try:
            files.fetch(lambda raw=raw: raw, "0" * 32)
            wrong = "passed"
        except ValueError:
            wrong = "stopped"
        out.append((name, len(asked), int(fetched), wrong))
    return spark.createDataFrame(out, "benchmark string, tries int, n int, wrong string")


#: What each benchmark calls its question and answer, and how its answer is cleaned.
BENCHMARKS: dict[str, tuple[str, str, bool]] = {
    "aime24": ("Problem", "Answer", True),
    "amc23": ("question", "answer", True),
    "bbh": ("input", "target", False),
    "gsm8k": ("question", "answer", True),
    "math500": ("problem", "answer", False),
}


def _loaded(spark: SparkSession, root: str, benchmark: str) -> DataFrame:
    """The records of one benchmark under its own column names, brought to the common ones."""
    asked, answer, number = BENCHMARKS.get(benchmark, ("question", "answer", False))
    raw = _items(spark, root, "item_id", "benchmark", "question", "gold").where(F.col("benchmark") == benchmark)
    raw = raw.withColumnsRenamed({"question": asked, "gold": answer})
    gold = text.clean_gold(picked(raw, ["answer", "target"])) if number else F.trim(picked(raw, ["answer", "target"]))
    return raw.select("benchmark", "item_id", picked(raw, ["question", "problem", "input"]).alias("question"), gold.alias("gold"))


def picked(df: DataFrame, names: list[str]) -> Column:
    """The first of ``names`` that is a column of ``df``, whatever its case."""
    known = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in known:
            return F.col(known[name.lower()])
    raise KeyError(f"none of {names} among {df.columns}")


def dispatched(spark: SparkSession, root: str) -> DataFrame:
    """Questions of all benchmarks, each through its own loader."""
    found = None
    for name in BENCHMARKS:
        rows = _loaded(spark, root, name)
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"), F.count("gold").alias("n_gold"), F.sum(F.length("question")).alias("chars")
    )


def loaded_questions(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty questions of a run over two benchmarks: a fixed sample of each subset, then the limit."""
    rows = _items(spark, root, "item_id", "benchmark", "subset").where("benchmark in ('bbh', 'math500')")
    fixed = samples.first_by_hash(rows, "item_id", 7, "benchmark", "subset")
    return samples.first_by_hash(fixed, "item_id", 20, "benchmark").select("benchmark", "item_id")


SETTINGS = '{"select": {"k": 3, "methods": ["grape", "quality"]}, "veto": {"share": 0.25, "by": "qual"}, "root": "runs"}'


def settings(spark: SparkSession, root: str) -> DataFrame:
    """Settings after a second file, dotted overrides and the environment file were laid over them."""
    base = config.merged(config.parse(SETTINGS), config.parse('{"select": {"methods": ["veto"]}}'))
    env = config.read_env("# machine\nexport DATA_ROOT='/data'\n\nEMPTY=\n")
    final = config.flat(config.overridden(base, ["veto.share=0.5", "select.seed=42"]))
    final["root"] = config.resolved(str(final["root"]), env["DATA_ROOT"])
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(final.items())], "name string, value string")


def written(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each source as the writer counted them while it wrote."""
    path = _folder(spark, "written")
    n = files.write_jsonl(questions(spark, root).select("qid", "source"), path)
    again = files.read_jsonl(spark, f"{path}/*.json", "qid string, source string")
    return again.agg(F.count(F.lit(1)).alias("n_read")).withColumn("n_written", F.lit(n).cast("bigint"))


def appended(spark: SparkSession, root: str) -> DataFrame:
    """A log of two batches, the first of which was run twice."""
    path, rows = _folder(spark, "log"), chains(spark, root).select("tid", "sample_idx")
    early, late = rows.where("sample_idx % 2 = 0"), rows.where("sample_idx % 2 = 1")
    for batch, part in ((0, early), (0, early), (1, late)):
        files.append_jsonl(part, path, batch)
    found = files.read_jsonl(spark, f"{path}/*/*.json", "tid string, sample_idx int")
    return found.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("n_chains"))


def not_done(spark: SparkSession, root: str) -> DataFrame:
    """Chains that have not been scored yet."""
    return files.skip_done(chains(spark, root).select("tid"), table(spark, root, "fit", "tid"), "tid")


def shard_names(spark: SparkSession, root: str) -> DataFrame:
    """The file group of every teacher's chains, with its number of rows."""
    shard = files.shard_name("trajectories", F.col("teacher"))
    return chains(spark, root).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    rows = _items(spark, root, "item_id", "benchmark", "question").groupBy(F.col("benchmark").alias("name"))
    size = F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(F.length("question")), F.lit(0)).cast("string"))
    return rows.agg(size.alias("digest"))


def broken(spark: SparkSession, root: str) -> DataFrame:
    """Entries of a manifest that no longer hold: one benchmark is gone, one has lost its null subsets."""
    want = _manifest(spark, root)
    changed = F.when(F.col("name") == "bbh", F.concat("digest", F.lit("*"))).otherwise(F.col("digest"))
    have = want.where("name <> 'gsm8k'").select("name", changed.alias("digest"))
    return files.check_manifest(have, want)


def upserted(spark: SparkSession, root: str) -> DataFrame:
    """A manifest after two benchmarks were built anew."""
    old = _manifest(spark, root)
    new = old.where("name in ('bbh', 'gsm8k')").select("name", F.concat(F.lit("new "), "digest").alias("digest"))
    return files.upsert_manifest(old, new)


def picked_columns(spark: SparkSession, root: str) -> DataFrame:
    rows = questions(spark, root).withColumnRenamed("question", "Problem").withColumnRenamed("gold", "ANSWER")
    return rows.select("qid", picked(rows, ["question", "problem"]).alias("question"), picked(rows, ["answer"]).alias("answer"))


def oriented(spark: SparkSession, root: str) -> DataFrame:
    """Signals so that more is better: only the one of which less is better is negated."""
    names = ("rsr", "grape", "local_nat")
    rows = fits(spark, root)
    return rows.select("tid", *[ranks.oriented(F.col(c), methods.direction(c)).alias(c) for c in names])


#: Signals that go by another name than their column.
ALIASES = {"token_length": "n_tokens", "llm_quality": "llm_score", "quality": "qual"}


def signal(name: str) -> Column:
    return F.col(ALIASES.get(name, name))


def aliased(spark: SparkSession, root: str) -> DataFrame:
    rows = pool(spark, root)
    return rows.select("tid", *[signal(n).alias(n) for n in ("token_length", "llm_quality", "quality", "grape")])


def usable_chains(spark: SparkSession, root: str) -> DataFrame:
    judged = quality(spark, root).where("qual is not null").select("tid")
    return chains(spark, root).select("tid", "qid").join(judged, "tid", "left_semi")


def by_question(spark: SparkSession, root: str) -> DataFrame:
    """Questions with five usable chains and more, in hashed order."""
    rows = usable_chains(spark, root).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return samples.first_by_hash(rows, "qid", 100).select("qid", "n")


def method_names(spark: SparkSession, root: str) -> DataFrame:
    """All selection methods, and whether they run only on demand."""
    usual = set(methods.method_list())
    rows = [(m, m not in usual) for m in methods.method_list(exploratory=True)]
    return spark.createDataFrame(rows, "method string, on_demand boolean")


def seeded(spark: SparkSession, root: str) -> DataFrame:
    """Forty questions drawn with a seed: the first ones in the order its hash gives."""
    return samples.first_by_hash(questions(spark, root).select("qid").distinct(), "qid", 40, seed=7)


def validation(spark: SparkSession, root: str) -> DataFrame:
    """Ten questions of each source held out for validation, the others its pool."""
    rows = questions(spark, root).select("qid", "source").distinct()
    held = samples.first_by_hash(rows, "qid", 10, "source").select("qid", F.lit(True).alias("held"))
    parts = rows.join(held, "qid", "left").withColumn("part", F.when(F.col("held"), "validation").otherwise("pool"))
    return parts.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("first"), F.max("qid").alias("last"))


DRAWS = 50


def drawn_indexes(spark: SparkSession, root: str) -> DataFrame:
    """Index matrix of a resampling: per draw and place a question of the benchmark, from the hash of both."""
    n = _items(spark, root, "item_id", "benchmark").groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    cells = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    index = draw(F.concat_ws("|", "benchmark", "draw", "place"), F.col("n"))
    return cells.groupBy("benchmark", "draw").agg(F.sum(index).alias("total"), F.min(index).alias("least"), F.max(index).alias("most"))


def draw(key: Column, n: Column | int) -> Column:
    """A number from 0 to ``n - 1`` that depends on the key alone."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n


def keyed_draws(spark: SparkSession, root: str) -> DataFrame:
    """One of a thousand numbers for every chain, the same in every run and on every machine."""
    return chains(spark, root).select("tid", draw(F.concat(F.lit("7|"), "tid"), 1000).alias("number"))


def united(spark: SparkSession, root: str) -> DataFrame:
    """The shards of all teachers united, each chain with its shard."""
    rows = chains(spark, root).select("tid", "teacher")
    names = ["deepseek", "llama70b", "qwen72b"]
    parts = [rows.where(F.col("teacher") == n).select("tid", F.lit(n).alias("shard")) for n in names]
    parts.append(rows.where(~F.col("teacher").isin(names) | F.col("teacher").isNull()).select("tid", F.lit("rest").alias("shard")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("n_chains"))


def excluded(spark: SparkSession, root: str) -> DataFrame:
    """Training questions that may stay: none whose normalised text stands among the held-out ones."""
    barred = _items(spark, root, "question").where("question is not null").select(text.norm(F.col("question")).alias("plain")).distinct()
    asked = generations(spark, root, text=True).where("question is not null").select(text.norm(F.col("question")).alias("plain"))
    rows = questions(spark, root).where("question is not null").select("qid", "source", text.norm(F.col("question")).alias("plain"))
    kept = rows.join(barred.unionByName(asked).distinct(), "plain", "left_anti")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("n_questions"))


def limited(spark: SparkSession, root: str) -> DataFrame:
    """The first fifty chains in the order of their keys."""
    return chains(spark, root).select("tid", "qid").orderBy("tid").limit(50)


QUERIES = {
    "q_s2_document": document,
    "q_s4_vectors": vectors,
    "q_s6_pinned": pinned,
    "q_s7_dispatch": dispatched,
    "q_s9_questions": loaded_questions,
    "q_s11_settings": settings,
    "q_k1_written": written,
    "q_k2_appended": appended,
    "q_k3_not_done": not_done,
    "q_k4_shard_names": shard_names,
    "q_k5_replaced_document": replaced_document,
    "q_k7_broken": broken,
    "q_k12_upserted": upserted,
    "q_p5_picked": picked_columns,
    "q_p6_oriented": oriented,
    "q_p7_aliases": aliased,
    "q_p11_usable_chains": usable_chains,
    "q_p13_methods": method_names,
    "q_p16_by_question": by_question,
    "q_x1_seeded": seeded,
    "q_x7_validation": validation,
    "q_x10_indexes": drawn_indexes,
    "q_x12_keyed": keyed_draws,
    "q_u1_united": united,
    "q_u7_excluded": excluded,
    "q_o3_limited": limited,
}

_ITEMS = "(select distinct item_id, benchmark, subset, question, gold from eval_items)"
_MANIFEST = """with m as (select benchmark as name, count(*) || '/' || coalesce(sum(length(question)), 0) as digest
  from (select distinct item_id, benchmark, question from eval_items) group by benchmark)"""
_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_CLEAN = r"""regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(gold), '\^\s*\{{?\s*\\circ\s*\}}?|°', '', 'g')), '^\$+|\$+$', '', 'g')), '^(-?\d+)\.0+$', '\1')"""
_DRAW = "cast('0x' || substr(md5({}), 1, 8) as bigint)"

SQL = {
    "q_s2_document": f"select benchmark, count(*) as n from {_ITEMS} group by benchmark",
    "q_s4_vectors": "select vec_id, len(embedding) as d, round(list_sum(cast(embedding as double[])), 3) as total from embeddings",
    "q_s6_pinned": f"select benchmark, 3 as tries, count(*) as n, 'stopped' as wrong from {_ITEMS} group by benchmark",
    "q_s7_dispatch": f"""select benchmark, count(*) as n, count(gold) as n_gold, sum(length(question)) as chars from {_ITEMS}
      where benchmark in ({", ".join(repr(b) for b in BENCHMARKS)}) group by benchmark""",
    "q_s9_questions": f"""with r as (select benchmark, item_id, row_number() over (partition by benchmark, subset order by sha256('42|' || item_id), item_id) as k
        from {_ITEMS} where benchmark in ('bbh', 'math500')),
      s as (select benchmark, item_id, row_number() over (partition by benchmark order by sha256('42|' || item_id), item_id) as j from r where k <= 7)
      select benchmark, item_id from s where j <= 20""",
    "q_s11_settings": """select * from (values ('root', '/data/runs'), ('select.k', '3'), ('select.methods', '[''veto'']'), ('select.seed', '42'),
      ('veto.by', 'qual'), ('veto.share', '0.5')) t(name, value)""",
    "q_k1_written": "select count(*) as n_read, count(*) as n_written from (select distinct * from questions)",
    "q_k2_appended": f"{WITH} select sample_idx, count(*) as n, count(distinct tid) as n_chains from chains where sample_idx is not null group by sample_idx",
    "q_k3_not_done": f"{WITH} select tid from chains where tid not in (select tid from fit where tid is not null)",
    "q_k4_shard_names": f"{WITH} select 'trajectories.' || coalesce(teacher, 'none') || '.jsonl' as shard, count(*) as n from chains group by 1",
    "q_k5_replaced_document": "select 'second' as state, count(*) as n, cast(null as varchar) as filler from (select distinct * from questions)",
    "q_k7_broken": f"{_MANIFEST} select name, case when name = 'bbh' then 'changed' else 'missing' end as problem from m where name in ('bbh', 'gsm8k')",
    "q_k12_upserted": f"{_MANIFEST} select name, case when name in ('bbh', 'gsm8k') then 'new ' || digest else digest end as digest from m",
    "q_p5_picked": f"{WITH} select qid, question, gold as answer from asked",
    "q_p6_oriented": f"{WITH} select tid, -rsr as rsr, grape, local_nat from fits",
    "q_p7_aliases": f"{WITH} select tid, n_tokens as token_length, llm_score as llm_quality, qual as quality, grape from pool",
    "q_p11_usable_chains": f"{WITH} select tid, qid from chains where tid in (select tid from quals where qual is not null)",
    "q_p13_methods": "select * from (values "
    + ", ".join(f"('{n}', {str(m.exploratory).lower()})" for n, m in methods.METHODS.items())
    + ") t(method, on_demand)",
    "q_p16_by_question": f"""{WITH}, c as (select qid, count(*) as n from chains where tid in (select tid from quals where qual is not null) group by qid having count(*) >= 5)
      select qid, n from c order by sha256('42|' || qid), qid limit 100""",
    "q_x1_seeded": f"{WITH} select qid from (select distinct qid from asked) order by sha256('7|' || qid), qid limit 40",
    "q_x7_validation": f"""{WITH}, d as (select distinct qid, source from asked),
      r as (select *, row_number() over (partition by source order by sha256('42|' || qid), qid) as k from d)
      select source, case when k <= 10 then 'validation' else 'pool' end as part, count(*) as n, min(qid) as first, max(qid) as last from r group by 1, 2""",
    "q_x10_indexes": f"""with c as (select benchmark, count(*) as n from {_ITEMS} group by benchmark),
      d as (select benchmark, n, d as draw, unnest(range(0, n)) as place from c, range(0, {DRAWS}) t(d)),
      i as (select benchmark, draw, {_DRAW.format("benchmark || '|' || draw || '|' || place")} % n as x from d)
      select benchmark, draw, sum(x) as total, min(x) as least, max(x) as most from i group by benchmark, draw""",
    "q_x12_keyed": f"{WITH} select tid, {_DRAW.format("'7|' || tid")} % 1000 as number from chains",
    "q_u1_united": f"""{WITH} select case when teacher in ('deepseek', 'llama70b', 'qwen72b') then teacher else 'rest' end as shard,
      count(*) as n, count(distinct tid) as n_chains from chains group by 1""",
    "q_u7_excluded": f"""{WITH}, b as (select {_NORM.format("question")} as p from eval_items where question is not null
        union select {_NORM.format("question")} from gens where question is not null)
      select source, count(*) as n, count(distinct qid) as n_questions from asked where question is not null and {_NORM.format("question")} not in (select p from b) group by source""",
    "q_o3_limited": f"{WITH} select tid, qid from chains order by tid limit 50",
}
