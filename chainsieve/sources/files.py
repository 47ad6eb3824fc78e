"""JSON Lines and whole-table files."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON Lines files; blank lines are skipped, a missing path gives no rows.

    A line that cannot be read is dropped when it is the last one of its file that is
    not blank (an interrupted append) and an error anywhere else, whatever it says.
    Lines are told apart by their place: the block of the file they were read from and
    their order within it.  Only the lines that cannot be read are looked up.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("_at"),
        "value",
    )
    lines = lines.where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_row", F.from_json("value", f"{schema}, _corrupt string", options))
    names = [f for f in spark.createDataFrame([], schema).columns]
    good = parsed.where("_row._corrupt is null").select(*[F.col("_row")[n].alias(n) for n in names])
    last = lines.groupBy("_file").agg(F.max("_at").alias("_last"))
    said = F.concat(F.lit("unreadable line in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 80))
    broken = (
        parsed.where("_row._corrupt is not null")
        .join(last, "_file")
        .where(F.when(F.col("_at") == F.col("_last"), False).otherwise(F.raise_error(said).cast("boolean")))
        .select(*[F.col("_row")[n].alias(n) for n in names])
    )
    return good.unionByName(broken)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """One object a line; the job's commit makes the files appear together.  Gives the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def append_jsonl(df: DataFrame, path: str, batch: int) -> int:
    """Adds a batch to a log: files of its own, so a batch that is run again replaces itself and no line is torn."""
    return write_jsonl(df, f"{path}/batch={batch}")


def shard_name(stem: str, teacher: Column) -> Column:
    """The file group a row of a teacher is written to."""
    return F.concat_ws(".", F.lit(stem), F.coalesce(teacher, F.lit("none")), F.lit("jsonl"))


def write_document(spark: SparkSession, path: str, value: object) -> None:
    """One JSON document: written beside its place, then moved there at once over what was there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = place.getFileSystem(conf).create(beside, True)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=1) + "\n").encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(beside, place, over)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as one row."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def unpack_npz(packed: DataFrame, content: str = "content") -> DataFrame:
    """``tid`` and ``vec`` of every vector of NumPy archives (arrays ``tids`` and ``vectors``) in a binary column.

    For files: ``unpack_npz(spark.read.format("binaryFile").load(path))``.  Null archives have no rows.
    """

    def run(frames):
        import io

        import numpy as np
        import pandas as pd

        for frame in frames:
            for raw in frame[content]:
                if raw is None:
                    continue
                with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as held:
                    yield pd.DataFrame({"tid": held["tids"].astype(str), "vec": list(held["vectors"].astype("float32"))})

    return packed.select(content).mapInPandas(run, "tid string, vec array<float>")


def fetch(read: Callable[[], bytes], digest: str | None = None, tries: int = 3, wait: float = 1.0) -> bytes:
    """What ``read`` gives, tried again with growing pauses; another md5 than ``digest`` is an error at once."""
    for n in range(tries):
        try:
            found = read()
            break
        except OSError:
            if n == tries - 1:
                raise
            time.sleep(wait * 2**n)
    if digest is not None and hashlib.md5(found).hexdigest() != digest:
        raise ValueError("the md5 of what was fetched differs from the pinned one")
    return found


def skip_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a hash of the whole table that does not depend on row order.

    Rows are hashed one by one and their hashes summed, so nothing is collected.
    """
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    number = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def check_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``name`` and ``problem`` (missing or changed) of manifest entries that do not hold."""
    both = manifest.select("name", F.col("digest").alias("want")).join(
        found.select("name", F.col("digest").alias("have")), "name", "left"
    )
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones of their name, the others stay."""
    return new.unionByName(old.join(new.select("name"), "name", "left_anti"))
