"""Streaming forms: windowed counts with late data, and last-write-wins compaction.

Both write one folder per batch, which a batch that is run again replaces, and read
the last row of every key among all batches.  Nothing is rewritten, nothing lives in the
driver, and a stream started again on the same folder goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsieve.operators.ranks import last_per_key
from chainsieve.session import checkpoint_dir


def _stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def _run(stream: DataFrame, mode: str, folder: str, prepare: Callable[[DataFrame], DataFrame]) -> None:
    """Works off what has arrived; every batch goes to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def windowed_counts(
    spark: SparkSession, path: str, time: str, key: str, every: str = "1 hour", folder: str | None = None
) -> DataFrame:
    """Rows and value sum by tumbling window and key, kept up to date as files arrive.

    Rows up to two hours behind the latest one seen before are counted into their
    window, later ones are dropped; so the state of windows that ended before is
    dropped too.  Only windows that changed are written.
    """
    folder = folder or _fresh(spark, "windows")
    stream = _stream(spark, path)
    counts = (
        stream.withColumn(time, stream[time].cast("timestamp"))
        .withWatermark(time, "2 hours")
        .groupBy(F.window(time, every), key)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), key, "n", "total")
    )
    _run(counts, "update", folder, lambda batch: batch)
    return last_per_key(spark.read.parquet(f"{folder}/out"), ["start", key], ["batch"]).drop("batch")


def compacted(spark: SparkSession, path: str, keys: list[str], order: list[str], folder: str | None = None) -> DataFrame:
    """The last row of every key of an append log; each batch is reduced to its last rows before it is written."""
    folder = folder or _fresh(spark, "compact")
    _run(_stream(spark, path), "append", folder, lambda batch: last_per_key(batch, keys, order))
    return last_per_key(spark.read.parquet(f"{folder}/out"), keys, order).drop("batch")
