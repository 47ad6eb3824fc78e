"""Every query over empty tables, over rows of nulls, and with columns whose names could clash."""

import pytest
from pyspark.sql import functions as F

from chainsieve.llm import queries as Q

ROOT = "/root/testdata/sf0.001"
TABLES = ["questions", "candidates", "fit", "quality", "eval", "eval_items", "documents"]
CLASHING = ["id", "node", "grp", "key", "hash", "other", "place", "flow", "n", "size", "host", "phrase", "cell", "lot", "_n", "value"]


def write(spark, folder, change):
    for name in TABLES:
        df = change(spark.read.parquet(f"{ROOT}/{name}.parquet"))
        for extra in CLASHING:
            if extra not in df.columns:
                df = df.withColumn(extra, F.lit("x"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), lambda df: df.limit(0))


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    """A few rows, each twice, and a row of nulls."""
    blank = lambda df: df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    return write(spark, tmp_path_factory.mktemp("nulls"), lambda df: df.limit(40).unionByName(df.limit(40)).unionByName(blank(df)))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_rows_of_nulls_do_no_harm(spark, nulls, name):
    rows = [str(r) for r in Q.queries()[name](spark, nulls).collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
