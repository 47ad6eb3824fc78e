"""Every query of the core against its SQL over the smallest tables, and over empty ones."""

import pytest
from pyspark.sql import functions as F

from chainsieve.plans import registry
from tests.compare import assert_same, connect

ROOT = "/root/testdata/sf0.001"
TABLES = ["questions", "candidates", "fit", "quality", "eval", "eval_items", "documents", "embeddings", "events"]
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries whose result is one row of counts, or a fixed list, whatever the tables hold.
ALWAYS = {"q_s11_settings", "q_p13_methods", "q_m9_schedule", "q_m10_stage_plan", "q_f24_names"}


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{ROOT}/{name}.parquet").limit(0).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, con, name):
    assert_same(QUERIES[name](spark, ROOT), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    # The smallest tables have too few generations for a pair of complete runs.
    assert QUERIES[name](spark, ROOT.replace("sf0.001", "sf0.01")).limit(1).count() == 1


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES)[::4] if not n.startswith("q_s")])
def test_empty_tables_give_no_group(spark, empty, name):
    rows = QUERIES[name](spark, empty).limit(20).collect()
    # What is left over no rows at all: at most totals, whose counts are 0 or null.
    assert name in ALWAYS or len(rows) <= 12
