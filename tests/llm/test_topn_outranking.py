import math
import random

import pytest
from pyspark.sql import functions as F

from chainsieve.llm.outranking import brute_flows, net_flows
from chainsieve.llm.topn import latest, top_n


def test_latest_counts_even_if_null(spark):
    rows = [("a", "1", 0.5), ("a", "2", None), ("b", "1", 0.1), ("b", "1", 0.1), ("c", "2", float("nan")), (None, "1", 0.3)]
    df = spark.createDataFrame(rows, "tid string, ts string, grape double")
    got = {r.tid: r.grape for r in latest(df, "tid", "ts", "grape").collect()}
    assert got["a"] is None and got["b"] == 0.1 and math.isnan(got["c"]) and None not in got


@pytest.mark.parametrize("n", [1, 2, 5])
def test_top_n_against_sorting(spark, n):
    rng = random.Random(n)
    rows = [("hot" if i % 3 else f"q{i % 4}", f"t{i:03d}", rng.choice([0.1, 0.5, 0.9, None, float("nan"), -0.0])) for i in range(300)]
    rows += rows[:50] + [(None, "x", 1.0), ("q", None, 1.0)]
    df = spark.createDataFrame(rows, "place string, item string, score double")
    got = {}
    for r in top_n(df.withColumnRenamed("place", "grp"), ["grp"], F.col("score"), "item", n).collect():
        got.setdefault(r.grp, []).append((r.place, r.item, r.score))
    groups = {}
    for g, t, s in set(rows):
        if g is not None and t is not None and s is not None and not math.isnan(s):
            groups.setdefault(g, set()).add((-s, t))
    assert {g: [t for _, t, _ in sorted(v)] for g, v in got.items()} == {g: [t for _, t in sorted(v)[:n]] for g, v in groups.items()}
    assert top_n(df.limit(0), ["place"], F.col("score"), "item", n).count() == 0


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_flows_against_all_pairs(spark, block):
    rng = random.Random(5)
    odd = [None, float("nan"), 0.0, -0.0, 1e9, 3.0, 3.0]
    rows = [(q, f"{q}{i}", rng.choice(odd) if i % 3 == 0 else rng.gauss(0, 100), rng.choice([None, 0.1, 0.2, 0.9])) for q, m in (("a", 40), ("b", 2), ("c", 1)) for i in range(m)]
    df = spark.createDataFrame([*rows, (None, "z", 1.0, 1.0)], "q string, i string, s double, t double")
    got = {r.i: r for r in net_flows(df, "q", "i", {"s": 1.0, "t": 3.0}, block).collect()}
    assert len(got) == len(rows)
    for q in "abc":
        mine = [r for r in rows if r[0] == q]
        s, t = brute_flows([r[2] for r in mine]), brute_flows([r[3] for r in mine])
        want = {r[1]: x / 4 + 3 * y / 4 for r, x, y in zip(mine, s, t)}
        assert {i: got[i].flow for i in want} == pytest.approx(want, abs=2e-6)
        order = sorted(want, key=lambda i: (-got[i].flow, i))
        assert [got[i].place for i in order] == list(range(1, len(order) + 1))
    assert net_flows(df.limit(0), "q", "i", {"s": 1.0}).count() == 0


def test_no_score_wins_by_its_range(spark):
    rng = random.Random(1)
    rows = [("q", f"i{n}", rng.random(), rng.random()) for n in range(30)]
    df = spark.createDataFrame(rows, "q string, i string, s double, t double")
    flows = lambda d: {r.i: r.flow for r in net_flows(d, "q", "i", {"s": 1, "t": 1}).collect()}
    assert flows(df) == flows(df.withColumn("s", F.pow(F.lit(10.0), 40 * F.col("s"))))
