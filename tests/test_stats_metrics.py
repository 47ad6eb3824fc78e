import pytest
from pyspark.sql import functions as F

from chainsieve.operators import metrics, objective, samples, stats


def gens(spark, hits, tag="a", seed=1, **more):
    rows = [
        (n * 100 + s, tag, seed, "b", f"q{n}", s, bool(c), more.get("n_tokens", {}).get((n, s), 10), (n, s) not in more.get("open", ()))
        for n, line in enumerate(hits)
        for s, c in enumerate(line)
    ]
    return spark.createDataFrame(rows, "gen_id bigint, tag string, seed int, benchmark string, qid string, sample int, correct boolean, n_tokens int, stopped boolean")


def test_accuracy(spark):
    df = gens(spark, [[1, 0, 0, 0], [1, 1, 1, 1], [0, 0, 0, 0]])
    row = metrics.run_accuracy(df, 4).first()
    assert (row.acc, row.passed) == pytest.approx((1.25 / 3, 2 / 3))
    short = gens(spark, [[1, 0, 0], [1, 1, 1, 1]])
    assert [r.qid for r in metrics.question_accuracy(short, 4).collect()] == ["q1"]


def test_pooled_needs_every_seed(spark):
    df = gens(spark, [[1] * 4, [0] * 4]).unionByName(gens(spark, [[0] * 4], seed=2))
    assert [(r.qid, r.acc) for r in metrics.pooled_question_accuracy(df).collect()] == [("q0", 0.5)]


def test_bootstrap_and_difference(spark):
    base, better = [4, 2, 0, 1, 3, 0, 4, 2], [4, 3, 1, 2, 4, 1, 4, 3]
    line = lambda k: [1] * k + [0] * (4 - k)
    both = gens(spark, map(line, base), "base").unionByName(gens(spark, map(line, better), "better"))
    row = metrics.bootstrap(metrics.paired(metrics.pooled_question_accuracy(both), "base", "better")).first()
    assert row["diff"] == pytest.approx(6 / 32) and row.low > 0 and row.high > row["diff"]


def test_length_split_adds_up(spark):
    a = gens(spark, [[1, 0, 0, 0], [1, 1, 0, 0], [0] * 4], "a", n_tokens={(0, 1): 3072}, open=[(0, 1)])
    b = gens(spark, [[1, 1, 1, 1], [1, 0, 0, 0], [0] * 4], "b")
    rows = {r.cut: r for r in metrics.length_split(a.unionByName(b), "a", "b").collect()}
    assert rows["cut"].n == 1 and rows["clean"].n == 2
    assert rows["cut"].contribution + rows["clean"].contribution == pytest.approx(rows["all"]["diff"])


def test_spearman(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 3.0), ("a", 2.0, 2.0), ("a", 3.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 5.0)],
        "qid string, x double, y double",
    )
    assert {r.qid: r.rho for r in stats.spearman_within(df, "x", "y").collect()} == {"a": pytest.approx(-1), "c": None}


def test_pair_agreement(spark):
    df = spark.createDataFrame(
        [("1", 0.9, 0.8, 1), ("1", 0.5, 0.4, 2), ("1", 0.7, 0.9, 3), ("2", 0.5, 0.5, 1), ("2", 0.6, 0.5, 2)], "qid string, x double, y double, pos int"
    )
    row = stats.pair_agreement(df, "x", "y").first()
    assert (row.same, row["diff"], row.tie_a, row.tie_b) == (2, 1, 0, 1) and row.rate == pytest.approx(2 / 3)
    assert stats.top_one_agreement(df, "x", "y").first().n_groups == 2


def test_wilson_and_auc(spark):
    low, high = stats.wilson(F.lit(160), F.lit(200))
    row = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert 0.73 < row.a < 0.75 and 0.84 < row.b < 0.86
    none = stats.wilson(F.lit(0), F.lit(0))[0]
    assert spark.range(1).select(none.alias("a")).first().a is None

    def auc(scores, labels):
        return stats.auc(spark.createDataFrame(list(zip(scores, labels)), "s double, l int"), "s", "l").first().auc

    assert auc([1.0, 0.0], [1, 0]) == 1 and auc([0.0, 1.0], [1, 0]) == 0 and auc([1.0, 1.0], [1, 0]) == 0.5 and auc([1.0], [1]) is None


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (1, 0)], "x int, y int")
    assert stats.kappa(df, "x", "y").first().kappa == pytest.approx(0.5)


def test_same_sets_and_overlap(spark):
    a = spark.createDataFrame([("q", "1"), ("q", "2")], "qid string, tid string")
    b = spark.createDataFrame([("q", "2"), ("q", "3")], "qid string, tid string")
    assert tuple(stats.same_sets(a, b).first()) == ("q", 1, False)
    tagged = a.withColumn("tag", F.lit("a")).unionByName(b.withColumn("tag", F.lit("b")))
    assert {(r.tag_a, r.tag_b): r.percent for r in stats.overlap_matrix(tagged).collect()}[("a", "b")] == 50


def test_objective_against_enumeration(spark):
    import itertools
    import math
    import random

    rng = random.Random(3)
    items = []
    for p in range(6):
        v = [rng.gauss(0, 1) for _ in range(4)]
        n = math.sqrt(sum(x * x for x in v))
        items.append(("q", p, [x / n for x in v], rng.random(), rng.random()))
    df = spark.createDataFrame(items, "qid string, pos int, vec array<double>, fit double, qual double")
    got = objective.best_triple(objective.scored_triples(df, 1, 1, 0.4)).first()

    def value(s):
        d = lambda a, b: math.sqrt(max(0, 2 - 2 * sum(x * y for x, y in zip(items[a][2], items[b][2]))))
        return sum(items[i][3] * items[i][4] for i in s) + 0.4 * sum(min(d(i, j) for j in s if j != i) for i in s)

    best = max(itertools.combinations(range(6), 3), key=value)
    assert (got.p1, got.p2, got.p3) == best and got.value == pytest.approx(value(best))
    assert len(objective.greedy_sets(df, 0.4).collect()) == 3
    unit = df.select(objective.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first().v
    assert unit == [0.0, 0.0]


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 800), ("b", 600), ("c", 400), ("d", 200)], "s string, n int")
    got = lambda n: {r.s: r.quota for r in samples.allocation(sizes, "s", "n", n).collect()}
    assert got(200) == {"a": 80, "b": 60, "c": 40, "d": 20} and sum(got(37).values()) == 37


def test_samples_are_whole_and_fixed(spark):
    df = spark.createDataFrame([(f"g{i % 5}", f"i{i}") for i in range(23)], "g string, i string")
    groups = samples.whole_groups(df, "g", 6)
    sizes = [r["count"] for r in groups.groupBy("g").count().collect()]
    assert sum(sizes) >= 6 and sum(sizes) - max(sizes) < 6
    assert samples.first_by_hash(df, "i", 2, "g").count() == 10
    assert samples.equal_per_group(df, "i", "g", 10).count() == 10
    assert samples.first_by_hash(df.limit(0), "i", 2, "g").count() == 0
