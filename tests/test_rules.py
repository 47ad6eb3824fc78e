import itertools
import random

import pytest
from pyspark.sql import functions as F

from chainsieve.operators import pool as P
from chainsieve.operators import ranks, rules

TEACHERS = ["north", "south", "east"]


def chains(spark, n, **columns):
    names = list(columns)
    value = lambda v: v if isinstance(v, str) else float(v)
    rows = [("q", f"t{i}", i + 1, *[value(columns[c][i]) for c in names]) for i in range(n)]
    kinds = ", ".join(f"{c} {'string' if isinstance(columns[c][0], str) else 'double'}" for c in names)
    return spark.createDataFrame(rows, f"qid string, tid string, pos int, {kinds}").withColumn("n", F.lit(n))


def picked(df):
    return sorted(r.pos - 1 for r in df.collect())


def drawn(seed, n):
    """Random signals with ties, and teachers."""
    rng = random.Random(seed)
    return [rng.randrange(6) / 2 for _ in range(n)], [rng.randrange(5) / 4 for _ in range(n)], [rng.choice(TEACHERS) for _ in range(n)]


def by(values, rows, k):
    """The ``k`` rows with the greatest values, earlier ones first among equals."""
    return sorted(rows, key=lambda i: (-values[i], i))[:k]


def vetoed(values, rows, k, share):
    """The rows left after the worst ones, later ones first among equals, were dropped."""
    out = max(0, min(len(rows) - k, int(share * len(rows) + 1e-9)))
    return sorted(rows, key=lambda i: (values[i], -i))[out:]


def normed(values):
    """Mean 0-based place among all, over the greatest."""
    if len(values) == 1:
        return [1.0]
    return [(sum(w < v for w in values) + (sum(w == v for w in values) - 1) / 2) / (len(values) - 1) for v in values]


CASES = [(seed, n) for seed, n in enumerate((3, 4, 7, 9, 12))]


@pytest.mark.parametrize(("seed", "n"), [*CASES, (9, 1)])
def test_norm_rank(spark, seed, n):
    s, _, _ = drawn(seed, n)
    for direction, sign in (("max", 1), ("min", -1)):
        df = chains(spark, n, s=s)
        rows = df.select("pos", ranks.norm_rank(F.col("s"), direction=direction).alias("r")).orderBy("pos").collect()
        assert [r.r for r in rows] == pytest.approx(normed([sign * v for v in s]))


def test_minmax_and_constant(spark):
    df = chains(spark, 4, s=[12.0, 20.0, 14.0, 16.0], c=[7.5] * 4)
    rows = df.select(ranks.minmax(F.col("s")).alias("s"), ranks.minmax(F.col("c")).alias("c")).collect()
    assert [r.s for r in rows] == [0, 1, 0.25, 0.5] and [r.c for r in rows] == [0.5] * 4


@pytest.mark.parametrize(("seed", "n"), CASES)
def test_rules_over_all_chains(spark, seed, n):
    s, v, who = drawn(seed, n)
    df, every, k = chains(spark, n, s=s, v=v, teacher=who), range(n), 3
    best = by(s, every, n)
    top = rules.top_k(df, "s", k)
    assert picked(top) == sorted(best[:k])
    assert {r.tie for r in top.collect()} == {n > k and s[best[k - 1]] == s[best[k]]}
    assert picked(rules.top_k_lean(df, "s", k)) == sorted(best[:k])
    assert picked(rules.random_k(df, k)) == list(range(k))
    total = [round((a + b) / 2, 9) for a, b in zip(normed(s), normed(v))]
    assert picked(rules.rank_sum(df, {"s": (0.5, "max"), "v": (0.5, "max")}, k)) == sorted(by(total, every, k))
    for share in (0.0, 0.34, 0.6, 0.9):
        assert picked(rules.veto_top_k(df, "s", "v", share, k)) == sorted(by(s, vetoed(v, every, k, share), k))
    likes = {i: (who[i] == "north") - (who[i] == "east") for i in every}
    assert picked(rules.teacher_first(df, ["north"], ["east"], k)) == sorted(by(likes, every, k))


@pytest.mark.parametrize(("seed", "n"), CASES)
def test_rules_within_teachers(spark, seed, n):
    s, v, who = drawn(seed, n)
    df, k = chains(spark, n, s=s, v=v, teacher=who), 3
    own = {t: [i for i in range(n) if who[i] == t] for t in TEACHERS}
    first = {t: sum(i < k for i in rows) for t, rows in own.items()}
    best = by(s, range(n), k)
    share = {t: sum(i in best for i in rows) for t, rows in own.items()}
    gather = lambda take: sorted(i for t, rows in own.items() for i in take(t, rows))
    assert picked(rules.within_teacher(df, "s", k)) == gather(lambda t, rows: by(s, rows, first[t]))
    assert picked(rules.random_at_signal_shares(df, "s", k)) == gather(lambda t, rows: rows[: share[t]])
    got = rules.veto_within_teacher(df, "s", "v", 0.4, k)
    assert picked(got) == gather(lambda t, rows: by(s, vetoed(v, rows, first[t], 0.4), first[t]) if first[t] else [])


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        rules.rank_sum(chains(spark, 3, s=[1, 2, 3]), {"s": (0.7, "max")})


def test_lark(spark):
    loss, brier = [0.8, 2.4, 1.6], [0.2, 0.9, 0.64]
    rho, total = [b / x for b, x in zip(brier, loss)], sum(loss)
    mean = sum(r * x for r, x in zip(rho, loss)) / total
    got = [r.ghat for r in rules.lark(chains(spark, 3, mean_surprisal=loss, brier=brier)).orderBy("pos").collect()]
    assert got == pytest.approx([x / total * (2 * r - mean) for r, x in zip(rho, loss)])

    def weights(values, b):
        return {r.pos - 1: r.weight for r in rules.lark_weights(chains(spark, len(values), ghat=values), b).collect()}

    assert weights([0.4, 0.1], 3) == pytest.approx({0: 1.5, 1: 1.5})
    assert weights([0.6] * 5, 2) == pytest.approx({0: 1, 1: 1})
    assert weights([0.1, 0.7, 0.3, 0.6], 2) == pytest.approx({1: 2 * 0.4 / 0.7, 3: 2 * 0.3 / 0.7})
    assert set(weights([float("nan"), 0.7, 0.3, 0.2], 2)) == {1, 2}


def test_pools_take_nulls_and_empty_tables(spark):
    c = spark.createDataFrame([("q", "a", None, "x", None), ("q", "b", "t", " ", "stop"), ("q", "c", "t", "y", "length")], "qid string, tid string, teacher string, text string, finish_reason string")
    q = spark.createDataFrame([("a", "q", 1.0), ("b", "q", 1.0), ("c", "q", None)], "tid string, qid string, qual double")
    assert P.usable_pool(c, q, 2).count() == 2 and P.usable_pool(c, q, 3).count() == 0
    assert [r.tid for r in P.extended_pool(c, c, P.excluded_chains(c, q)).collect()] == ["a"]
    assert P.usable_pool(c.limit(0), q).count() == 0
    four = spark.createDataFrame([("q", str(i), t, 4) for i, t in enumerate(["west", "up", "down", "up"])], "qid string, tid string, teacher string, n int")
    assert sorted(r.tid for r in P.without_teachers(four, ["west"]).collect()) == ["1", "2", "3"]


def test_hashed_position_is_fixed(spark):
    df = spark.createDataFrame([("q", t) for t in "abcde"], "qid string, tid string")
    import hashlib

    want = sorted("abcde", key=lambda t: hashlib.sha256(f"42|{t}".encode()).hexdigest())
    assert [r.tid for r in ranks.hashed_position(df).orderBy("pos").collect()] == want


def test_running_sums_in_blocks(spark):
    from chainsieve.operators.prefix import running_sums

    rows = [(g, float(i % 7), i, 1) for g, n in (("hot", 500), ("cold", 3)) for i in range(n)] + [(None, 1.0, 0, 1)]
    df = spark.createDataFrame(rows, "g string, o double, t int, one int")
    got = {(r.g, r.o, r.t): r.upto for r in running_sums(df, "g", "o", "t", {"one": "upto"}, block_rows=50).collect()}
    for g, part in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])), key=lambda r: r[0]):
        for n, r in enumerate(part, 1):
            assert got[(g, r[1], r[2])] == n
    assert running_sums(df.limit(0), "g", "o", "t", {"one": "upto"}).count() == 0


def test_positions_in_blocks_are_those_of_one_window(spark):
    """A question with a third of all rows, small ones, and some below the least size."""
    rows = [("hot", f"h{i}") for i in range(700)] + [(f"q{i % 300}", f"t{i}") for i in range(1400)] + [("two", "a"), ("two", "b")]
    df = spark.createDataFrame(rows, "qid string, tid string")
    want = {(r.qid, r.tid): (r.pos, r.n) for r in P.with_count(ranks.hashed_position(df), 3).collect()}
    got = {(r.qid, r.tid): (r.pos, r.n) for r in ranks.placed_blocks(df, 3).collect()}
    assert got == want and len(got) == 2100
    assert ranks.placed_blocks(df.limit(0), 3).count() == 0
