import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainsieve.llm import bagminhash as B
from chainsieve.llm.components import connected_components
from chainsieve.llm.crosssplit import cross_split, exact_overlap
from chainsieve.llm.varied import varied_subset
from chainsieve.llm.words import words


def texts(seed=0, families=12, size=6):
    """Families of reworked texts: words changed, left out, added, sentences reordered, case and marks changed."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice("the of a to in".split()) for _ in range(90)]
        for v in range(size):
            new = [w for w in base if rng.random() > 0.04]
            for _ in range(rng.randrange(4)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            cut = rng.randrange(len(new))
            text = " ".join(new[cut:] + new[:cut])
            rows.append((f"f{f}v{v}", text.upper() + "!" if v % 2 else text.replace(" ", ", ", 3)))
    return rows


def brute(rows, agree=B.AGREE):
    bags = [(k, Counter(words(t or ""))) for k, t in rows]
    found = set()
    for i, (a, x) in enumerate(bags):
        for b, y in bags[i + 1 :]:
            if a != b and (x & y).total() and (x & y).total() >= agree * max(x.total(), y.total()):
                found.add((min(a, b), max(a, b)))
    return found


def test_signature_estimates_weighted_jaccard():
    a, b = "x " * 6 + "y " * 3 + "z u v", "x " * 3 + "y " * 6 + "z u w"
    row, element = B.bags([a, b, a])
    s = B.signatures(row, element, 3, 4000)
    x, y = Counter(words(a)), Counter(words(b))
    assert (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - (x & y).total() / (x | y).total()) < 0.03


def test_pairs_against_all_pairs(spark):
    rows = texts()
    rows += [("copy", rows[0][1]), rows[1], ("null", None), ("none", ""), ("marks", "?!"), ("one", "word"), ("two", "Word."), (None, "word")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("node", F.lit(1))
    got = [tuple(r) for r in B.near_duplicate_pairs(df, "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute([r for r in rows if r[0]])
    assert B.near_duplicate_pairs(df.limit(0), "id", "text").count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 8)
    rows = texts(3, families=2, size=40)
    got = {tuple(r) for r in B.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got == brute(rows)


def entries(texts, parts=3, turn=0, collapse=True):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["node", "text"])
    (out,) = B._entries(parts, B.BANDS, B.ROWS, turn, collapse)([batch])
    return [(r["part"], r["kind"], r["blob"]) for r in out.to_pylist()]


def test_hot_bucket_leaves_a_batch_as_one_row():
    rows = entries(["one and the same text of eight words"] * 500)
    assert sum(len(np.frombuffer(b, B.ENTRY)) for _, k, b in rows if k == 0) == B.BANDS
    assert sum(len(np.frombuffer(b, B.TIE)) for _, k, b in rows if k == 1) == 499


def lone_pairs(rng, n, agree, size=100):
    """``n`` pairs of equally long texts that agree to exactly ``agree``, with no third text alike."""
    for i in range(n):
        base = [f"x{rng.randrange(10**9)}" for _ in range(size)]
        kept = round(agree * size)
        other = base[:kept] + [f"x{rng.randrange(10**9)}" for _ in range(size - kept)]
        rng.shuffle(other)
        yield i, " ".join(base), " ".join(other)


def test_lone_pairs_at_three_quarters_are_found(spark):
    rows, want = [], set()
    for i, base, other in lone_pairs(random.Random(5), 300, 0.75):
        rows += [(f"a{i}", base), (f"b{i}", other)]
        want.add((f"a{i}", f"b{i}"))
    got = {tuple(r) for r in B.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize(("agree", "least"), [(0.75, 0.98), (0.78, 0.99), (0.80, 0.995)])
def test_lone_pairs_across_splits_are_found(spark, agree, least):
    found = list(lone_pairs(random.Random(int(agree * 100)), 300, agree))
    left = spark.createDataFrame([(f"e{i}", a) for i, a, _ in found], "e string, q string")
    right = spark.createDataFrame([(f"t{i}", b) for i, _, b in found], "t string, q string")
    got = {(r.e, r.t) for r in cross_split(left, right, "q", (["e"], ["t"])).collect()}
    want = {(f"e{i}", f"t{i}") for i, _, _ in found}
    assert got <= want and len(got) >= least * len(want)


def test_full_buckets_are_compared_completely():
    rng = np.random.default_rng(3)
    entry = np.zeros(60, B.ENTRY)
    entry["node"] = np.arange(60)
    entry["bits"] = rng.integers(0, 2**63, entry["bits"].shape)
    entry["bits"][-3] = entry["bits"][2]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0], pa.int32()), pa.array([0], pa.int8()), pa.array([entry.tobytes()])], names=["part", "kind", "blob"]
    )
    (out,) = B._links(False)([batch])
    assert list(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == [(57, 2)]
    (across,) = B._links(True)([batch])
    assert list(zip(across.column(0).to_pylist(), across.column(1).to_pylist())) == [(57, 2)]


def test_classes(spark):
    rows = texts(1, 3, 4) + [("lone", "entirely different words here")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: (r.class_id, r.n_links) for r in B.near_duplicate_classes(df, "id", "text").collect()}
    links = brute(rows)
    assert got["lone"] == ("lone", 0) and len(got) == len(rows)
    assert all(n == sum(k in p for p in links) for k, (_, n) in got.items())
    assert all(got[a][0] == got[b][0] for a, b in links)


def test_components(spark):
    rng = random.Random(2)
    links = [(i + 1, i) for i in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [tuple(sorted(rng.sample(range(200, 240), 2), reverse=True)) for _ in range(25)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.grp for r in connected_components(spark, spark.createDataFrame(links, "a bigint, b bigint").distinct()).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_cross_split(spark):
    rows = texts(7, 6, 4)
    left = spark.createDataFrame([(k, "b1", t) for k, t in rows[::2]] + [("n", "b1", None), ("e", None, "")], "e string, b string, q string")
    right = spark.createDataFrame([(k, "s1", t) for k, t in rows[1::2]] + [("same", "s2", rows[0][1].lower()), ("n2", "s1", None)], "t string, s string, q string")
    got = {(r.e, r.t) for r in cross_split(left, right, "q", (["e", "b"], ["t", "s"])).collect()}
    pairs = brute([("e|" + k, t) for k, t in rows[::2]] + [("t|" + k, t) for k, t in rows[1::2]] + [("t|same", rows[0][1])])
    assert got == {(a[2:], b[2:]) for a, b in pairs if a[0] == "e" and b[0] == "t"}
    exact = exact_overlap(left, right, "q", (["e", "b"], ["t", "s"])).collect()
    assert [(r.e, r.t) for r in exact] == [(rows[0][0], "same")]
    assert cross_split(left.limit(0), right, "q", (["e"], ["t"])).count() == 0


@pytest.mark.parametrize("share", [0.05, 0.3, 1.0])
def test_varied_subset(spark, share):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        hot = i % 3 == 0
        text = "Step 1. 123 of 456" if hot and i % 2 else " ".join(str(rng.randrange(10**5)) for _ in range(rng.randrange(1, 200)))
        rows.append((f"t{i}", "hot" if hot else f"q{i % 50}", rng.choice(["a", "b", None]), text))
    rows += rows[:20] + [("n", "q", "a", None), ("b", "q", "a", " "), (None, "q", "a", "x"), ("m", None, "a", "x")]
    df = spark.createDataFrame(rows, "tid string, qid string, teacher string, text string")
    got = varied_subset(df, share).collect()
    assert len(got) == len({r.tid for r in got}) == -(-400 * share // 1)
    if share < 0.2:
        assert sum(r.qid == "hot" for r in got) < len(got) / 4
        assert len({r.cell for r in got}) == len(got)
    assert varied_subset(df.limit(0), share).count() == 0
