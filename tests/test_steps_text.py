import itertools
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainsieve.functions import steps, text


def parts(text_, ends):
    return [text_[a:b] for a, b in zip([0, *ends], ends)]


def test_rules_cut_where_they_say():
    t = "Add 14 and 6.5 to it. Halve that!\nNow stop\n \n\nOver there it ends? Yes, quite."
    assert parts(t, steps.rule_ends(t, "sentence")) == ["Add 14 and 6.5 to it.", " Halve that!\n", "Now stop\n", " \n\nOver there it ends?", " Yes, quite."]
    assert parts(t, steps.rule_ends(t, "line")) == ["Add 14 and 6.5 to it. Halve that!\n", "Now stop\n", " \n\nOver there it ends? Yes, quite."]
    assert parts(t, steps.rule_ends(t, "paragraph")) == ["Add 14 and 6.5 to it. Halve that!\nNow stop\n \n\n", "Over there it ends? Yes, quite."]
    assert steps.rule_ends("", "line") == []
    assert len(steps.rule_ends("7) Take the larger half. Then rest.", "sentence")) == 2


@given(st.text(alphabet="ab .\n!", max_size=60))
def test_ends_cover_and_hold_enough(t):
    for rule in steps.RULES:
        ends = steps.rule_ends(t, rule)
        assert steps.covers(ends, len(t)) == bool(t)
        if len(ends) > 1:
            assert all(sum(not c.isspace() for c in p) >= steps.LEAST for p in parts(t, ends))


def test_paragraphs_come_before_lines():
    both = "first of all\nsecond line\n\nthen the rest"
    assert steps.first_rule(both) == ([26, len(both)], "paragraph")
    assert steps.first_rule("first of all\nsecond line")[1] == "line"
    assert steps.first_rule("One goes here. Two goes there.")[1] == "sentence"
    assert steps.first_rule("just one piece") == ([14], "sentence")


@pytest.mark.parametrize("opener", ["4. ", "(b) ", "iv) ", "**Step 12:** ", "Case 3. ", "+ ", "> ", "— ", "### ", "__2.__ ", "PART 6: "])
def test_openers_stay_with_their_line(opener):
    t = f"Some words before it\n{opener}what it opens"
    cut = len(t) - len("what it opens")
    assert steps.place_of(t, cut) == "marker" and steps.place_of(t, 21) == "line" and steps.place_of(t, 8) == "mid"
    assert parts(t, steps.tidied(t, [cut, len(t)])) == ["Some words before it\n", f"{opener}what it opens"]


def test_tokens_go_to_the_step_they_begin_in():
    assert steps.token_steps([0, 3, 7, 9, 15], [4, 8, 9, 20]) == [(0, 2), (2, 3), (3, 5)]
    assert steps.token_steps([], [4]) == []
    spans = steps.token_steps(list(range(0, 90, 10)), [10, 20, 35, 50, 61, 90])
    items = steps.local_items(spans, 2)
    assert [s for _, s, _ in items] == [a for a, _ in spans] and items[0][0] == items[2][0] == 0 and items[4][0] == spans[2][0]


def planted(seed):
    """A text of groups of sentences, and what a careful model gives back of it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    groups = [[" ".join(word() for _ in range(rng.randrange(3, 9))) + "." for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(2, 7))]
    return "\n".join(" ".join(g) for g in groups), groups


@pytest.mark.parametrize("seed", range(8))
def test_groups_find_their_place(seed):
    t, groups = planted(seed)
    want = list(itertools.accumulate(len(" ".join(g)) + 1 for g in groups))
    want[-1] -= 1
    raw = "Here it is:\n" + json.dumps({f"group{i}": g for i, g in enumerate(groups, 1)})
    readings, how = steps.read_groups(raw)
    assert readings[0] == groups and how == "json"
    assert steps.aligned(t, readings)["ends"] == want
    bold = [["**" + s.replace(" ", "  ").upper() for s in g] for g in groups]
    assert steps.aligned(t, [bold])["ends"] == want and steps.aligned(t, [bold])["missed"] == 0
    assert steps.final_steps(t, raw) == (want, "model")
    cut, how = steps.read_groups(raw[:-3])
    assert cut[0] == groups and how == "salvaged" and steps.final_steps(t, raw[:-3]) == (want, "salvaged")
    assert steps.final_steps(t, raw[: len(raw) // 3])[1].startswith("fallback") or len(groups) == 1
    assert steps.final_steps(t, None) == (steps.first_rule(t)[0], "fallback_" + steps.first_rule(t)[1])


def test_commands_in_groups_have_two_readings():
    readings, how = steps.read_groups('{"group1": ["so \\frac{1}{2} holds"], "group 2": ["and \\sin x \\le 1"]}')
    assert how == "json" and any("\\frac" in g[0][0] for g in readings) and all("\\sin" in g[1][0] for g in readings)
    assert steps.read_groups("nothing") == ([], "none") and steps.read_groups(None) == ([], "none")
    with pytest.raises(ValueError):
        steps.final_steps("changed", None, "0" * 32)


def test_step_columns_take_nulls(spark):
    df = spark.createDataFrame([("abcd efgh.\nijkl mnop.",), (None,), ("",)], "t string")
    rows = df.select(steps.fallback_col("t").alias("s")).collect()
    assert [list(r.s.ends) for r in rows] == [[11, 21], [], []] and rows[0].s.rule == "line"


def test_every_eaten_command_is_restored(spark):
    spoilt = [(f"x {c}{rest} 3", f"x \\{letter}{rest} 3") for c, (letter, rests) in text.EATEN.items() for rest in rests.split()]
    spoilt += [("tab\there", "tab\there"), ("x\times", "x\\times"), (None, None)]
    df = spark.createDataFrame(spoilt, "bad string, good string")
    assert df.where(~text.repair_latex(F.col("bad")).eqNullSafe(F.col("good"))).count() == 0


def test_features(spark):
    df = spark.createDataFrame(
        [("We Check the result, then verify it. Therefore since perhaps might check.",), ("checking checked verifies",), ("",), (None,)],
        "t string",
    )
    f = text.features(F.col("t"))
    rows = df.select(*[c.alias(n) for n, c in f.items()]).collect()
    assert tuple(rows[0]) == (12, 3 / 12, 2 / 12, 2 / 12)
    assert tuple(rows[1]) == (3, 0, 0, 0) and tuple(rows[2]) == (0, 0, 0, 0) == tuple(rows[3])


def test_plain_functions(spark):
    df = spark.createDataFrame([("  A \n b c ", "Level 5", "x #### 1,234 ", "27.0", "x\times 3")], "a string, b string, c string, d string, e string")
    row = df.select(
        text.norm(F.col("a")), text.parse_level(F.col("b")), text.gsm_gold(F.col("c")), text.clean_gold(F.col("d")), text.repair_latex(F.col("e"))
    ).first()
    assert tuple(row) == ("a b c", 5, "1234", "27", "x\\times 3")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"overall_score": 0.8}', (0.8, "json")),
        ('```json\n{"overall_score": "0.4"}\n```', (0.4, "json")),
        ('Sure: {"overall_score": 0.5, "overall_reason": "\\left( a"} end', (0.5, "json")),
        ('{"overall_score": 0.7, "overall_reason": "cut', (0.7, "regex_overall")),
        ('{"a": {"score": 0.8}, "b": {"score": 0.6}, "c": {"score": 1.0}, "d', (0.8, "mean_of_3_dimensions")),
        ('{"a": {"score": 0.8}, "d', (None, None)),
        ('{"overall_score": 7}', (None, None)),
        ("", (None, None)),
        (None, (None, None)),
    ],
)
def test_judge(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    got = df.select(text.judge_score(F.col("r")).alias("j")).first().j
    assert got.how == want[1] and (got.score is None if want[0] is None else abs(got.score - want[0]) < 1e-9)


def test_repeat_share(spark):
    df = spark.createDataFrame([("abcdefghijkl\n" * 4,), ("abcdefghijkl\nabcdefghijkl",)], "t string")
    assert [r[0] for r in df.select(text.repeat_share(F.col("t"))).collect()] == [0.75, 0.0]
