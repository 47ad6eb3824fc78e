import random

from chainsieve.llm.repetition import repeated_share, repetition_profile

PLAIN = (
    "Take the cone of side 65 first. Its rotation shows an area of 35. Clearly the pantry empties after 92 miles. "
    "Perhaps cancellation is knotted here, but nothing else would exceed that bound in this case."
)


def brute(words, width=4):
    """Share of words in a run of ``width`` that stands twice."""
    runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    covered = {k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(i, i + width)}
    return len(covered) / len(words)


def test_shares():
    assert repeated_share(None) == repeated_share("") == repeated_share(" \n") == repeated_share("one two") == 0
    assert repeated_share(PLAIN) < 0.1
    assert repeated_share("Let us try differencing once more. " * 9) > 0.95
    assert repeated_share("".join(f"Step {n}. Check n = {n * 7}, this does not work either. " for n in range(20))) > 0.9
    assert repeated_share("LET US try it once more now. let us TRY it once more now. ") > 0.9


def test_one_changed_word_is_still_a_copy():
    text = "so we see that the large cone of it is blue at noon and so we see that the small cone of it is blue at noon and"
    assert repeated_share(text) > 0.9


def test_text_without_spaces():
    for loop in ("-" * 600, "3" * 600, "0.142857" + "142857" * 60, "所以这道题的答案是七百二十五。方程只有一个整数解。" * 9):
        assert repeated_share("We get " + loop) > 0.9, loop[:20]


def test_half_repeated():
    a = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    words = a[:40] + a[100:160] + a[:40]
    share = repeated_share(" ".join(words))
    assert abs(share - brute(words)) < 0.02


def test_profile(spark, ranks):
    rows = [(1, PLAIN), (2, "It does not work either, so we go back. " * 12), (3, None), (4, ""), (5, "-" * 900), (6, "重复的话说了又说，" * 40)]
    df = spark.createDataFrame(rows, "gen_id bigint, text string")
    got = {r.gen_id: r for r in repetition_profile(df, ["gen_id"], "text", ranks).collect()}
    assert len(got) == 6
    assert not got[3].rejected and got[3].n_vocab_tokens == 0 and got[4].repeated_share == 0
    assert all(got[k].rejected and got[k].repeated_share > 0.9 for k in (2, 5, 6))
    assert got[1].repeated_share < 0.2 and got[1].chars_per_token > 2 and got[6].script == "other"
    assert repetition_profile(df.limit(0), ["gen_id"], "text", ranks).count() == 0


def test_no_repeated_half_passes_the_band(spark, ranks):
    """A text with little more than the least repeated share must be rejected by its entropy, so it is measured."""
    words = PLAIN.split()
    text = " ".join(words[:30] + [w[::-1] for w in words] + words[:30])
    df = spark.createDataFrame([(1, text)], "gen_id bigint, text string")
    row = repetition_profile(df, ["gen_id"], "text", ranks).first()
    assert repeated_share(text) >= 0.45 and row.rejected and row.repeated_share >= 0.45


def test_share_is_measured_on_every_row(spark, ranks):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    lone, twice = [word() for _ in range(180)], [word() for _ in range(8)]
    text = " ".join(lone[:90] + twice + lone[90:] + twice)
    row = repetition_profile(spark.createDataFrame([(1, text)], "gen_id bigint, text string"), ["gen_id"], "text", ranks).first()
    assert not row.rejected and 0.02 < row.repeated_share == repeated_share(text)


def test_marks_and_hyphens_between_copies_make_no_difference():
    passage = "seven tall ships left the old harbour at dawn today"
    for joint in ("-", ", ", " ** ", "\n\n", "--"):
        text = " ".join([passage, passage.replace(" ", joint), passage])
        assert repeated_share(text) > 0.99, joint
    assert repeated_share("ha" * 60) > 0.95 and repeated_share("首先把四十五个罐子卖掉还剩下四十五个所以答案是三十八。" * 3) > 0.9
