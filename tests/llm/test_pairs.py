import pytest

from chainsieve.llm.pairs import copy_ratio, defects, dominant, is_empty, pair_defects
from chainsieve.llm.words import words

ASK = "Every August the keeper sold 45 of the 90 plain jars and gave 7 to a friend. How many jars does the keeper still have at the end?"
SOLVED = "The keeper had 90 jars and sold 45 of them, so 45 were left.\nThen 7 were given to a friend, which leaves 38.\n"


@pytest.mark.parametrize("text", [None, "", "  \n", "N/A", "null", "-", "...", "**Solution**\n\n", "Final answer: ", r"\boxed{}", "$$ $$", "<think>\n\n</think>", "​"])
def test_empty(text):
    assert is_empty(text) and defects(ASK, text) == ["empty"]


@pytest.mark.parametrize("end", [r"\boxed{38}", "#### 38", "Answer: 38", "The answer is 38.", "Final answer: **38**", r"Hence we obtain \[\boxed{38}\]", r"The value is \(\boxed{\frac{38}{1}}\), as claimed."])
def test_proper(end):
    assert defects(ASK, SOLVED + end) == []
    assert defects(ASK, ASK + "\n" + SOLVED + end) == []
    assert defects(ASK, "Sorry, I can't count: it is not 39. " + SOLVED + end) == []
    assert defects(ASK, SOLVED + "(por cierto) " + end) == []


@pytest.mark.parametrize("cut", ["Then 7 were giv", "which leaves $90 - 45 = 4", "so the rest,", r"\begin{aligned} x &= 3", "is half of the", "7. ", "Step 4:", "0." * 90])
def test_truncated(cut):
    assert defects(ASK, SOLVED.rsplit("\n", 2)[0] + "\n" + cut) == ["truncated"]
    assert defects(ASK, r"We first note \boxed{58} as a partial count. " + SOLVED * 6 + cut) == ["truncated"]


@pytest.mark.parametrize("text", ["I'm sorry, but I can't solve this task.", "Unfortunately I cannot help with this problem for you.", "I am unable to assist with the exercise you have sent.", "As a language model, I must decline to work on the exercise.", "My guidelines don't let me respond to requests of this kind.", "I’d rather not answer this question."])
def test_refusal(text):
    assert defects(ASK, text) == ["refusal"]


@pytest.mark.parametrize("text", [ASK, ASK.upper(), f'"{ASK}"\n\nAnswer:', "User: " + ASK, ASK.replace("plain", "blue").replace("friend", "cousin"), "What is asked here? " + ASK])
def test_copy(text):
    assert defects(ASK, text) == ["copy"]
    assert copy_ratio(words(ASK), words(text)) < 0.62 < copy_ratio(words(ASK), words(SOLVED))


def test_language():
    german = "Zuerst addieren wir die Krüge und teilen sie durch zwei. Danach vergleichen wir das Ergebnis mit dem Rest.\n\\boxed{38}"
    viet = "Trước hết ta cộng số bình để được tổng. Do đó đáp số của bài toán là 38.\n\\boxed{38}"
    bare = "Truoc het ta cong so binh de duoc tong. Do do dap so cua bai toan la 38. Mat khac, so tien phai tra la 4 dong.\n\\boxed{38}"
    chinese = "首先把四十五个罐子卖掉，还剩下四十五个。所以答案是三十八。\n$\\boxed{38}$"
    for text in (german, viet, bare, chinese):
        assert defects(ASK, text) == ["language"], text
    asked = "Hai bạn chia nhau 81 chiếc ghế theo tỉ lệ 33 phần và 48 phần. Tính số ghế của mỗi người?"
    assert defects(asked, viet) == [] and defects(asked, SOLVED + "\\boxed{38}") == ["language"]
    assert defects(ASK, german[:60]) == ["language", "truncated"]
    assert dominant("12 + 30 = 42")[0] is None


def test_table(spark):
    rows = [(1, ASK, ASK), (1, ASK, ASK), (2, ASK, None), (3, None, SOLVED + "#### 38"), (4, ASK, "x " * 20_000), (5, "", "")]
    df = spark.createDataFrame(rows, "gen_id bigint, question string, text string")
    got = sorted(tuple(r) for r in pair_defects(df, "gen_id", "question", "text").collect())
    assert got == [(1, "copy"), (2, "empty"), (4, "truncated"), (5, "empty")]
    assert pair_defects(df.limit(0), "gen_id", "question", "text").count() == 0


def test_placeholders_are_empty_at_every_length():
    assert is_empty("## Answer" + "\n" * 500 + "## Solution") and is_empty("Final answer: pending\n" * 40)
    assert not is_empty("## Answer" + "\n" * 500 + "seven")


@pytest.mark.parametrize("cut", [r"Therefore the final answer is $\boxed{38", "Therefore the final answer is $\\boxed{\\", r"The answer is \(\frac{38}{1"])
def test_an_answer_that_breaks_off_is_none(cut):
    assert defects(ASK, SOLVED + cut) == ["truncated"]


def test_long_answers_and_several_copies():
    assert defects(ASK, SOLVED + r"\boxed{" + "7 + " * 300 + "7}") == []
    assert defects(ASK, (ASK + "\n") * 4) == ["copy"]
    assert defects(ASK, (ASK + "\n") * 2 + SOLVED * 3 + r"\boxed{38}") == []


def test_a_recorded_answer_at_the_end_completes(spark):
    text = SOLVED + "so what is left is exactly 38"
    assert defects(ASK, text) == ["truncated"] and defects(ASK, text, None, "38") == []
    df = spark.createDataFrame([(1, ASK, text, "38"), (2, ASK, text, None)], "gen_id bigint, question string, text string, pred string")
    assert [tuple(r) for r in pair_defects(df, "gen_id", "question", "text", "pred").collect()] == [(2, "truncated")]
