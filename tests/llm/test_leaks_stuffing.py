import random

import pytest

from chainsieve.llm.leaks import Material, leaked_passages, unlocated
from chainsieve.llm.stuffing import page_evidence, page_shares, stuffed_pages

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(2500)]
STOCK = "Solve the problem step by step and put your final answer within the box at the end."


def passage(n):
    return " ".join(str(RNG.randrange(999)) if i % 9 == 0 else RNG.choice(VOCABULARY) for i in range(n))


ITEMS = [(f"i{k}", passage(60) + " costs 35.1 coins, " + passage(20) + " " + STOCK, passage(90) if k % 3 else None) for k in range(30)]


def leaks(spark, texts):
    items = spark.createDataFrame(ITEMS, "item_id string, question string, solution string")
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = leaked_passages(pages, "doc_id", "text", items, "item_id", ["question", "solution"]).collect()
    return {(r.doc_id, r.item_id) for r in found}, found


def test_leaks(spark):
    q = [i[1].split() for i in ITEMS]
    changed = list(q[3][10:45])
    changed[8], changed[20], changed[29] = "zzz", "yyy", "xxx"
    texts = [
        passage(40) + " " + ITEMS[0][1] + " " + passage(30),  # whole
        passage(40) + "\n> " + "\n> ".join(q[1][5:33]) + "\n" + passage(20),  # a part, quoted
        "<p>" + "</p>\n<p>".join(w.upper() for w in q[2][20:50]) + "</p> " + passage(30),  # tags and case
        passage(30) + " " + " ".join(changed) + " " + passage(30),  # one in ten changed
        passage(60) + " " + " ".join(q[4][:12]) + " " + passage(30),  # a few words
        passage(90) + " " + STOCK + " " + STOCK,  # the stock instruction
        passage(50) + " see i5 and i6 " + passage(50),  # naming
        None, "", "short", passage(4000) + " " + " ".join(ITEMS[7][2].split()[30:60]),  # the end of a long text
        passage(30) + " " + ITEMS[8][1].replace(".", "").replace(",", "") + passage(9),  # marks dropped
        ITEMS[9][1] + " " + ITEMS[10][1],  # two items
    ]
    got, rows = leaks(spark, texts)
    assert got == {(0, "i0"), (1, "i1"), (2, "i2"), (3, "i3"), (10, "i7"), (11, "i8"), (12, "i9"), (12, "i10")}
    row = next(r for r in rows if r.doc_id == 1)
    held = texts[1][row.start : row.stop].replace("\n> ", " ")
    assert held in ITEMS[1][1] and row.n_words >= 25 and row.part == "question"


@pytest.mark.parametrize("seed", range(4))
def test_random_windows_with_changes(seed):
    """Every window of 25 words and more with one in ten changed is found, at any place."""
    rng = random.Random(seed)
    material = Material([(i, "question", q) for i, q, _ in ITEMS])
    missed = 0
    for _ in range(100):
        item, question, _ = rng.choice(ITEMS)
        words = question.split()[:78]
        n = rng.randrange(27, 50)
        at = rng.randrange(len(words) - n + 1)
        part = words[at : at + n]
        for k in rng.sample(range(1, n - 1), n // 12):
            part[k] = "qqq"
        text = passage(30) + " " + " ".join(part) + " " + passage(30)
        missed += item not in {material.owners[p][0][0] for p, *_ in material.passages(material.numbered(unlocated(text)))}
    assert missed == 0


def test_prose_of_some_items_is_no_stock_instruction():
    prose = "it follows that we may write the quantity as"
    first = passage(40)
    texts = [(f"p{k}", "solution", f"{first if k == 0 else passage(40)} {prose} {passage(40)}") for k in range(12)]
    material = Material(texts + [(f"x{k}", "solution", passage(60)) for k in range(900)])
    words = texts[0][2].split()
    text = passage(30) + " " + " ".join(words[32:57]) + " " + passage(30)
    assert "p0" in {material.owners[n][0][0] for n, *_ in material.passages(material.numbered(unlocated(text)))}


def test_an_inner_repeat_does_not_cut_a_passage():
    refrain, tail = passage(8), passage(13)
    item = f"{passage(5)} {refrain} {passage(30)} {passage(13)} {refrain} {tail}"
    material = Material([("r", "question", item)])
    text = f"{passage(30)} {' '.join(item.split()[-34:])} {passage(30)}"
    found = material.passages(material.numbered(unlocated(text)))
    assert [m for *_, m in found] == [34]


def test_no_items(spark):
    items = spark.createDataFrame([], "item_id string, question string")
    pages = spark.createDataFrame([(1, passage(100))], "doc_id bigint, text string")
    assert leaked_passages(pages, "doc_id", "text", items, "item_id", ["question"]).count() == 0
    assert leaked_passages(pages.limit(0), "doc_id", "text", items, "item_id", ["question"]).count() == 0


PROSE = "The figure shows how halving bends a square into a cylinder. Judges rated the plain way higher than the other one. For homework, read about rates and redo the example with care.\n"
SPAM = {
    "keywords": "fractions tutor fractions tutor grade 4 fractions tutor best solver fractions tutor near me fractions tutor answer key " * 4,
    "commas": ", ".join(["Free tutor", "Best polygons quiz", "Grade 4 tutor", "Inequalities", "Answer key"] * 12),
    "hashtags": "\n".join(f"#{a}{b}" for a in ("Best", "Free", "Top", "New") for b in ("Solver", "Tutor", "Quiz", "Course", "Angles")),
    "links": "\n".join(f"https://host{i}.example/p{i}/x?id={i}" for i in range(15)),
    "anchors": "\n".join(f'<a href="host{i}.example/p{i}">Angles quiz {i}</a>' for i in range(15)),
    "crumbs": "\n".join(f"Home > Free {a} > Circles > Grade {i} Solver" for i, a in enumerate("Help Quiz Tutor Sheet Test".split() * 3)),
    "products": "\n".join(f"Solid {a} | SKU {i}82 | {i}.54 | In stock" for i, a in enumerate("seeds wagons bolts kites lamps".split() * 3)),
    "cloud": "\n".join(f"{a} ({i * 7})" for i, a in enumerate(["Angles", "Best quiz", "Averages app", "Course Marsos", "Cubes"] * 4)),
}
FINE = {
    "prose": PROSE * 4,
    "menu": "Home | Lessons | About\n" + PROSE * 3 + "#maths #rates\nhttps://a.example/b",
    "numbers": PROSE + "\n".join("\t".join(str(i * k % 97) for k in range(1, 6)) for i in range(12)),
    "worksheet": "Worksheet on rates\n" + "".join(f"{i}) The baker sold {i * 3} jars to the friend of the miller. How many are left?\n" for i in range(9)),
    "glossary": "Glossary\n" + "".join(f"{w}: When {w} meet, beginners forget the constant {i}.\n" for i, w in enumerate(["rates", "cubes", "limits"] * 3)),
    "formula": "\n".join(f"$x_{i} = {i}^2 + \\frac{{{i}}}{{3}}$" for i in range(12)),
    "chinese": "首先把四十五个罐子卖掉，还剩下四十五个。所以答案是三十八。" * 4,
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam_is_listed(kind):
    total, linked, listed, _ = page_evidence(SPAM[kind] + "\n" + PROSE)
    assert linked + listed > 0.42 * total


@pytest.mark.parametrize("kind", FINE)
def test_fine_pages_are_not(kind):
    total, linked, listed, _ = page_evidence(FINE[kind])
    assert linked + listed < 0.3 * total


def test_pages(spark):
    texts = [*SPAM.values(), *SPAM.values(), *FINE.values(), None, "", "  ", "word"]
    rows = [(i, t, f"https://h{i}.example/a" if i % 3 else None, f"h{i}.example" if i % 5 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, url string, source string")
    got = {r.doc_id for r in stuffed_pages(df, "doc_id", "text", "url", "source").collect()}
    assert set(range(2 * len(SPAM))) <= got and not got & set(range(2 * len(SPAM), 2 * len(SPAM) + len(FINE) + 3))
    assert all(0 <= r.stuffed_share <= r.listed_share + 1e-9 for r in page_shares(df, "doc_id", "text", "url", "source").collect())
    assert stuffed_pages(df.limit(0), "doc_id", "text", "url", "source").count() == 0


def test_one_text_under_many_items_leaks_for_all_of_them(spark):
    text = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([(f"i{k}", text, None) for k in range(7)], "item_id string, question string, solution string")
    pages = spark.createDataFrame([(1, "before it " + text + " after it"), (2, "nothing of that")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_passages(pages, "doc_id", "text", items, "item_id", ["question", "solution"]).collect()}
    assert got == {(1, f"i{k}") for k in range(7)}


def test_more_items_than_one_automaton_holds(spark, monkeypatch):
    monkeypatch.setattr("chainsieve.llm.leaks.MOST_ITEMS", 3)
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(8)]
    items = spark.createDataFrame([(f"i{k}", t, None) for k, t in enumerate(texts)], "item_id string, question string, solution string")
    pages = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_passages(pages, "doc_id", "text", items, "item_id", ["question", "solution"]).collect()}
    assert got == {(k, f"i{k}") for k in range(8)}


def test_doorway_entries_are_confirmed_by_other_hosts_only(spark):
    rng = __import__("random").Random(1)
    things = ["Angles course for kids", "Cubes in", "Cheat sheet for", "Near me worksheets in", "Tutor with answers in"]
    place = ["Gorth Cross", "Tamir Bay", "Ulnex Ford"]
    page = lambda: "\n".join(f"{rng.choice(things)} {rng.choice(place)}" for _ in range(30))
    prose = "\n".join(
        [
            "Katten sover under bordet medan regnet faller mot rutan", "Min granne köpte tre gamla stolar igår kväll",
            "Barnen räknade äpplena innan bussen kom", "Läraren skrev svaret längst ner till höger",
            "Ingen visste varför klockan stannat", "Sommaren efter flyttade hela familjen norrut",
        ]
    )
    rows = [(1, page(), "http://a.test/x", "s"), (2, page(), "http://b.test/x", "s"), (3, prose, "http://c.test/x", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string, source string")
    assert {r.doc_id for r in stuffed_pages(df, "doc_id", "text", "url", "source").collect()} == {1, 2}
