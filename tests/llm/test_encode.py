import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chainsieve.llm.encode import TOKENIZERS, FragmentEncoder, certain_cuts, encode_ids
from chainsieve.llm.words import strings

ODD = [
    "", " ", "a", "don't we've  'tis 'S", "x   y\n\n z\t", "café Ünïcode é", "数学题 和 123４５", " nbsp　wide x",
    "🙂👍🏽 emoji", "$\\frac{1}{2}$ <|endoftext|>", "0" * 300, "ab'cd''ef", "\r\n\r\n", "\x00\x01", "aaaa" * 5000, "'s's 's",
]


@pytest.fixture(scope="module")
def encoder(ranks):
    return FragmentEncoder(ranks, remembered=50)


def ids_of(encoder, texts):
    ids, offsets = encoder.encode(*strings(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_same_as_the_tokenizer_library(encoder):
    whole = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    assert ids_of(encoder, ODD) == [e.ids for e in whole.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_as_whole_text(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(encoder, texts) == [encoder.encoding.encode_ordinary(t) for t in texts]


def test_cuts_lie_in_no_token(ranks):
    free = certain_cuts(ranks)
    assert free[ord("a") * 256 + ord(" ")] and not free[ord(" ") * 256 + ord("a")] and not free[ord("'") * 256 + ord("s")]


def test_column(spark, ranks, encoder):
    rows = [(1, "one two"), (2, None), (3, ""), (3, ""), (4, " \n ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("doc_id", "ids_of")
    got = sorted((r.ids_of, list(r.ids)) for r in encode_ids(df, "ids_of", "text", ranks).collect())
    assert got == sorted((k, encoder.encoding.encode_ordinary(t or "")) for k, t in rows)
    assert encode_ids(df.limit(0), "ids_of", "text", ranks).dtypes == [("ids_of", "bigint"), ("ids", "array<int>")]
    assert encode_ids(df.limit(0), "ids_of", "text", ranks).count() == 0
