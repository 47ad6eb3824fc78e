"""Repeated content inside one document.

A public vocabulary first measures how each text encodes (characters per token,
byte-fallback share, entropy of tokens and of blocks of tokens); texts outside the
band of their script are marked.  The share of the text covered by passages that
stand in it more than once is measured exactly, on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chainsieve.llm.encode import FragmentEncoder
from chainsieve.llm.words import strings

#: Words of a passage; characters of a passage in text without spaces.
PASSAGE_WORDS, PASSAGE_CHARS = 4, 20
#: No word has so many letters and digits: a longer run of them is text without spaces.
UNSPACED = 40
# Letters of scripts that put no spaces between words.
_SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

# A run of letters and digits, or of so many marks that it is no separator.
_UNIT = re.compile(r"[^\W_]+|(?:[^\w\s]|_){%d,}" % UNSPACED)
_DIGITS = re.compile(r"\d+")
#: Numbers within unspaced text; a longer run of digits is text of its own.
_NUMBER = re.compile(r"(?<!\d)\d{1,19}(?!\d)")


class Passages:
    """Cuts texts into numbered units: words, or characters where there are no spaces."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers: dict[str, int] = {}

    def _number(self, unit: str) -> int:
        """The number of a word; words that differ in digits only have the same."""
        number = self.numbers.setdefault(_DIGITS.sub("0", unit), len(self.numbers) + 1)
        self.known[unit] = number
        return number

    def units(self, text: str) -> tuple[list[int], list[int], list[bool]]:
        """Number, size and 'is a character' of every unit; a word is as large as its characters and a blank."""
        if len(self.known) > 1_000_000:
            self.known.clear()
            self.numbers.clear()
        text = text.lower()
        known, number = self.known, self._number
        found = _UNIT.findall(text)
        sizes = list(map(len, found))
        plain = text.isascii() or not _SPACELESS.search(text)
        if plain and max(sizes, default=0) < UNSPACED:
            return [known.get(u) or number(u) for u in found], [n + 1 for n in sizes], [False] * len(found)
        numbers, sizes, single = [], [], []
        for run in found:
            if len(run) < UNSPACED and (plain or not _SPACELESS.search(run)):
                numbers.append(known.get(run) or number(run))
                sizes.append(len(run) + 1)
                single.append(False)
                continue
            last = 0
            for digits in _NUMBER.finditer(run):
                numbers += [-ord(c) for c in run[last : digits.start()]]
                sizes += [1] * (digits.start() - last) + [digits.end() - digits.start()]
                numbers.append(-ord("0"))
                last = digits.end()
            numbers += [-ord(c) for c in run[last:]]
            sizes += [1] * (len(run) - last)
            single += [True] * (len(numbers) - len(single))
        return numbers, sizes, single


def _covered(numbers: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Which units lie in a passage of ``width`` units that stands more than once in their own text."""
    n = len(numbers)
    mark = np.zeros(n, bool)
    if n <= width:
        return mark
    last = n - width + 1
    key = owner[:last].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + last].astype(np.uint64) + np.uint64(1)
        key ^= key >> np.uint64(29)
    whole = np.flatnonzero(owner[:last] == owner[width - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(last, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    steps = np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def repeated_shares(texts: list[str | None], passages: Passages | None = None) -> np.ndarray:
    """Share of each text that lies in passages standing more than once in it.

    Only units count, what stands between them does not.  A single unit between two
    covered ones counts as covered: a copy may differ now and then in a word.  Null,
    empty and wordless texts have share 0.
    """
    passages = passages or Passages()
    numbers: list[int] = []
    sizes: list[int] = []
    single: list[bool] = []
    counts = []
    for text in texts:
        found = passages.units(text) if text else ((), (), ())
        for gathered, part in zip((numbers, sizes, single), found):
            gathered.extend(part)
        counts.append(len(found[0]))
    number, size, char = np.array(numbers, np.int64), np.array(sizes, np.int64), np.array(single, bool)
    owner = np.repeat(np.arange(len(texts)), counts)
    mark = np.zeros(len(number), bool)
    for kind, width in ((char, PASSAGE_CHARS), (~char, PASSAGE_WORDS)):
        at = np.flatnonzero(kind)
        mark[at] = _covered(number[at], owner[at], width)
    mark[1:-1] |= ~mark[1:-1] & mark[:-2] & mark[2:] & (owner[:-2] == owner[2:])
    total = np.bincount(owner, weights=size, minlength=len(texts))
    return np.bincount(owner, weights=size * mark, minlength=len(texts)) / np.maximum(total, 1)


def repeated_share(text: str | None) -> float:
    """The same of one text."""
    return float(repeated_shares([text])[0])


#: Rejection bands by script: least block-entropy deficit and greatest characters a token.
#: Marks, spacing or changed words between copies can hide them from the tokens, so the
#: bands only mark a text.
BANDS = {"spaced": (0.2, 5.0), "other": (0.2, 2.5)}
#: Tokens of a block.
BLOCK = 3
#: Letters of scripts written without spaces or encoded byte by byte.
_OTHER = re.compile(r"[\u0370-\u1fff\u2e80-\uffdc\U00010000-\U0003ffff]")


def _deficit(row: np.ndarray, key: np.ndarray, rows: int, tokens: np.ndarray) -> np.ndarray:
    """Bits that a key of a row has less, in the mean over its tokens, than if all keys differed."""
    order = np.argsort(key)
    key, row = key[order], row[order]
    edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
    count = np.diff(edge).astype(float)
    return np.bincount(row[edge[:-1]], weights=count * np.log2(np.maximum(count, 1)), minlength=rows) / np.maximum(tokens, 1)


def fertility(ids: np.ndarray, offsets: np.ndarray, partial: np.ndarray, digits: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: tokens, token entropy in bits, block-entropy deficit and byte-fallback share.

    ``partial`` tells of each id whether the token is no whole number of characters,
    ``digits`` whether it is a number; all numbers count as one token in blocks.
    """
    rows = len(offsets) - 1
    tokens = np.diff(offsets)
    row = np.repeat(np.arange(rows), tokens)
    alone = _deficit(row, (row << 20) | ids, rows, tokens)
    masked = np.where(digits[ids], 0, ids + 1).astype(np.uint64)
    inside = row[BLOCK - 1 :] == row[: len(row) - BLOCK + 1] if len(row) >= BLOCK else np.zeros(0, bool)
    key = row[: len(inside)].astype(np.uint64)
    for k in range(BLOCK):
        key = key * np.uint64(0x9E3779B97F4A7C15) + masked[k : k + len(inside)]
        key ^= key >> np.uint64(31)
    deficit = _deficit(row[: len(inside)][inside], key[inside], rows, tokens)
    bytes_only = np.bincount(row, weights=partial[ids].astype(float), minlength=rows) / np.maximum(tokens, 1)
    entropy = np.log2(np.maximum(tokens, 1)) - alone
    return {"tokens": tokens, "entropy": entropy, "deficit": deficit, "byte_share": bytes_only}


def _partial(ranks: dict[bytes, int]) -> np.ndarray:
    broken = np.zeros(max(ranks.values()) + 2, bool)
    for token, rank in ranks.items():
        try:
            token.decode("utf-8")
        except UnicodeDecodeError:
            broken[rank] = True
    return broken


def _numbers(ranks: dict[bytes, int]) -> np.ndarray:
    digits = np.zeros(max(ranks.values()) + 2, bool)
    digits[[rank for token, rank in ranks.items() if token.strip().isdigit()]] = True
    return digits


REPEATS = (
    "n_chars int, n_vocab_tokens int, chars_per_token double, byte_share double, "
    "token_entropy double, entropy_deficit double, script string, rejected boolean, repeated_share double"
)


def repetition_profile(df: DataFrame, keys: list[str], text: str, ranks: dict[bytes, int]) -> DataFrame:
    """``keys`` and the encoding measures and repeated share of ``text`` of every row.

    ``rejected`` says that a measure lies outside the band of the text's script;
    ``repeated_share`` is measured on every row, whatever its entropy.  Null and empty texts have 0 tokens and
    share 0.  Texts are read whole; rows are independent, so nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), REPEATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = partial = digits = None
        passages = Passages()
        for batch in batches:
            if encoder is None:
                encoder, partial, digits = FragmentEncoder(shared.value), _partial(shared.value), _numbers(shared.value)
            column = batch.column(len(keys))
            ids, offsets = encoder.encode(*strings(pc.utf8_lower(column)))
            measure = fertility(ids.astype(np.int64), offsets, partial, digits)
            texts = column.to_pylist()
            length = np.array([len(t or "") for t in texts])
            per_token = length / np.maximum(measure["tokens"], 1)
            script = np.array(["other" if len(_OTHER.findall(t or "")) * 4 > len(t or "") else "spaced" for t in texts], object)
            script[length == 0] = "spaced"
            low = np.where(script == "other", BANDS["other"][0], BANDS["spaced"][0])
            high = np.where(script == "other", BANDS["other"][1], BANDS["spaced"][1])
            rejected = (measure["deficit"] >= low) | (per_token > high)
            share = repeated_shares(texts, passages)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keys)],
                    pa.array(length, pa.int32()),
                    pa.array(measure["tokens"], pa.int32()),
                    pa.array(per_token),
                    pa.array(measure["byte_share"]),
                    pa.array(measure["entropy"]),
                    pa.array(measure["deficit"]),
                    pa.array(script, pa.string()),
                    pa.array(rejected),
                    pa.array(share),
                ],
                names=[*keys, *(c.split()[0] for c in REPEATS.split(", "))],
            )

    return df.select(*keys, text).mapInArrow(run, schema)
