"""Held-out passages inside a corpus, by one automaton over all test material."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage that makes a leak, and the share of it that may differ.
PASSAGE, CHANGED = 25, 0.12
#: Matched words that make a leak (the ends of a passage may be cut within a word), and
#: patterns that must be found before a passage is aligned.
MATCHED, FOUND = 19, 2
#: Words of a pattern and distance of two patterns.  A passage of 25 words with three
#: of them changed has six words in a row unchanged, which hold a whole pattern or two.
PATTERN, STRIDE = 4, 2
#: Words that may be changed, added or left out in one place of a passage.
DRIFT = 5
#: A pattern that stands in more texts of test material than this is lengthened word by
#: word, to ``STOCK`` words at most.
COMMON, STOCK = 4, 8
#: A run of ``STOCK`` words that stands in more than this share of the texts is a stock
#: instruction and tells nothing.
STOCK_SHARE = 0.02
#: Most test items of one automaton, which every worker holds; more items are scanned for in passes.
MOST_ITEMS = 200_000

# A point or comma within a number is passed over, so numbers read alike without it.
_WORD = re.compile(r"[^\W_]+(?:(?<=\d)[.,](?=\d)[^\W_]+)*")
_RUN = re.compile(r"[^\W_]+")
_POINT = re.compile(r"(?<=\d)[.,](?=\d)")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
# A line feed written as backslash and n, as in quoted strings; not the first letter of a formula's command.
_ESCAPED = re.compile(r"\\[nr](?=\\[nr]|[^a-z]|$)")


def _without_tags(text: str) -> str:
    """The text with tags and written-out line feeds blanked, every character in its place."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    return _ESCAPED.sub("  ", text) if "\\n" in text or "\\r" in text else text


def unlocated(text: str) -> list[str]:
    """The lower-cased words of ``text``; markup tags are passed over."""
    return _RUN.findall(_POINT.sub("", _without_tags(text).lower()))


def located(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words and where each stands in ``text``."""
    found = list(_WORD.finditer(_without_tags(text)))
    return [m.group().lower().replace(".", "").replace(",", "") for m in found], [m.span() for m in found]


def plain_words(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """How many runs of letters and digits each located word is."""
    return [1 + sum(c in ".," for c in text[a:b]) for a, b in spans]


class Material:
    """The automaton over the word runs of all test texts, and what aligns a hit with its item."""

    def __init__(self, items: list[tuple[str, str, str | None]]):
        import ahocorasick

        self.numbers: dict[str, int] = {}
        self.owners: list[list[tuple[str, str]]] = []
        self.parts: list[list[int]] = []
        self.weights: list[list[int]] = []
        known: dict[tuple[str, ...], int] = {}
        for item, part, text in items:
            found, spans = located(text or "")
            weight = plain_words(text or "", spans)
            if sum(weight) >= PASSAGE - int(PASSAGE * CHANGED):
                # One text under several ids is one text with several owners, not a stock phrase.
                if (at := known.setdefault(tuple(found), len(self.parts))) < len(self.parts):
                    self.owners[at].append((item, part))
                    continue
                self.owners.append([(item, part)])
                self.parts.append([self.numbers.setdefault(w, len(self.numbers) + 1) for w in found])
                self.weights.append(weight)
        spread: list[Counter] = []
        for width in range(PATTERN, STOCK + 1):
            seen: Counter = Counter()
            for numbers in self.parts:
                seen.update({tuple(numbers[k : k + width]) for k in range(len(numbers) - width + 1)})
            spread.append(Counter({run: n for run, n in seen.items() if n > COMMON}))
        least = max(COMMON, STOCK_SHARE * len(self.parts))
        stock = {run for run, n in spread[-1].items() if n > least}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for n, runs in enumerate(self.parts):
            for k in range(len(runs) - STOCK + 1):
                if tuple(runs[k : k + STOCK]) in stock:
                    self.weights[n][k : k + STOCK] = [0] * STOCK
            for k in range(0, len(runs) - PATTERN + 1, STRIDE):
                for width in range(PATTERN, STOCK + 1):
                    run = tuple(runs[k : k + width])
                    common = stock if width == STOCK else spread[width - PATTERN]
                    if len(run) == width and run not in common:
                        places[run].append((n, k))
                        break
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, at in places.items():
            self.automaton.add_word(run, [(n, k + len(run) - 1) for n, k in at])
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def numbered(self, found: list[str]) -> tuple[int, ...]:
        get = self.numbers.get
        return tuple([get(w, 0) for w in found])

    def hits(self, numbers: tuple[int, ...]) -> dict[int, list[tuple[int, int]]]:
        """Per part of an item, (place in the text, place in the part) where patterns found end."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if self.empty or len(numbers) < PATTERN:
            return found
        for end, at in self.automaton.iter(numbers):
            for n, k in at:
                found[n].append((end, k))
        return found

    def passages(self, numbers: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
        """(part, first word, last word, matched words) of every passage long enough to be a leak."""
        leaks = []
        for n, at in self.hits(numbers).items():
            if len(at) < FOUND:
                continue
            best = longest_passage(numbers, self.parts[n], self.weights[n], at)
            if best and best[3] >= MATCHED:
                leaks.append((n, best[0], best[1], best[3]))
        return leaks


def longest_passage(
    text: tuple[int, ...], part: list[int], weight: list[int], hits: list[tuple[int, int]]
) -> tuple[int, int, int, int] | None:
    """(first, last word in the text, words spanned, words matched) of the best passage.

    Every hit is extended to both sides word by word, the extensions are joined; a
    word may be changed, left out or added, as long as no more than ``CHANGED`` of
    the words of the passage and no more than ``DRIFT`` in a row differ.  ``weight`` is the number of words a
    place of the part counts for, 0 for stock words.
    """
    found: set[tuple[int, int]] = set()
    chains: list[list[tuple[int, int]]] = []
    for i, k in hits:
        if (i, k) not in found:
            chains.append(_extend(text, part, i - 1, k - 1, -1)[::-1] + _extend(text, part, i, k, 1))
            found.update(chains[-1])
    best = None
    alone = [chain for chain in chains if len(chain) < len(found)]
    for stretch in [*alone, *(s for pairs in _alignments(found) for s in _stretches(pairs))]:
        kept = _densest([p for p in stretch if weight[p[1]]])
        if not kept:
            continue
        matched = sum(weight[k] for _, k in kept)
        if best is None or matched > best[3]:
            best = (kept[0][0], kept[-1][0], sum(weight[kept[0][1] : kept[-1][1] + 1]), matched)
    return best


def _alignments(found: set[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Matched places by alignment, sorted: in each the distance of the two sides goes on in steps of at most ``DRIFT``."""
    current: list[tuple[int, int]] = []
    for i, k in sorted(found, key=lambda p: p[0] - p[1]):
        if current and (i - k) - (current[-1][0] - current[-1][1]) > DRIFT:
            yield sorted(current)
            current = []
        current.append((i, k))
    if current:
        yield sorted(current)


def _stretches(pairs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Matched places cut where the two sides drift apart; within one both only go forward."""
    current: list[tuple[int, int]] = []
    for i, k in pairs:
        if current:
            a, b = current[-1]
            if i == a or k <= b and abs((i - k) - (a - b)) <= DRIFT:
                continue
            if abs((i - k) - (a - b)) > DRIFT or i - a > DRIFT + 1:
                yield current
                current = []
        current.append((i, k))
    if current:
        yield current


def _extend(text: tuple[int, ...], part: list[int], i: int, k: int, step: int) -> list[tuple[int, int]]:
    """Matched places from (i, k) on in one direction, passing over gaps of up to two words a side."""
    out = []
    while 0 <= i < len(text) and 0 <= k < len(part):
        if text[i] == part[k]:
            out.append((i, k))
            i, k = i + step, k + step
            continue
        for a, b in _GAPS:
            x, y = i + a * step, k + b * step
            if not (0 <= x < len(text) and 0 <= y < len(part)) or text[x] != part[y]:
                continue
            x2, y2 = x + step, y + step
            if not (0 <= x2 < len(text) and 0 <= y2 < len(part)) or text[x2] == part[y2]:
                i, k = x, y
                break
        else:
            return out
    return out


# Words passed over in the text and in the item, nearest first.
_GAPS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3)]


def _densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest stretch of matched places in which no more than ``CHANGED`` of the words differ."""
    n, best = len(pairs), (0, -1)
    for lo in range(n):
        for hi in range(n - 1, lo + best[1] - best[0], -1):
            span = max(pairs[hi][0] - pairs[lo][0], pairs[hi][1] - pairs[lo][1]) + 1
            if hi - lo + 1 >= (1 - CHANGED) * span - 1e-9:
                best = (lo, hi)
                break
        if n - lo <= best[1] - best[0] + 1:
            break
    return pairs[best[0] : best[1] + 1]


SPANS = "item_id string, part string, start int, stop int, n_words int"


def leaked_passages(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, parts: list[str]) -> DataFrame:
    """``key``, item, part, character offsets in ``text`` and matched words of every leak.

    A leak is a passage of at least 25 words of one of ``parts`` of an item, in
    order, of which up to about one in ten may differ; runs of words that many
    different texts share do not count, a text that stands under several items gives
    a row for each of them.  The items go to every worker, at most ``MOST_ITEMS`` at
    a time; the corpus is scanned whole, once for each such share of the items,
    without a shuffle.  Null and empty texts hold no leak; a text that holds several
    items gives a row for each.
    """
    passes = -(-items.count() // MOST_ITEMS)
    if passes > 1:
        share = F.pmod(F.xxhash64(item), F.lit(passes))
        scans = [_scan(corpus, key, text, items.where(share == n), item, parts) for n in range(passes)]
        return reduce(DataFrame.unionByName, scans)
    return _scan(corpus, key, text, items, item, parts)


def _scan(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, parts: list[str]) -> DataFrame:
    """The leaks of items that fit into one automaton."""
    rows = items.select(item, *parts).collect()
    texts = sorted({(str(r[item]), p, r[p]) for r in rows if r[item] is not None for p in parts if r[p] is not None})
    shared = corpus.sparkSession.sparkContext.broadcast(texts)
    kind = dict(corpus.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        material = None
        for batch in batches:
            material = material or Material(shared.value)
            out: list[tuple] = []
            for value, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not words:
                    continue
                leaks = material.passages(material.numbered(unlocated(words)))
                if not leaks:
                    continue
                found, spans = located(words)
                leaks = material.passages(material.numbered(found))
                for n, first, last, matched in leaks:
                    for owner in material.owners[n]:
                        out.append((value, *owner, spans[first][0], spans[last][1], matched))
            columns = list(zip(*out)) if out else [[]] * 6
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            names = [key, "item_id", "part", "start", "stop", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return corpus.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SPANS}")
