"""Pages that are heaps of keywords, links or product tags rather than sentences.

Each page is read line by line: links, hashtags, list entries, breadcrumbs and
keyword runs are told from sentences, tables of numbers and formulas.  The word
pairs of the listed lines are exploded and the hosts they stand on are counted;
a page is flagged when most of it is links and tags, or listed phrases that stand
on other hosts as well or again and again on the page itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.pairs import FUNCTION_WORDS, fold
from chainsieve.session import checkpoint_dir

#: Listed share of a page from which it counts as stuffed (pages of sentences stay below
#: a third), and the part of it that must be links or phrases that count.  A listed phrase
#: counts from so many hosts on, or so many times on one page.
STUFFED, CONFIRMED, HOSTS, TIMES = 0.42, 0.4, 2, 3
#: A phrase that makes up more than this share of all listed phrases is joined apart.
HOT = 1e-4

_LINK = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?", re.I)
_HASHTAG = re.compile(r"(?<!\S)#\w+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
_FORMULA = re.compile(r"[=\\${}^*+]|\b(?:def|return|import|for|while|if)\b.*:|\)\s*;?\s*$.*\(|\w\(\w*\)")
_COUNT = re.compile(r"\s*\(\d+\)\s*$")
_SENTENCE_END = re.compile(r"[.?!:;。！？]\W*$")
_FULL_STOP = re.compile(r"(?:([。？])|[.?])\W*$")
_TRAIL = re.compile(r"\s(?:>|»|›|::|→|/)\s.*\s(?:>|»|›|::|→|/)\s")
_SPLIT = re.compile(r"[,;|•·]+|!{2,}|\*{2,}|\s[-–—>»]\s")
#: What separates entries but no parts of a sentence.
_BARS = re.compile(r"[|•·]|\s[>»]\s")
#: A sentence that ends within the line.
_BOUNDARY = re.compile(r"[.!?。！？](?:\s|$)")
_ENGLISH = frozenset(FUNCTION_WORDS["en"].split()) | frozenset("an a all some every most these those one because about".split())
#: Words of a list entry, of a listed fragment, and share of function words a sentence exceeds.
ENTRY_WORDS, FRAGMENT_WORDS, SENTENCE = 14, 6, 0.12


def _size(text: str) -> int:
    return sum(map(len, text.split()))


def line_evidence(line: str, pairs: Counter) -> tuple[str, int, list[str]]:
    """Kind of a line, its linked characters, and the words it lists.

    ``pairs`` counts the word pairs of the page.  Kinds: ``link``, ``item``,
    ``entry`` (may be an item or a line of prose; only replication tells), ``list``,
    ``repeat``, ``number``, ``prose``.
    """
    size = _size(line)
    rest = _HASHTAG.sub(" ", _LINK.sub(" ", line)) if ("." in line or "#" in line or "/" in line) else line
    linked = size - _size(rest)
    found = _WORD.findall(rest.lower())
    if not found:
        return ("link", linked, []) if linked else ("number", 0, [])
    functional = sum(map(_ENGLISH.__contains__, found)) / len(found)
    if linked and (linked * 2 >= size or (functional < 0.15 and len(found) <= ENTRY_WORDS)):
        return "link", linked, found
    letters = sum(not w.isdigit() for w in found)
    if letters * 2 < len(found) and "|" not in rest and ">" not in rest:
        return "number", linked, []
    if len(found) <= ENTRY_WORDS:
        entry = functional < SENTENCE and not _SENTENCE_END.search(line) and not _FORMULA.search(_COUNT.sub("", line))
        if entry or rest.count("|") >= 2 or _TRAIL.search(rest):
            return "item", linked, found
        if _may_be_entry(line):
            return "entry", linked, found
    elif len(_BARS.findall(rest)) >= 4 and not _SENTENCE_END.search(line) and not _FORMULA.search(rest):
        fragments = [f for f in _BARS.split(rest) if f.strip()]
        if sum(len(f.split()) <= FRAGMENT_WORDS for f in fragments) >= 0.7 * len(fragments):
            return "list", linked, found
    stop = _FULL_STOP.search(line)
    if functional < (0.2 if stop is None else 0.05 if stop.group(1) is None else 0):
        again = [pairs[p] >= TIMES for p in zip(found, found[1:])]
        if sum(a or b for a, b in zip([*again, False], [False, *again])) * 2 > len(found):
            return "repeat", linked, found
        fragments = [f for f in _SPLIT.split(rest) if f.strip()]
        if len(fragments) >= 5 and not _FORMULA.search(rest):
            listed = sum(
                len(f.split()) <= FRAGMENT_WORDS and not any(w in _ENGLISH for w in _WORD.findall(f.lower()))
                for f in fragments
            )
            if listed >= 0.7 * len(fragments):
                return "list", linked, found
    return "prose", linked, []


def _may_be_entry(line: str) -> bool:
    """Begins like an entry, not like a wrapped line, and neither ends nor breaks off a sentence."""
    first = next((c for c in line if c.isalnum()), "")
    wrapped = first.islower() or first.isdigit()
    return not (wrapped or _SENTENCE_END.search(line) or _BOUNDARY.search(line) or _FORMULA.search(line))


def page_evidence(text: str) -> tuple[int, int, int, dict[tuple[str, ...], tuple[int, int]]]:
    """Characters, linked and listed characters of a page, and its listed phrases.

    A phrase is a pair of neighbouring listed words, or the only word of a line, with
    numbers read alike; it comes with the characters it stands for and how often it stands there.
    """
    if "<" in text:
        text = _MARKUP.sub(" ", text) if not _LINK.search("".join(_MARKUP.findall(text))) else text
    words = _WORD.findall(text.lower())
    pairs = Counter(zip(words, words[1:]))
    total, linked, listed = _size(text), 0, 0
    phrases: dict[tuple[str, ...], tuple[int, int]] = {}
    for line in text.split("\n"):
        if not line.strip():
            continue
        kind, links, found = line_evidence(line.strip(), pairs)
        linked += links
        if not found:
            continue
        rest = _size(line) - links
        listed += rest
        found = ["0" if w.isdigit() else w for w in found]
        shingles = list(zip(found, found[1:])) or [(found[0],)]
        for p in shingles:
            size, times = phrases.get(p, (0, 0))
            phrases[p] = (size + rest / len(shingles), times + (kind != "entry"))
    return total, linked, listed, phrases


EVIDENCE = "host string, n_chars bigint, linked bigint, listed bigint, phrase bigint, size double, times int"


def _explode(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value, host, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or not text.strip():
                    continue
                total, linked, listed, phrases = page_evidence(text)
                if linked + listed == 0:
                    continue
                rows.append((value, host, total, linked, listed, None, None, None))
                for p, (size, times) in phrases.items():
                    number = xxhash.xxh3_64_intdigest(fold(" ".join(p))) - (1 << 63)
                    rows.append((value, host, None, None, None, number, size, times))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [batch.schema.field(0).type, pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int32()]
            names = [key, *(c.split()[0] for c in EVIDENCE.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def page_shares(df: DataFrame, key: str, text: str, url: str, source: str) -> DataFrame:
    """``key``, ``linked_share``, ``listed_share`` and ``stuffed_share`` of every page with list evidence.

    ``listed_share`` counts all listed lines, ``stuffed_share`` the links and tags and
    those listed phrases that stand on ``HOSTS`` hosts or ``TIMES`` times on the
    page.  The host is that of ``url``, else ``source``.  Null, empty and blank
    texts, and pages without list evidence, have no row; keys are taken to be
    unique, repeated rows add nothing.
    """
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1), F.lit("")), F.col(source), F.lit(""))
    kind = dict(df.dtypes)[key]
    pages = df.select(key, host.alias("host"), F.col(text))
    checkpoint_dir(df.sparkSession)
    rows = pages.mapInArrow(_explode(key), f"`{key}` {kind}, {EVIDENCE}").checkpoint()
    heads = rows.where("phrase is null").groupBy(key).agg(
        *[F.max(c).alias(c) for c in ("n_chars", "linked", "listed")]
    )
    listed = rows.where("phrase is not null").select(key, "host", "phrase", "size", "times")
    spread = (
        listed.groupBy("phrase", "host")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("phrase")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"))
    )
    found = spread.where(F.col("hosts") >= HOSTS)
    # No more than 1 / HOT phrases can each be more than HOT of all rows.
    least = max(1.0, HOT * listed.count())
    hot = F.broadcast(found.where(F.col("n") > least).select("phrase", F.lit(True).alias("hot")))
    cold = found.where(F.col("n") <= least).select("phrase", F.lit(True).alias("cold"))
    marked = listed.join(hot, "phrase", "left")
    near = marked.where("hot or times >= %d" % TIMES).select(key, "size")
    rest = marked.where("hot is null and times < %d" % TIMES).join(cold, "phrase", "left_semi").select(key, "size")
    counted = near.unionByName(rest).groupBy(key).agg(F.sum("size").alias("counted"))
    share = lambda c: F.least(F.lit(1.0), c / F.greatest(F.col("n_chars"), F.lit(1)))
    return heads.join(counted, key, "left").select(
        key,
        share(F.col("linked")).alias("linked_share"),
        share(F.col("linked") + F.col("listed")).alias("listed_share"),
        share(F.col("linked") + F.coalesce("counted", F.lit(0.0))).alias("stuffed_share"),
    )


def stuffed_pages(df: DataFrame, key: str, text: str, url: str, source: str) -> DataFrame:
    """``key`` of the pages that are mostly lists of links, tags and phrases replicated elsewhere."""
    shares = page_shares(df, key, text, url, source)
    dense = F.col("listed_share") >= STUFFED
    return shares.where(dense & (F.col("stuffed_share") >= CONFIRMED * F.col("listed_share"))).select(key)
