"""Encoding of a whole corpus with a public byte-pair tokenizer.

Byte pairs that occur inside no token of the vocabulary can never be merged, so
a text may be cut there with certainty.  The fragments are encoded one by one,
each distinct fragment once per worker, and their ids concatenated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chainsieve.llm.words import strings

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"

# The pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fragments a worker remembers before it starts afresh, and the longest it remembers.
REMEMBERED, LONGEST = 400_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (one base64 token and its id a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """A 65,536-entry table: may the text be cut between byte ``i // 256`` and byte ``i % 256``?

    True where the pair lies inside no token and the pattern splits the right part
    as it does within the whole text: the left byte ends no white space (the
    pattern looks ahead there) and no apostrophe, the right byte begins a
    character and is no apostrophe (contractions begin with it).
    """
    inside = np.zeros(65536, bool)
    for token in ranks:
        raw = np.frombuffer(token, np.uint8).astype(np.int32)
        inside[raw[:-1] * 256 + raw[1:]] = True
    free = ~inside.reshape(256, 256)
    # Last bytes of Unicode white space, and the ASCII ones.
    spaces = [*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
    free[spaces, :] = False
    free[ord("'"), :] = False
    free[:, ord("'")] = False
    free[:, 0x80:0xC0] = False
    return free.reshape(-1)


class FragmentEncoder:
    """Encodes texts through their fragments, remembering fragments seen before."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cuts = certain_cuts(ranks)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.lengths: list[int] = []

    def _learn(self, fragment: bytes) -> int:
        ids = self.encoding.encode_ordinary(fragment.decode("utf-8"))
        self.ids.extend(ids)
        self.lengths.append(len(ids))
        return len(self.lengths) - 1

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows after one another, and the row offsets among them."""
        rows = len(offsets) - 1
        if not data:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if len(self.known) > self.remembered:
            self._forget()
        raw = np.frombuffer(data, np.uint8)
        pairs = raw[:-1].astype(np.uint16) * np.uint16(256) + raw[1:]
        starts = np.flatnonzero(self.cuts[pairs]) + 1
        edges = np.union1d(starts, offsets)
        known, learn, at = self.known, self._learn, []
        bounds = edges.tolist()
        for fragment in [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]:
            n = known.get(fragment)
            if n is None:
                n = learn(fragment)
                if len(fragment) <= LONGEST:
                    known[fragment] = n
            at.append(n)
        which = np.array(at, np.int64)
        lengths = np.array(self.lengths, np.int64)
        flat = np.array(self.ids, np.int32)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        counts = lengths[which]
        ends = np.cumsum(counts)
        take = np.repeat(first[which] - (ends - counts), counts) + np.arange(ends[-1])
        before = np.concatenate([[0], ends])
        return flat[take], before[np.searchsorted(edges, offsets)]


def encode_ids(df: DataFrame, key: str, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of every row: the ids of ``text``, no special tokens.

    Null and empty texts have the empty list.  Every row gives one row, repeated
    rows as often as they stand; texts of any length are encoded whole.  No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or FragmentEncoder(shared.value)
            ids, offsets = encoder.encode(*strings(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
