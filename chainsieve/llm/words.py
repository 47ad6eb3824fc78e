"""What a word is, for every operator here: a run of letters and digits, case ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Runs of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The lower-cased words of ``text``, in order."""
    return WORD.findall(text.lower())


def strings(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of a string column, all rows after one another, and the row offsets.

    Nulls become empty strings.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0 or column.buffers()[2] is None:
        return b"", np.zeros(len(column) + 1, np.int64)
    data = column.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
