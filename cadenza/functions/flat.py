"""Lists and texts of an Arrow batch as flat NumPy arrays: what rows that hold a stream are worked on with, many at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cadenza.functions.scalars import ATTACHED

#: Text or list items that are worked on at a time, at least one row.
CHUNK = 1 << 19
#: Words of the rows of a batch in order: row, pos, word, start_ms, end_ms.
RowWords = tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]
_ATTACHED = np.zeros(256, bool)
_ATTACHED[[ord(c) for c in ATTACHED]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True  # what \s is in patterns


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most CHUNK bytes of the texts in ``column``, or one row."""
    offsets, _ = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield batch.slice(at, until - at)
        at = until


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: their text's place in ``texts``, first byte and end in the bytes of all, and each text's first byte.

    Bytes are those of ``text_buffers``.
    """
    offsets, data = text_buffers(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    spoken = ~_SPACE[data[low:high]]
    opens, closes = spoken.copy(), spoken.copy()
    opens[1:] &= ~spoken[:-1]
    closes[:-1] &= ~spoken[1:]
    edges = offsets[(offsets > low) & (offsets < high)] - low  # a text begins and ends there in any case
    opens[edges] = spoken[edges]
    closes[edges - 1] = spoken[edges - 1]
    first, end = np.flatnonzero(opens) + low, np.flatnonzero(closes) + low + 1
    return np.searchsorted(offsets, first, "right") - 1, first, end, offsets


def pieces(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts ``data[first:end]``."""
    sizes = end - first
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def items(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """The row of each item of a list of structs, then its ``fields``, whole numbers; null lists have none."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat_ = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(flat_.field(f).to_numpy(zero_copy_only=False) for f in fields)


def places(group: np.ndarray) -> np.ndarray:
    """The place of each item within its run of equal ``group``."""
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)], at, 0))


def running_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The running maximum of whole numbers within each ``group``, which does not fall."""
    if not len(values):
        return values
    low = int(values.min())
    span = int(values.max()) - low + 1
    if span * (int(group[-1]) - int(group[0]) + 1) >= 1 << 62:  # groups do not fit beside each other in 64 bits
        return np.concatenate([np.maximum.accumulate(v) for v in np.split(values, np.flatnonzero(np.diff(group)) + 1)])
    base = (group - group[0]) * span - low
    return np.maximum.accumulate(values + base) - base


@dataclass
class Marks:
    """What the rules ask of words' texts."""

    bare: np.ndarray  # one character that attaches to the word before
    quote: np.ndarray  # begins with an apostrophe
    closes: np.ndarray  # ends a sentence
    blank: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Marks:
        offsets, data = text_buffers(words)
        size = np.diff(offsets)
        data = np.concatenate([data, np.zeros(3, np.uint8)])  # the last word's bytes may be asked for beyond its end
        head = [data[offsets[:-1] + k] for k in range(3)]
        quote = (size > 0) & (head[0] == 0x27) | (size > 2) & (head[0] == 0xE2) & (head[1] == 0x80) & (head[2] == 0x99)
        closes = (size > 0) & np.isin(data[np.maximum(offsets[1:] - 1, 0)], [0x2E, 0x21, 0x3F])
        blank = (size == 0) | pc.utf8_is_space(words).fill_null(True).to_numpy(zero_copy_only=False)
        return cls((size == 1) & _ATTACHED[head[0]], quote, closes, blank, size)


def spaces(where: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(where), " ", "")


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
