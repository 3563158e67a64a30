"""Vectorised word segmentation and hashing over Arrow text columns.

Whole batches are cut into words with NumPy, never with a Python loop over words. Word hashes
are 64-bit and depend on the word's bytes only, so they agree between workers and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_LONG_WORD = 256


def _lut(is_word) -> np.ndarray:
    """Byte -> its ASCII-lower-cased byte if it belongs to a word, else 0."""
    out = np.zeros(256, np.uint8)
    for b in range(1, 256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        if is_word(low):
            out[b] = low
    return out


#: Words of `[^\x20\x09-\x0D]+`. The byte 0 is a word byte there and is stored as 1 with a flag below.
BLANK_SEPARATED = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and everything beyond ASCII.
ALPHANUMERIC = _lut(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator, element-wise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``units[start:end]`` for each span; ``units`` is uint8 or uint16."""
    if not len(starts):
        return np.zeros(0, U64)
    per = 8 // units.itemsize
    padded = np.concatenate([units, np.zeros(per, units.dtype)])
    words = np.ndarray(len(units) + 1, U64, padded, strides=(units.itemsize,))
    lengths = ends - starts
    masks = np.array([(1 << (8 * units.itemsize * k)) - 1 for k in range(per)] + [2**64 - 1], U64)
    out = mix(lengths.astype(U64) * U64(0x9E3779B97F4A7C15) ^ (words[starts] & masks[np.minimum(lengths, per)]))
    left = np.flatnonzero(lengths > per)
    at = per
    while len(left):
        n = lengths[left]
        if at >= _LONG_WORD:
            for i in left.tolist():
                out[i] = xxhash.xxh3_64_intdigest(units[starts[i] : ends[i]].tobytes())
            break
        out[left] = mix(out[left] * U64(0xD6E8FEB86659FD93) ^ (words[starts[left] + at] & masks[np.minimum(n - at, per)]))
        at += per
        left = left[n > at]
    return out


def text_slices(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into (first row, end row, bytes, offsets) of about ``max_bytes``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """Words of a slice of texts: ``starts`` and ``ends`` in bytes, ``first`` the first word of each text (and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> None:
        self.lower = lut[data]
        if lut is BLANK_SEPARATED and len(data) and not data.all():
            self.lower[data == 0] = 0xFF  # U+0000 is a word character here; 0xFF never occurs in UTF-8
        n = len(data)
        inside = self.lower != 0
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.lower, self.starts, self.ends)

    def words(self, a: int, b: int) -> list[bytes]:
        """The lower-cased words ``a`` to ``b`` (exclusive)."""
        raw = self.lower.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def shingle_sets(words: Words, n_texts: int, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words.

    A text of fewer words, but not none, has its whole word sequence as the only shingle; a text
    without words has the empty set.
    """
    h = words.hashes()
    full = np.zeros(0, U64)
    if len(h) >= size:
        full = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            full = full * U64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        full = mix(full)
    first = words.first.tolist()
    for i in range(n_texts):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            acc = U64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    acc = acc * U64(0xD6E8FEB86659FD93) + x
            yield mix(np.array([acc], U64))
        else:
            yield full[:0]


def set_id(hashes: np.ndarray) -> int:
    """An order-free signed 64-bit identity of a set of hashes."""
    with np.errstate(over="ignore"):
        total = mix(hashes ^ U64(0xA0761D6478BD642F)).sum(dtype=U64) + U64(len(hashes)) * U64(0xE7037ED1A0B428DB)
        return int(mix(np.array([total], U64)).view(np.int64)[0])
