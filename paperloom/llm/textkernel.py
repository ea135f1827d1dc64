"""Vectorised word fingerprints over Arrow text buffers.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z folded
to a-z, which on UTF-8 bytes equals the regular expression
``[^\\x20\\x09-\\x0D]+`` on code points.  A word's fingerprint is a 64-bit
polynomial over seeded random byte values, finished with an avalanche mix; no
Python object is made per word.  Work runs in slices of at most ``SLICE`` bytes
(longer only where one word is longer), so memory is bounded whatever the
length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)[_LOWER]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int = 0, limit: int = 2 << 20):
    """Slices of a batch with about `limit` bytes of text in `column` (one row at least)."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte positions of all words; texts never share a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _slices(starts: np.ndarray, ends: np.ndarray):
    """Index ranges of words whose bytes span at most SLICE (one word at least)."""
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right")))
        yield at, to
        at = to


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint for each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    for at, to in _slices(starts, ends):
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        h = (sums[e] - sums[s]) * down[s]
        h += (e - s).astype(np.uint64)
        out[at:to] = _mix(h)
    return out


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, first): the words of text i are fingerprints[first[i]:first[i + 1]]."""
    data, offsets = text_buffers(column)
    starts, ends = word_spans(data, offsets)
    return fingerprints(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of `width` words; a shorter text is one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out *= _BASE
        out += words[i : i + n]
    return _mix(out)
