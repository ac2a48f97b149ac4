"""Words of whole texts, hashed a batch at a time with numpy. White space is space and U+0009 to U+000D everywhere."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text hashed at once: about 60 bytes of memory are needed for each.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; NULL counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows of about ``size`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Spans:
    """Hashes of any byte ranges of rows ``offsets`` of ``data``, from running totals; ASCII letters in lower case if asked."""

    def __init__(self, data: np.ndarray, lower: bool = True):
        power, self._inverse = _powers(len(data) + 1)
        self._total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[_LOWER[data] if lower else data] * power[:-1], dtype=np.uint64, out=self._total[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[first]) * self._inverse[first])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of rows ``offsets`` (that begin at 0): row, first byte, end byte."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(offsets, first, "right") - 1, first, end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word in rows ``offsets``: 64-bit hash, row, first byte, end byte (relative to the first row's start)."""
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    row, first, end = word_spans(data, offsets)
    return Spans(data, lower)(first, end), row, first, end
