"""Vectorised word scanning over Arrow string columns, shared by the operators that run numpy in tasks.

Words are maximal runs of bytes that are not separators.  A word's 64-bit hash is a polynomial over
the byte values (one prefix sum for all words of a batch) followed by a bit mixer, so no Python loop
runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text bytes handled at once; bounds the numpy temporaries of a task


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, kept and doubled on demand."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)]))
        _POWERS[base] = have
    return have[:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# letters, digits and all bytes of non-ASCII characters form words
PUNCTUATED = np.ones(256, dtype=bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Words:
    """Words of a batch of texts, in order.  ``doc`` is the row within the batch."""

    data: np.ndarray
    offsets: np.ndarray  # of the rows in data
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            sums = np.cumsum(_BYTE[self.data] * _powers(_BASE, len(self.data)))
            before = np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
            value = (sums[self.end - 1] - before) * _powers(_BASE_INVERSE, len(self.data))[self.start]
            return _mixed(value + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def lines(self) -> np.ndarray:
        """Number of newlines before each word in the batch."""
        return np.searchsorted(np.flatnonzero(self.data == 10), self.start)


def scan(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Words of all texts; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True  # a row starts here
    if len(data):
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    else:
        start = end = np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, start, end, doc)


IDLE: list[Callable[[], None]] = []  # called between slices to drop what a worker no longer uses


def _trimmer():
    """glibc's malloc_trim where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


_trim = _trimmer()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks and keep it otherwise."""
    for forget in IDLE:
        forget()
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch holding about ``limit`` bytes of text, one row at least."""
    sizes = np.array(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))
            release()


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and their rows.

    A row of 1 to k - 1 words has its whole sequence as its one shingle.
    """
    count = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        total = np.zeros(len(word), dtype=np.uint64)
        for j in range(k):
            part = np.zeros(len(word), dtype=np.uint64)
            part[: len(word) - j] = word[j:] if j else word
            there = np.arange(len(word)) + j < (begin + count)[doc]
            total += np.where(there, part * _powers(_BASE, k + 1)[j + 1], np.uint64(0))
        total = _mixed(total)
    place = np.arange(len(word)) - begin[doc]
    full = (place + k <= count[doc]) | ((place == 0) & (count[doc] < k))
    return total[full], doc[full]
