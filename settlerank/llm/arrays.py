"""Words, lines and shingles of Arrow text batches as NumPy arrays of 64-bit hashes.

Everything here works on one slice of a batch at a time (``SLICE_BYTES`` of text, or one longer document), so memory
follows the slice and not the batch. Hashes are 64 bits: equal words always agree, different ones differ but for
chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PUNCTUATED = SPACE.copy()                       # blanks and ASCII punctuation part words
PUNCTUATED[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        powers, inverses = (np.full(size, x, np.uint64) for x in (_BASE, _INVERSE))
        powers[0] = inverses[0] = 1
        powers, inverses = np.cumprod(powers), np.cumprod(inverses)
        if n > SLICE_BYTES + 1:
            return powers, inverses             # of a very long text: not kept
        _powers, _inverses = powers, inverses
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], np.uint64))[0])


class Slice:
    """Some whole documents of a batch: ``first`` is the place of the first in the batch, ``n`` their number."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, lower: bool, breaks: np.ndarray):
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1
        size = len(data)
        within = ~breaks[data]
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        before = np.zeros(size + 1, bool)
        before[1:] = within
        here = np.zeros(size + 1, bool)
        here[:-1] = within
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        powers, inverses = _tables(size + 1)
        hashed = (_LOWER[data] if lower else data).astype(np.uint64)
        hashed += np.uint64(1)
        hashed *= powers[:size]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(hashed, out=sums[1:])
        self._sums, self._inverses = sums, inverses
        #: words of document i are first_word[i] .. first_word[i + 1] - 1
        self.first_word = np.searchsorted(self.starts, bounds)
        self.words = self.span_hash(self.starts, self.ends)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverses[starts] + (ends - starts).astype(np.uint64))

    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``width`` words inside one document, and the place of its first word."""
        words = self.words
        count = len(words) - width + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.full(count, width, np.uint64)
        for k in range(width):
            out = out * np.uint64(_BASE) + words[k:k + count]
            out ^= out >> np.uint64(29)
        doc = np.repeat(np.arange(self.n), self.n_words())
        inside = np.flatnonzero(doc[:count] == doc[width - 1:])
        return mix(out[inside]), inside

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each document's bytes."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def plain(column) -> pa.Array:
    """A string column of a batch without nulls and with 32-bit offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column if column.type == pa.string() else column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(column, lower: bool = False, breaks: np.ndarray = SPACE) -> Iterator[Slice]:
    column = plain(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield Slice(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at, lower, breaks)
        at = to


def parts(batches, rows: int = 2000):
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
