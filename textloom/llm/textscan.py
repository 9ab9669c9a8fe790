"""Vectorised scans of whole text batches inside Spark tasks.

Texts stay in their Arrow buffer: words, word hashes and word windows of a batch come from a few numpy passes over its
UTF-8 bytes. A word is a run of bytes other than space and \\x09-\\x0D, which in UTF-8 is a run of code points
``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.default_rng(20_240_917).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.uint64(0xD6E8FEB86659FD93)


def byte_table(characters: str) -> np.ndarray:
    """True for the bytes of these ASCII characters."""
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode("ascii"))] = True
    return table


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """The texts of a batch as one byte array; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = n

    def count(self, table: np.ndarray) -> np.ndarray:
        """Per text, the number of bytes for which table is true."""
        return np.diff(np.searchsorted(np.flatnonzero(table[self.bytes]), self.offsets))

    def code_points(self) -> np.ndarray:
        later = np.zeros(256, dtype=bool)
        later[0x80:0xC0] = True
        return np.diff(self.offsets) - self.count(later)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word in the byte array, in order."""
        inside = ~_SPACE[self.bytes]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        bounds = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        start[bounds] = inside[bounds]
        end[bounds - 1] = inside[bounds - 1]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def word_counts(self, starts: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(starts, self.offsets, "left"))

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with lower, A-Z count as a-z."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        inner = self.bytes[~_SPACE[self.bytes]]
        place = np.arange(len(inner)) - np.repeat(first, lengths)
        codes = (_LOWER_CODES if lower else _CODES)[inner]
        codes *= powers(_STEP, int(lengths.max()))[place]
        return mix(np.add.reduceat(codes, first) + lengths.astype(np.uint64))


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window of n words within one text, and the number of windows of each text."""
    per_text = np.maximum(counts - n + 1, 0)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), per_text
    size, steps = len(hashes) - n + 1, powers(_ORDER, n + 1)[1:]
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out += hashes[i : i + size] * steps[i]
    text = np.repeat(np.arange(len(counts)), counts)
    return mix(out[text[:size] == text[n - 1 :]]), per_text


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about limit bytes of text, or one row: memory is bounded by the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cells = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
