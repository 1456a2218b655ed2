"""Words of whole texts as numpy arrays: the shared ground of the operators that hash words.

A word is a longest run of bytes other than space and the control characters 9 to 13. UTF-8 keeps all other
characters outside these bytes, so the bytes of a text can be cut without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII characters but digits and letters part words, for texts that are compared without punctuation.
MARKS = np.zeros(256, dtype=bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some whole rows. ``doc`` counts rows from 0; ``first`` is each row's first word, with an end."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text makes a range of its own."""
    sizes = np.diff(_offsets(texts))
    ends, begin, n = np.cumsum(sizes), 0, len(sizes)
    while begin < n:
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield begin, stop
        begin = stop


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)


def bounded(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts of a column have about ``limit`` bytes together, without copying them; a longer text makes a part of its own."""
    for begin, stop in slices(plain(batch.column(column)), limit):
        yield batch.slice(begin, stop - begin)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings without nulls: a null text has no words, as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("")


def words(texts: pa.Array, begin: int = 0, stop: int | None = None, lower: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """The words of rows ``begin`` to ``stop`` of ``plain`` texts; ``lower`` folds A to Z, ``apart`` tells what parts words."""
    offsets = _offsets(texts)[begin : (len(texts) if stop is None else stop) + 1]
    data = texts.buffers()[2]
    size = int(offsets[-1] - offsets[0])
    buffer = np.zeros(size + 8, dtype=np.uint8)
    if size:
        buffer[:size] = np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1]))[int(offsets[0]) :]
    if lower:
        buffer = _LOWER[buffer]
    offsets = offsets - offsets[0]
    inside = np.zeros(size + 1, dtype=bool)
    inside[:size] = ~apart[buffer[:size]]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(size + 1, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buffer, start, end, doc, first)


def word_hashes(w: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    n = len(w.start)
    size = w.end - w.start
    h = mix(size.astype(np.uint64) + np.uint64(seed))
    eight = np.ndarray((len(w.buffer) - 7,), dtype="<u8", buffer=w.buffer.data, strides=(1,))
    at, left, rows = w.start, size, np.arange(n)
    while len(rows):
        part = eight[at] & _TAIL[np.minimum(left, 8)]
        h[rows] = mix((h[rows] ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return h


def windows(h: np.ndarray, doc: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all runs of ``size`` words that lie in one row."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value, factor = h[:n].copy(), np.uint64((seed * 2 + 0x5851F42D4C957F2D) % 2**64 | 1)
    for k in range(1, size):
        value *= factor
        value += h[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, mix(value[at])


def distinct_per_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value."""
    if not len(values):
        return values, row
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], row[new]
