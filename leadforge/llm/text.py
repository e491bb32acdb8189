"""Vectorised text helpers over Arrow string columns.

The operators that walk every byte of the corpus work on the buffers of an
Arrow column directly: word borders, word hashes and rolling values come from
whole-array numpy operations, a bounded number of bytes at a time.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[ord("0"):ord("9") + 1] = True
IS_WORD[ord("A"):ord("Z") + 1] = True
IS_WORD[ord("a"):ord("z") + 1] = True
IS_WORD[0x80:] = True

_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_MIX_1 = np.uint64(0x9E3779B97F4A7C15)
_MIX_2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_S29 = np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, fold, multiply, fold)."""
    x = x * _MIX_1
    x ^= x >> _S32
    x *= _MIX_2
    x ^= x >> _S29
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a run of rows: byte borders, row of each word, first word of each row."""

    lower: np.ndarray    # lower-cased bytes, zero-padded by 8
    start: np.ndarray
    end: np.ndarray
    row_first: np.ndarray  # rows + 1 entries: words of row r are row_first[r]:row_first[r + 1]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_first) - 1), np.diff(self.row_first))

    def text(self, i: int) -> str:
        return self.lower[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = IS_WORD[data]
    n = len(data)
    begins = np.empty(n, dtype=bool)
    ends = np.empty(n, dtype=bool)
    if n:
        begins[0] = inside[0]
        begins[1:] = inside[1:] & ~inside[:-1]
        ends[-1] = inside[-1]
        ends[:-1] = inside[:-1] & ~inside[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = inside[first]
        last = first[1:] - 1
        ends[last] = inside[last]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    lower = np.zeros(n + 8, dtype=np.uint8)
    lower[:n] = LOWER[data]
    return Words(lower, start, end, np.searchsorted(start, offsets, "left"))


def lanes(padded: np.ndarray) -> np.ndarray:
    """``lanes(p)[i]``: the eight bytes from ``i`` as one little-endian number."""
    return np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def hash_spans(padded: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span ``padded[start:end]`` (the array has 8 spare bytes)."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    view = lanes(padded)
    length = (end - start).astype(np.int64)
    h = mix(length.astype(np.uint64) + np.uint64(seed))
    h = mix(h ^ (view[start] & _LANE_MASK[np.minimum(length, 8)]))
    at, step = np.flatnonzero(length > 8), 8
    while len(at):
        h[at] = mix(h[at] ^ (view[start[at] + step] & _LANE_MASK[np.minimum(length[at] - step, 8)]))
        step += 8
        at = at[length[at] > step]
    return h


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    return hash_spans(w.lower, w.start, w.end, seed)


def shingle_hashes(hashes: np.ndarray, row_first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a row of fewer words has one shingle, of all it has."""
    counts = np.diff(row_first)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    tail = np.arange(n) - row_first[rows]           # place of the word in its row
    left = counts[rows] - tail                      # words from here to the row's end
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        ok = np.flatnonzero(left > k)
        value[ok] = mix(value[ok] ^ hashes[ok + k])
    keep = (left >= size) | ((tail == 0) & (counts[rows] < size))
    return value[keep], rows[keep]


def distinct_by_row(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, value) pairs; rows must come in ascending order."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], row[keep]
