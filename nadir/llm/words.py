"""Vectorised word scanning of Arrow text columns.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(space, tab to carriage return), which is ``[^\\x20\\x09-\\x0D]+`` on UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that are scanned at once; bounds the numpy temporaries of a task.
CHUNK_BYTES = 2 << 20

_LIBC = ctypes.CDLL(None)
if not hasattr(_LIBC, "malloc_trim"):  # not glibc
    _LIBC = None

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG_WORD = 64


def trim() -> None:
    """Give freed memory back to the system: workers live on and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """The batches, with freed memory given back after each."""
    for batch in batches:
        yield batch
        del batch
        trim()


def flat(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and the n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a row is never divided."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row each is in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word never crosses from one row into the next
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; no two spans of up to 8 equally many bytes share one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), shape=(len(data) + 1, 8), strides=(1, 1))
    size = ends - starts
    h = size.astype(np.uint64) * _K1
    at, left, idx = starts, size, None
    while len(at):
        part = np.ascontiguousarray(eight[at]).view("<u8").ravel() & _MASK[np.minimum(left, 8)]
        now = (h if idx is None else h[idx]) ^ part
        now = mix(now * _K1 + _K3)
        if idx is None:
            h = now
            idx = np.flatnonzero((left > 8) & (left <= _LONG_WORD))
            at, left = at[idx] + 8, left[idx] - 8
        else:
            h[idx] = now
            more = left > 8
            idx, at, left = idx[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=7)
    return h


def counts_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of 0/1 ``values`` in each range of ``offsets``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80
