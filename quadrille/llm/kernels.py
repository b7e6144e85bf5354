"""Vectorised byte kernels over Arrow string columns: words and their hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8
equals the same rule on code points. Hashes are 64-bit: random byte weights
times powers of an odd number, summed by prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_R = 0x9E3779B97F4A7C13  # 3 mod 8: powers differ early in their low bits
_MASK = (1 << 64) - 1


def _weights(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, _MASK, 256, np.uint64, endpoint=True)


_EXACT = _weights(11)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out, out=out)


_POW, _INV = _powers(_R, PIECE + 1), _powers(pow(_R, -1, 1 << 64), PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of some texts: document d has words first[d]:first[d+1]."""

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and ends; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """Find and hash the words of all rows. A-Z count as a-z if `lower`."""
    n = len(data)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[(at > 0) & (at < n)]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    weights = _LOWER if lower else _EXACT
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        if ends[j - 1] - low > PIECE:  # one word longer than a piece
            hashes[i] = _long_word(data[low : ends[i]], weights)
            i += 1
            continue
        span = ends[j - 1] - low
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum(weights[data[low : low + span]] * _POW[:span], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        hashes[i:j] = (sums[b] - sums[a]) * _INV[a]
        i = j
    return Words(np.searchsorted(starts, at), mix(hashes), starts, ends)


def _long_word(part: np.ndarray, weights: np.ndarray) -> np.uint64:
    total = 0
    for k in range(0, len(part), PIECE):
        x = part[k : k + PIECE]
        total += int(np.sum(weights[x] * _POW[: len(x)], dtype=np.uint64)) * pow(_R, k, 1 << 64)
    return np.uint64(total & _MASK)


def windows(hashes: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hash of each k consecutive words; those that cross rows are for the caller to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = ((salt * 0x2545F4914F6CDD1D) & ~7 & _MASK) | 5
    if k <= 8:
        out, c = np.zeros(n, np.uint64), 1
        for j in range(k):
            out += hashes[j : j + n] * np.uint64(c)
            c = c * base & _MASK
        return mix(out)
    out = np.empty(n, np.uint64)
    for low in range(0, n, PIECE // 2):
        part = hashes[low : min(low + PIECE // 2 + k - 1, len(hashes))]
        up, down = _powers(base, len(part)), _powers(pow(base, -1, 1 << 64), len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=sums[1:])
        m = len(part) - k + 1
        out[low : low + m] = (sums[k:] - sums[:m]) * down[:m]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of the batches, of about `size` text bytes, or one longer text, each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving free memory back to the system at its end: a worker is kept for later tasks, beside which it would hold its largest size."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped
