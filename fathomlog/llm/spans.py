"""Vectorised text primitives: spans of bytes and their 64-bit hashes, a block of rows at a time.

A block is half a megabyte of UTF-8, so that every temporary array stays small whatever
the length of the texts. Hashes are polynomial in the ring of 64-bit integers over a table
of random byte values, finished by a mixing step; they take the length in, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher of 64-bit values (a murmur-style avalanche)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def _geometric(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = _geometric(_BASE, size), _geometric(_INVERSE, size)
        return self.up, self.down


_POWERS = _Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; with ``ranges`` they hash any range in O(1)."""
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], dtype=_U, out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end)."""
    _, down = _POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


@dataclass
class Block:
    """Rows [first, first + rows) of a batch: their bytes, and where each row starts and ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def as_strings(column: pa.Array) -> pa.Array:
    """Nulls become empty; 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A string column in blocks of about ``limit`` bytes; one long text may exceed it."""
    column = as_strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def byte_prefix(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """For hashes of byte ranges; ``fold`` takes A-Z as a-z."""
    return prefix((_FOLDED if fold else _BYTES)[data])


_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D: starts, ends, and the row's first word.

    The third has one entry more than the block has rows.
    """
    n = len(block.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[block.data]
    cuts = block.bounds[1:-1]
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begin[inner] = inside[1:-1][inner]
    stop[inner - 1] = inside[1:-1][inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, block.bounds)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def owner(firsts: np.ndarray) -> np.ndarray:
    """Row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def long_rows(block: Block, firsts: np.ndarray, width: int) -> np.ndarray:
    """Start items of all windows of ``width`` items that lie in one row."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    return ragged(firsts[:-1], counts)
