"""Words, hashes and windows of whole Arrow text columns, vectorised.

A column's UTF-8 bytes are worked on in chunks of a few megabytes (a longer
text is a chunk by itself), so memory is bounded by the chunk, and no Python
code runs for each word.  Null texts have no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and their inverses."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base & _MASK, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside of the ranges."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: Words between white space, and words of ASCII letters, digits and all non-ASCII characters.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE_HASH = mix(LOWER.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(77))


class Chunk(NamedTuple):
    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """start, end: bytes in the chunk; doc: row in the chunk; count: words of each row."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    count: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(min(n, i + rows, max(i + 1, np.searchsorted(offs, offs[i] + limit, "right") - 1)))
        yield Chunk(i, j, bytes_[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Words:
    """Maximal runs of bytes in the class ``letters`` inside each row; A-Z hash as a-z."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e, e, e, e.astype(np.uint64), np.zeros(rows, np.int64))
    inside = letters[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    tails = offsets[1:][offsets[1:] > 0] - 1
    begin[heads] = inside[heads]
    stop[tails] = inside[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_HASH[data] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(start, end, doc, h, np.bincount(doc, minlength=rows).astype(np.int64))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one row, and the index of their first words."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    at = np.flatnonzero(doc[size - 1 :] == doc[: n - size + 1])
    h = (total[at + size] - total[at]) * down[at]
    return mix(h + np.uint64(size * 0x632BE59BD9B4E019 & _MASK)), at


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
