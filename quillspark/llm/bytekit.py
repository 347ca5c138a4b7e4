"""Vectorised text primitives over Arrow string buffers: word boundaries, 64-bit word hashes, byte prefix hashes.

A batch is cut into slices of whole texts of about SLICE_BYTES, so memory does not follow the batch; one text beyond that
is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
#: ASCII white space: \t \n \v \f \r and space
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: digits, a-z after lower-casing, and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240229)
CODE = _rng.integers(0, 1 << 64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n-1."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(max(n, 1 << 16), b, U)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and xor-shift rounds)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, null mask) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    nulls = np.asarray(column.is_null())
    if nulls.any():
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if offs else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0], nulls


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets, null mask) of runs of whole texts."""
    data, offs, nulls = utf8(column)
    i, n = 0, len(nulls)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], nulls[i:j]
        i = j
    pa.default_memory_pool().release_unused()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] the weighted sum of bytes i..j-1."""
    s = np.zeros(len(data) + 1, U)
    np.cumsum(CODE[data] * powers(len(data))[0], out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end-1, the same wherever they stand."""
    inv = powers(len(s))[1]
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the maximal runs of member bytes that don't cross texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cls = member[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, cls[:-1], False, cls[1:]
    edge = offs[1:-1]
    before[edge[edge < n]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(cls & ~before), np.flatnonzero(cls & ~after) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, start, end, text index) of the words of a slice whose bytes are lower-cased already."""
    start, end, doc = words(data, offs, member)
    return range_hash(prefix_hash(data), start, end), start, end, doc


def per_text(doc: np.ndarray, n: int) -> np.ndarray:
    """Row bounds of each text in arrays sorted by text index."""
    return np.searchsorted(doc, np.arange(n + 1))
