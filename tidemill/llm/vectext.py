"""Vectorised text primitives on Arrow buffers: words and their 64-bit hashes, byte n-grams.

All functions work on UTF-8 bytes.  Letters A-Z are folded to a-z; the separators
are the bytes 0x20 and 0x09-0x0D, which never occur inside a multi-byte character.
Texts are handled in slices of about ``SLICE`` bytes, so memory does not depend on
the number of rows in a batch; one very long text is cut at separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240607))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[FOLD]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
MULT = _RNG.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(1, 2**63, 512, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return raw[first : int(offsets[-1])], offsets - first


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes, a single row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word of the texts ``data[offsets[i]:offsets[i+1]]``."""
    out = []
    n = len(data)
    at = 0
    while at < n:
        to = min(at + 4 * SLICE, n)
        while to < n and not SPACE[data[to]]:  # a cut goes before a separator
            step = np.flatnonzero(SPACE[data[to : to + SLICE]])
            to = to + int(step[0]) if len(step) else min(to + SLICE, n)
        out.append(_words(data[at:to], at, offsets))
        at = to
    if not out:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _words(data, base, offsets):
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    own = offsets[(offsets >= base) & (offsets <= base + n)] - base
    edge[own] = True
    edge[0] = edge[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers_to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return h, start + base, end + base, np.searchsorted(offsets, start + base, "right") - 1


def row_bounds(row: np.ndarray, first: int, last: int) -> np.ndarray:
    """Where each row's words begin among words sorted by row; one more entry than rows."""
    return np.searchsorted(row, np.arange(first, last + 1))


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket below 2**bits and row of every byte n-gram that lies inside one text."""
    if len(data) < n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    m = len(data) - n + 1
    h = np.zeros(m, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + data[k : k + m].astype(np.uint32) + np.uint32(k + 1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x297A2D39)
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if counts.sum() != m:
        ok = np.ones(m, bool)
        for k in range(1, n):
            at = offsets[1:-1] - k
            ok[at[(at >= 0) & (at < m)]] = False
        h = h[ok]
    return h >> np.uint32(32 - bits), rows
