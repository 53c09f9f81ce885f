"""Vectorised text kernels used inside Arrow batch functions.

Everything works on the raw UTF-8 buffers of an Arrow column, cut into blocks of
whole texts, so memory stays near ``BLOCK`` bytes times a small constant however
large the Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_RNG = np.random.default_rng(20240607)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
R, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII letters, digits and every non-ASCII byte belong to words; the rest separates.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of them."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 64)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 8 * BLOCK:
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls are empty."""
    col = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return o, d


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows ``(first, last, offsets from 0, bytes)`` of about ``size`` bytes; a longer text is its own block."""
    if len(column) and column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    o, d = buffers(column)
    n, i = len(column), 0
    while i < n:
        j = int(np.searchsorted(o, o[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, o[i : j + 1] - o[i], d[o[i] : o[j]]
        i = j


def words(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans of a block: (starts, ends, index of each text's first word plus the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = WORD_BYTE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    p, inv = powers(R, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word windows that stay inside one text.

    Returns (hashes, index of the window's first word, index of each text's first window plus the total).
    """
    counts = np.diff(first)
    per = np.maximum(counts - n + 1, 0)
    edge = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(edge[-1]) + np.repeat(first[:-1] - edge[:-1], per)
    if n == 1:
        return h[at], at, edge
    p, inv = powers(Q, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[at + n] - total[at]) * inv[at] + np.uint64(n)), at, edge


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.large_string()))
