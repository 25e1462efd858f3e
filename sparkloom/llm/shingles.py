"""Word shingles of text batches as 64-bit hashes, whole columns at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import ship

ship(__name__)

_M = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SOLID = np.ones(256, bool)
_SOLID[[32, 9, 10, 11, 12, 13]] = False
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _M
    return x ^ (x >> np.uint64(29))


def _power_table(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 18, n)
        out = []
        for base in (_BASE, _UNBASE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = out
    return _powers


def slices(column: pa.Array, most: int = 1 << 21):
    """``(first row, offsets, bytes)`` of runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(raw, raw[at] + most, "right")) - 1)
        end = min(end, len(column))
        yield at, raw[at : end + 1] - raw[at], data[raw[at] : raw[end]]
        at = end


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased), and for each row the index of its first word (one more entry at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = _SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in one array, and the bounds of each row's share.

    A row with fewer than ``k`` words has its whole sequence as one shingle; a row without words has none.
    """
    hashes, at = words(offsets, data)
    rows = len(offsets) - 1
    if len(hashes) >= k:
        runs = sum((hashes[j : len(hashes) - k + 1 + j] * _PLACE[j] for j in range(k)), np.zeros(len(hashes) - k + 1, np.uint64))
        runs = mix(runs)
    else:
        runs = np.zeros(0, np.uint64)
    parts, bounds = [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        lo, hi = at[r], at[r + 1]
        if hi - lo >= k:
            own = np.sort(runs[lo : hi - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            own = mix((hashes[lo:hi] * _PLACE[k : k + hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
        else:
            own = runs[:0]
        parts.append(own)
        bounds[r + 1] = bounds[r] + len(own)
    return (np.concatenate(parts) if parts else runs[:0]), bounds


def set_hash(tokens: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for each row's set, 0 for an empty one; hashes of different seeds are independent."""
    salt = mix(np.array([seed], np.uint64)) + _PLACE[60]
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens ^ salt), out=sums[1:])
    size = np.diff(bounds).astype(np.uint64)
    out = mix((sums[bounds[1:]] - sums[bounds[:-1]]) + size * _PLACE[61])
    out[size == 0] = 0
    return out.view(np.int64)
