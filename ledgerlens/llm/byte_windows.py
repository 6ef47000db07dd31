"""Numpy kernels over the UTF-8 bytes of a block of documents: window hashes and window digits."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Two independent families of hashes: values of bytes, and the odd base of the polynomial.
_TABLES = np.random.default_rng(20_240_917).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xF1357AEA2E62A9C5)
#: Positions hashed at a time, so that the arrays of a step stay in a core's cache.
CHUNK = 1 << 15


def _power(n: int, family: int) -> np.uint64:
    return U64(pow(_BASES[family], n, 1 << 64))


def gram_hashes(data: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """64-bit polynomial hash of every `width`-byte string of `data`, by doubling."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    level, size = _TABLES[family][data], 1
    out, done, rest = None, 0, width
    while rest:
        if rest & size:
            if out is None:
                out, done = level, size
            else:
                m = len(data) - done - size + 1
                out = out[:m] * _power(size, family)
                out += level[done : done + m]
                done += size
            rest -= size
        if rest:
            m = len(data) - 2 * size + 1
            longer = level[:m] * _power(size, family)
            longer += level[size : size + m]
            level = longer
            size *= 2
    return out[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that makes the order of hashes unrelated to their strings."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    size, out = 1, h
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        out = np.minimum(out[: size - width], out[width - size :])
    return out


def half_hashes_and_digits(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position: the hash of the half window there, and the digit of the window there.

    The digit is the least (mixed) hash among the half-window strings inside the window, so equal windows have
    equal digits wherever they stand, and neighbours mostly share one.
    """
    half = window // 2
    inside = window - half + 1
    n = len(data) - window + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, U64)
    halves, digits = np.empty(len(data) - half + 1, U64), np.empty(n, U64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = gram_hashes(data[at : to + window - 1], half)
        halves[at : at + len(h)] = h
        digits[at:to] = sliding_min(mixed(h), inside)
    return halves, digits


def half_hashes(data: np.ndarray, window: int, family: int) -> np.ndarray:
    """For every position the hash of the half window there, by another family."""
    half = window // 2
    out = np.empty(max(0, len(data) - half + 1), U64)
    for at in range(0, len(out), CHUNK):
        h = gram_hashes(data[at : at + CHUNK + half - 1], half, family)
        out[at : at + len(h)] = h
    return out


def window_hashes(halves: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hash of the whole windows at the given positions, from the hashes of half windows (overlapping if odd)."""
    half = window // 2
    return mixed(halves[at] * U64(0xC2B2AE3D27D4EB4F) + mixed(halves[at + (window - half)]))
