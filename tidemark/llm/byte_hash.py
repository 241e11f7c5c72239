"""Vectorised hashes of byte windows and words, for use inside tasks.

A window's hash is built by doubling: two neighbouring windows of ``n`` bytes
give one of ``2n``. All arithmetic is modulo 2^64, so equal bytes have equal
hashes in every task.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240101))
#: A random 64-bit value for each byte.
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a pair of hashes."""
    return mix(left * _LEFT + (right ^ _RIGHT) * _RIGHT)


def windows(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size, a power of two, the hashes of all windows of so many
    bytes; entry ``i`` starts at byte ``i``."""
    level, n, out = _BYTE[data], 1, {}
    while True:
        if n in sizes:
            out[n] = level
        if n >= max(sizes) or len(level) <= n:
            return out | {k: level[:0] for k in sizes if k not in out}
        level = join(level[:-n], level[n:])
        n *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` neighbours."""
    n, out = 1, values
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    rest = width - n
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
