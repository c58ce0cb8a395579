"""Content anchors of byte strings: which place stands for each window of a text.

Every window of ``length`` bytes has an anchor, the place in it with the least hash of ``gram`` bytes,
the first of equals. Equal windows have their anchors at equal places, wherever they occur. The
windows of one anchor start next to each other, so an anchor and the bytes its windows cover, its
context, stand for about 85 windows of 200 bytes.
"""

from __future__ import annotations

import numpy as np

GRAM = 24
#: Bytes of a text looked at together; places in them take the low bits of a 64-bit key.
SEGMENT_BITS = 22

_rng = np.random.default_rng(20240131)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(2 * n + 2, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Hashes:
    """64-bit hashes of any part of a byte string, each in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return _mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor), one row per anchor, of a whole byte string."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    first, last, place = [], [], []
    step = (1 << SEGMENT_BITS) - length
    for at in range(0, n, step):
        part = data[at : min(at + step, n) + length - 1]
        h = _TABLE[part]
        have, target = 1, gram
        while have * 2 <= target:
            h = h[:-have] * np.uint64(0x9E3779B97F4A7C15) + h[have:]
            h = h ^ (h >> np.uint64(29))
            have *= 2
        if target > have:  # the rest of the gram overlaps
            h = h[: len(h) - (target - have)] * np.uint64(0xC2B2AE3D27D4EB4F) + h[target - have :]
        h = _mixed(h)
        key = (h & ~np.uint64((1 << SEGMENT_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        own = (_least(key, length - gram + 1) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        first.append(at + cut), last.append(at + np.append(cut[1:], len(own)) - 1), place.append(at + own[cut])
    return np.concatenate(first), np.concatenate(last), np.concatenate(place)
