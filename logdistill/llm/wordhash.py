"""Words of many texts as arrays of 64-bit hashes, for work inside tasks."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xD6E8FEB86659FD93)
#: Letters hashed at a time: their arrays take eight times the room of the text.
STRETCH = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * FOLD
    h ^= h >> np.uint64(29)
    h = h * FOLD
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of ``texts`` (bytes) one after another.

    ``hash`` has one value per word, ``doc`` the index of its text, ``start``
    and ``end`` its place in ``buffer``, the texts joined by a space.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b" ".join(texts)
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(inside))
        self.start, self.end = edge[::2], edge[1::2]
        sizes = self.end - self.start
        powers = _powers(int(sizes.max(initial=0)))
        sums = np.zeros(len(sizes), np.uint64)
        total = np.cumsum(sizes)
        cuts = np.searchsorted(total, np.arange(STRETCH, int(total[-1]) if len(total) else 0, STRETCH)) + 1
        bounds = np.unique(np.r_[0, cuts, len(sizes)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            span = raw[self.start[a] : self.end[b - 1]]
            chars = span[~_SPACE[span]]
            if lower:
                chars = _LOWER[chars]
            first = total[a:b] - sizes[a:b] - (total[a - 1] if a else 0)
            within = np.arange(len(chars)) - np.repeat(first, sizes[a:b])
            sums[a:b] = np.add.reduceat(BYTE[chars] * powers[within], first)
        self.hash = mix(sums + sizes.astype(np.uint64))
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc = np.searchsorted(np.cumsum(lengths), self.start, side="right")

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each place on; the last n - 1 places have none."""
        count = max(len(self.hash) - n + 1, 0)
        out = np.zeros(count, np.uint64)
        for i in range(n):
            out = out * STEP + self.hash[i : i + count]
        return mix(out)
