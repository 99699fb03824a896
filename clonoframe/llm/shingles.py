"""Word shingles as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _B), np.full(n, _BI)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word (run of bytes other than space and 0x09-0x0D), in order."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edge[::2], edge[1::2]
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ (end - start).astype(np.uint64))


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of ``width``-word shingles; of the whole sequence where it has fewer words."""
    w = word_hashes(raw)
    if not len(w):
        return w
    width = min(width, len(w))
    h = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        h = mix(h + w[k : len(w) - width + 1 + k] + np.uint64(k + 1))
    return np.unique(h)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
