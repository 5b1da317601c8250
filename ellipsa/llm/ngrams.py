"""Hashed word and character n-gram features of many words at once."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x100000001B3)
_M = np.uint64(0xFF51AFD7ED558CCD)


def hashed(words: list[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): the features of each word, its n-grams of ``low`` to ``high`` code points between < and >, and itself.

    Buckets are numbers under 2 ** bits; ``word`` is the position in ``words`` of each, ascending within one length.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    room = ends[owner] - np.arange(len(points))  # code points from here to the word's end
    out, at = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for n in range(1, high + 1):
            h[: len(points) - n + 1] = (h[: len(points) - n + 1] ^ points[n - 1 :]) * _P
            if n >= low:
                ok = np.flatnonzero(room >= n)
                out.append(h[ok] + np.uint64(n))
                at.append(owner[ok])
        # the whole word: a position-weighted sum of its code points
        place = np.arange(len(points)) - (ends - sizes)[owner]
        whole = np.add.reduceat((points + np.uint64(1)) * _mix(place.astype(np.uint64)), ends - sizes)
        out.append(_mix(whole))
        at.append(np.arange(len(words)))
        flat = _mix(np.concatenate(out))
    return (flat >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(at)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M + np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * _M
