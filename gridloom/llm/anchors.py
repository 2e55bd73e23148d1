"""Anchors: content-defined places at which equal windows of texts meet.

Every window of W items has as its anchor the k-gram with the smallest hash inside it, the leftmost of equals. Equal
windows have equal anchors at equal offsets, so windows whose anchor occurs only once in a corpus cannot repeat, and
all windows that may be equal can be brought together by the hash of their anchor. One k-gram in about (W - k) / 2 is
an anchor.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_PLACE_BITS = 24
#: Items hashed and searched at a time, so that the arrays stay in a processor's cache.
BLOCK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams at 0 .. n-k, by joining hashes of lengths that are powers of two."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, length, base = items.astype(np.uint64), 1, _MULTIPLIER
    total, done = None, 0
    while True:
        if k & length:
            total = power[done : done + n].copy() if total is None else total * np.uint64(base) + power[done : done + n]
            done += length
        if 2 * length > k:
            return mixed(total)
        power = power[:-length] * np.uint64(base) + power[length:]
        base = base * base % (1 << 64)
        length *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of x[i : i + width]."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def anchors(items: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of every anchor of one text: windows first .. last have the k-gram at place as anchor.

    Windows are numbered by their first item. items holds integers (bytes, or hashes of words). Texts of any length are
    searched in blocks that overlap by a window, so the working memory is bounded; the result is as if in one.
    """
    windows, out = len(items) - window + 1, []
    for at in range(0, max(0, windows), BLOCK):
        n = min(BLOCK, windows - at)
        h = gram_hashes(items[at : at + n + window - 1], k)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal upper bits the leftmost is the smallest
        place = (_sliding_min(packed, window - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        out.append((h[place[first]], place[first] + at, first + at, last + at))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    h, place, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    split = np.flatnonzero(place[1:] == place[:-1])  # an anchor whose windows lie in two blocks
    last[split] = last[split + 1]
    keep = np.ones(len(h), bool)
    keep[split + 1] = False
    return h[keep], place[keep], first[keep], last[keep]
