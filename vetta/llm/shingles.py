"""Vectorised 64-bit hashes of words and of word shingles, over batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, WORD_BASE), np.full(n, np.uint64(pow(int(WORD_BASE), -1, 2**64)))
    base[:1] = inverse[:1] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII blanks, A-Z lower-cased) of all texts in
    order, and the offsets of each text in them."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    blank = _BLANK[data]
    inside = ~blank
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * power, dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    limits = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.searchsorted(starts, limits)


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles: all runs of ``width``
    words, or the whole sequence if it is shorter; empty without words."""
    words, offsets = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += mix(words[k:n - width + 1 + k] + np.uint64(2 * k + 1)) if len(rolled) else rolled
    rolled = mix(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a:b - width + 1])
        elif b > a:
            own = words[a:b]
            short = np.array([b - a], np.uint64)
            for k in range(b - a):
                short = mix(own[k:k + 1] + short * np.uint64(2 * k + 3))
            yield short
        else:
            yield np.empty(0, np.uint64)


def groups_of(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters: bounds the work arrays."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
