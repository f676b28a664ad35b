"""Word shingles of texts as sets of 64-bit numbers, and their min-max signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SHINGLE = 5
PERMUTATIONS, ROWS = 128, 8  # two values each; so many of them a band at most
MISSED = 1e-4  # of pairs that are just similar, this share at most has no band in common
_WORDS = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20)
_SCALE = _RNG.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64)
_PLACE = _RNG.integers(1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """64-bit numbers of words; emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: Words) -> np.ndarray:
    """The sorted set of 5-word shingles; with fewer words the whole sequence is one; without a word it is empty."""
    own = (text or "").encode().translate(_LOWER).split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(words.__getitem__, own), np.uint64, n)
    if n < SHINGLE:
        return mixed(np.array([xxhash.xxh3_64_intdigest(x.tobytes())], np.uint64))
    h = x[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        h = mixed(h) + x[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(mixed(h))


def signature(own: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, in turn (of a set that is not empty)."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(own), 2048):
        x = own[i : i + 2048][None, :] * _SCALE[:, None]
        x += _SHIFT[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.stack([low, high], 1).reshape(-1)


def band_rows(percent: int) -> int:
    """The most values a band can have if pairs of this similarity are to be found: 8 at 85 (32 bands), 6 at 80 (42)."""
    return next((r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MISSED), 1)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit number for each band of `rows` values; it tells the band too, so numbers of different bands don't meet."""
    n = len(sig) // rows
    x = sig[: n * rows].reshape(n, rows)
    h = x[:, 0]
    for k in range(1, rows):
        h = mixed(h) + x[:, k] * np.uint64(0x9E3779B97F4A7C15)
    return mixed(mixed(h) + np.arange(n, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def set_key(own: np.ndarray) -> bytes:
    """Equal sets have equal keys."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def similar(common: int, a: int, b: int, percent: int = 85) -> bool:
    return 100 * common >= percent * (a + b - common)
