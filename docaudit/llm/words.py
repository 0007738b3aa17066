"""Words, n-word windows and their hashes, by numpy over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multipliers of the mixing steps.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = [np.uint64(x) for x in (31, 29, 32)]
#: Words that a worker remembers with their hash.
REMEMBER = 1 << 17


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _M1
    x = (x ^ (x >> _S[1])) * _M2
    return x ^ (x >> _S[2])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of n words."""
    m = len(h) - n + 1
    out = np.zeros(max(0, m), np.uint64)
    for i in range(n if m > 0 else 0):
        out = mix(out + h[i : i + m])
    return out


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, one of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    h = windows(word_hashes(words), min(n, len(words)))
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]
