"""Static binary-fuse filters (Graf and Lemire, 2022) over 64-bit keys, built and probed by numpy.

A filter is one bytes value: a header and an array of 8-bit cells, about 1.13 cells a key for large sets. A key has
three cells in consecutive segments; their xor is the key's fingerprint. A key that is in the set is always found; one
that isn't is found with a chance of 1 in 256. The empty set gives a filter that finds nothing.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from .words import mix

_HEAD = struct.Struct("<QIIQ")  # seed, cells a segment, segments that a key can begin in, keys
_STEP = np.uint64(0xD6E8FEB86659FD93)  # fixed odd number that parts the two hashes of a key
SEEDS = 128


def _shape(n: int) -> tuple[int, int]:
    """Cells a segment and segments to begin in, by the paper's formulas for three cells a key."""
    if n < 2:
        return 4, 1
    length = min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
    cells = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    return length, max(1, -(-cells // length) - 2)


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, and its fingerprint."""
    h = mix(keys + np.uint64(seed))
    g = mix(h + _STEP)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    inside = [(g >> np.uint64(18 * i)) & np.uint64(length - 1) for i in range(3)]
    cells = np.stack([(first + np.uint64(i)) * np.uint64(length) + inside[i] for i in range(3)]).astype(np.int64)
    return cells, ((g >> np.uint64(54)) & np.uint64(255)).astype(np.uint8)


def _peeled(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their free cells): in each round all keys go that have a cell to themselves."""
    n = cells.shape[1]
    count = np.bincount(cells.ravel(), minlength=size)
    owner = np.zeros(size, np.int64)  # the xor of the keys in a cell
    for row in cells:
        np.bitwise_xor.at(owner, row, np.arange(n))
    rounds, left = [], n
    free = np.flatnonzero(count == 1)
    while len(free):
        keys, at = np.unique(owner[free], return_index=True)
        rounds.append((keys, free[at]))
        left -= len(keys)
        touched = cells[:, keys]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(owner, row, keys)
        near = np.unique(touched)
        free = near[count[near] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of 64-bit keys; repeated keys count once."""
    keys = np.unique(keys.astype(np.uint64, copy=False))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(1, SEEDS):
        cells, marks = _places(keys, seed, length, segments)
        rounds = _peeled(cells, size)
        if rounds is None:
            continue
        table = np.zeros(size, np.uint8)
        for gone, free in reversed(rounds):  # the cell that is free is still 0, so all three may be xored
            near = cells[:, gone]
            table[free] = marks[gone] ^ table[near[0]] ^ table[near[1]] ^ table[near[2]]
        return _HEAD.pack(seed, length, segments, len(keys)) + table.tobytes()
    raise ValueError(f"no seed below {SEEDS} suits {len(keys)} keys")


def contains(filter_: bytes | None, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    if filter_ is None or len(keys) == 0:
        return np.zeros(len(keys), bool)
    seed, length, segments, n = _HEAD.unpack_from(filter_)
    if n == 0:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(filter_, np.uint8, offset=_HEAD.size)
    cells, marks = _places(keys.astype(np.uint64, copy=False), seed, length, segments)
    return (table[cells[0]] ^ table[cells[1]] ^ table[cells[2]]) == marks
