"""A minimal perfect hash of distinct codes, built shard by shard, in numpy.

Codes that fall on a place of their own in a level's bit array are placed
there; the others go on to the next level. A code's index is the number of set
bits before its bit, so n codes have the indices 0 to n - 1. The codes
themselves, in the order of their indices, tell a code that was never put in.
"""

from __future__ import annotations

import numpy as np

#: Places of a level for each code that is still to be placed.
SPREAD = 2
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mixed(codes: np.ndarray, level: int) -> np.ndarray:
    """A hash of each code (uint64) for a level."""
    x = (codes + np.uint64(level + 1)) * _A
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ (x >> np.uint64(32))


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(codes, 63) % np.uint64(shards)).astype(np.int64)


def build(codes: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(places of each level, bits of all levels, codes in the order of their indices) of distinct codes of one shard."""
    sizes, bits, order, left = [], [], [], np.sort(codes.astype(np.uint64))
    while len(left):
        size = -(-SPREAD * len(left) // 64) * 64
        place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        own = alone[place]
        order.append(left[own][np.argsort(place[own])])
        bits.append(np.packbits(alone, bitorder="little"))
        sizes.append(size)
        left = left[~own]
    none = np.empty(0, np.uint64)
    return sizes, np.concatenate(bits or [none.astype(np.uint8)]).tobytes(), np.concatenate(order or [none])


class MinimalHash:
    """Looks codes up in several shards at once.

    built: (sizes, bits, ordered codes) of each of the shards first to first +
    len(built), of `shards` in all.
    """

    def __init__(self, built: list[tuple], shards: int, first: int = 0):
        self.shards, self.first = shards, first
        depth = max((len(sizes) for sizes, _, _ in built), default=0)
        self.sizes = np.zeros((depth, len(built) + 1), np.uint64)
        self.starts = np.zeros((depth, len(built) + 1), np.int64)
        at = 0
        for i, (sizes, _, _) in enumerate(built):
            for level, size in enumerate(sizes):
                self.sizes[level, i], self.starts[level, i] = size, at
                at += size
        self.words = np.frombuffer(b"".join(bits for _, bits, _ in built), np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.codes = np.concatenate([np.asarray(c, np.uint64) for _, _, c in built] or [np.empty(0, np.uint64)])

    def __len__(self) -> int:
        return len(self.codes)

    def index(self, codes: np.ndarray) -> np.ndarray:
        """The index of each code, -1 of those that were not put in."""
        codes = np.asarray(codes, np.uint64)
        out = np.full(len(codes), -1, np.int64)
        shard = shard_of(codes, self.shards) - self.first
        open_ = np.flatnonzero((shard >= 0) & (shard < self.sizes.shape[1] - 1))
        for level in range(len(self.sizes)):
            size = self.sizes[level, shard[open_]]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            place = self.starts[level, shard[open_]] + (mixed(codes[open_], level) % size).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            found = self.before[place >> 6] + np.bitwise_count(below)
            out[open_[hit]] = found[hit]
            open_ = open_[~hit]
        known = out >= 0
        known[known] = self.codes[out[known]] == codes[known]
        return np.where(known, out, -1)
