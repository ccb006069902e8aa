"""Sharded minimal perfect hash over 128-bit keys, with a fingerprint and a count for each key.

A key is two unsigned 64-bit numbers (a, b). The top bits of a give its shard. A shard has levels of bits: at each, a
key that no other remaining key meets sets its bit, the others go on to the next. The rank of a key's bit among all
bits of its shard is its place in the arrays; b is its fingerprint there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits a key has at each level.
ROOM = 2.0
U = np.uint64


def mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A hash of the key for the level."""
    x = a ^ (b * U(0x9E3779B97F4A7C15)) ^ U((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(3)


@dataclass
class Shard:
    number: int
    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # of all levels, in 64-bit words
    prints: np.ndarray
    counts: np.ndarray


def build(number: int, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> Shard:
    """The keys must differ."""
    sizes, words, left_a, left_b = [], [], a, b
    while len(left_a):
        size = -int(-len(left_a) * ROOM // 64) * 64
        at = mix(left_a, left_b, len(sizes)) % U(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(U))
        sizes.append(size)
        rest = ~alone[at.astype(np.int64)]
        left_a, left_b = left_a[rest], left_b[rest]
    made = Shard(0, np.array(sizes, np.int64), np.concatenate([*words, np.empty(0, U)]), np.zeros(len(a), U), np.zeros(len(a), np.uint32))
    place = Index([made], 0).place(a, b)
    made.prints[place], made.counts[place] = b, np.minimum(counts, 0xFFFFFFFF)
    made.number = number
    return made


class Index:
    """Some of the 2 ** top shards, laid end to end."""

    def __init__(self, shards: list[Shard], top: int):
        self.top, n = top, 1 << top
        depth = max((len(s.sizes) for s in shards), default=0)
        self.sizes, self.starts = np.zeros((n, depth), np.int64), np.zeros((n, depth), np.int64)
        word = 0
        for s in shards:
            k = len(s.sizes)
            self.sizes[s.number, :k] = s.sizes
            self.starts[s.number, :k] = 64 * word + np.cumsum(s.sizes) - s.sizes
            word += len(s.bits)
        cat = lambda what, kind: np.concatenate([*(getattr(s, what) for s in shards), np.empty(0, kind)])
        self.bits, self.prints, self.counts = cat("bits", U), cat("prints", U), cat("counts", np.uint32)
        # bits of a shard are as many as its keys, so ranks over all shards are places in the arrays laid end to end
        self.before = np.cumsum(np.bitwise_count(self.bits).astype(np.int64)) - np.bitwise_count(self.bits)

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where a key is in the arrays; -1 for some keys that aren't in the index, a wrong place for others."""
        shard = (a >> U(64 - self.top)).astype(np.int64) if self.top else np.zeros(len(a), np.int64)
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            s = shard[left]
            at = self.starts[s, level] + (mix(a[left], b[left], level) % self.sizes[s, level].astype(U)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(U)
            hit = (word >> bit) & U(1) == 1
            below = np.bitwise_count(word & ((U(1) << bit) - U(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        return out

    def count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The counts of keys; 0 for keys that the index lacks."""
        out, at = np.zeros(len(a), np.int64), self.place(a, b)
        there = np.flatnonzero(at >= 0)
        there = there[self.prints[at[there]] == b[there]]
        out[there] = self.counts[at[there]]
        return out
