"""Minimal perfect hashing of distinct 64-bit keys by levels of collision-free bits (published as BBHash), in shards.

A key of a shard takes the first level whose bit it hits alone. The number of set bits before that one, over all shards in
order, is the key's slot: ``n`` keys take the slots 0 to ``n - 1``. Keys are kept in slot order and verified, so a strange key
has no slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from govspark.llm.words import mix

#: Bits of a level for each key that is left.
BITS_PER_KEY = 2


def shard_number(keys: np.ndarray) -> np.ndarray:
    """31 bits that deal a key to a shard: take them modulo the number of shards."""
    return (mix(keys.astype(np.uint64) + np.uint64(0xA24BAED4963EE407)) >> np.uint64(33)).astype(np.int64)


def _place(mixed: np.ndarray, level: int, size) -> np.ndarray:
    """A bit of a level of ``size`` bits, fewer than 2^32."""
    return ((mix(mixed + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)


@dataclass
class Shard:
    """``sizes`` are bits per level, multiples of 64; ``words`` the bits of all levels; ``keys`` in slot order."""

    sizes: np.ndarray
    words: np.ndarray
    keys: np.ndarray


def build(keys: np.ndarray) -> Shard:
    """Keys of one shard; repeats are taken once."""
    keys = np.unique(keys.astype(np.int64))
    mixed, sizes, words, order = mix(keys.astype(np.uint64)), [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    while len(keys):
        size = -(-BITS_PER_KEY * len(keys) // 64) * 64
        at = _place(mixed, len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        sizes.append(size)
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(keys[alone][np.argsort(at[alone])])
        keys, mixed = keys[~alone], mixed[~alone]
    return Shard(np.array(sizes, np.int64), np.concatenate(words), np.concatenate(order))


class PerfectHash:
    """Consecutive shards, from number ``first`` on of ``of`` in all, put together."""

    def __init__(self, shards: list[Shard], first: int = 0, of: int | None = None):
        self.first, self.of = first, len(shards) if of is None else of
        levels = max((len(s.sizes) for s in shards), default=0)
        self.sizes = np.zeros((len(shards), levels), np.int64)
        for i, shard in enumerate(shards):
            self.sizes[i, : len(shard.sizes)] = shard.sizes
        self.base = np.concatenate([[0], np.cumsum(self.sizes.ravel())])[:-1].reshape(self.sizes.shape).astype(np.int64)
        self.words = np.concatenate([np.empty(0, np.uint64), *(s.words for s in shards)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.keys = np.concatenate([np.empty(0, np.int64), *(s.keys for s in shards)])

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that is not held here."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return found
        shard = shard_number(keys) % self.of - self.first
        left = np.flatnonzero((shard >= 0) & (shard < len(self.sizes)))
        shard, mixed = shard[left], mix(keys[left].astype(np.uint64))
        for level in range(self.sizes.shape[1]):
            if not len(left):
                break
            at = _place(mixed, level, self.sizes[shard, level]).astype(np.int64) + self.base[shard, level]
            bit = (at & 63).astype(np.uint64)
            word = self.words[np.minimum(at >> 6, len(self.words) - 1)]
            hit = ((word >> bit) & np.uint64(1) == 1) & (self.sizes[shard, level] > 0)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left, shard, mixed = left[~hit], shard[~hit], mixed[~hit]
        known = found >= 0
        found[known] = np.where(self.keys[found[known]] == keys[known], found[known], -1)
        return found
