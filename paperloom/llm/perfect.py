"""Minimal perfect hashes: n distinct 64-bit hashes onto the slots 0 to n - 1.

Level by level: every key of a level marks its bit; keys alone on a bit stay there,
the others go on to the next, smaller level. A key's slot is the number of kept
bits before its own. A hash that was not given may find a slot too, so the owner of
a table stores keys or fingerprints by slot and compares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from paperloom.llm.batches import mix64

SPREAD = 2  # bits for each key that reaches a level
MAX_LEVELS = 64
STEP = np.uint64(0x9E3779B97F4A7C15)  # the increment of the public splitmix64 generator


def place(h: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h + np.uint64(level + 1) * STEP) % np.asarray(size, np.uint64)).astype(np.int64)


def build(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each level, the levels' kept bits back to back in 64-bit words) of distinct hashes."""
    left, sizes, words = np.asarray(h, np.uint64), [], []
    if len(np.unique(left)) != len(left):
        raise ValueError("equal hashes have no perfect hash")
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("hashes do not come apart")
        size = -(-SPREAD * len(left) // 64) * 64
        at = place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)


@dataclass
class Perfect:
    """The perfect hashes of several shards, looked up together; slots of a shard follow those of the one before."""

    begin: np.ndarray  # (shard, level): first bit
    size: np.ndarray  # (shard, level): bits, 0 beyond the last level
    bits: np.ndarray
    rank: np.ndarray  # kept bits before each word
    first: np.ndarray  # first slot of each shard, and the number of all

    def slots(self, h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The slot of each hash in its shard's table; -1 for some that were not given (not for all)."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for level in range(self.size.shape[1]):
            todo = todo[self.size[shard[todo], level] > 0]
            if not len(todo):
                break
            own = shard[todo]
            at = self.begin[own, level] + place(h[todo], level, self.size[own, level])
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.rank[at >> 6] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        return out


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> Perfect:
    """One table of the results of ``build``, in the order of the shards."""
    levels = max((len(s) for s, _ in parts), default=0)
    size = np.zeros((len(parts), levels), np.int64)
    for i, (s, _) in enumerate(parts):
        size[i, : len(s)] = s
    begin = (np.cumsum(size.reshape(-1)) - size.reshape(-1)).reshape(size.shape)
    bits = np.concatenate([np.zeros(0, np.uint64), *(w for _, w in parts)])
    count = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    ends = np.cumsum([0, *(len(w) for _, w in parts)])
    return Perfect(begin, size, bits, count[:-1], count[ends])
