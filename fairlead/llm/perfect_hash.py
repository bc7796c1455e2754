"""Minimal perfect hashes of stored keys, in shards, built one shard at a time and asked for many keys at once."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

# Keys above this many bytes are stored as a mark and their 128-bit digest.
LONG_KEY = 256
LOW = (1 << 64) - 1


def hash_key(key: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(key, seed)


def stored(key: bytes) -> bytes:
    """What is kept of a key to verify it. Keys have no byte 0, so a digest is never taken for a key."""
    return key if len(key) <= LONG_KEY else b"\x00" + hashlib.md5(key).digest()


def mixed(h, step):
    """64 mixed bits of a hash and a step; works on Python integers and on uint64 arrays."""
    z = (h + step * 0x9E3779B97F4A7C15) & LOW
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & LOW
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & LOW
    return z ^ (z >> 31)


def mixed_array(h: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The same for arrays, whose products wrap by themselves."""
    z = h + step * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def build(keys: list[bytes], seed: int) -> tuple[int, np.ndarray, list[int]]:
    """(seed, steps, slot per key) for different keys: each has a slot of its own in 0 .. n - 1.

    Keys fall into n buckets. Larger buckets come first and take the least step that sends all of
    their keys to free slots; a key alone in its bucket gets one of the slots left, told by a
    negative step. Two keys of one hash make the shard start over with the next seed.
    """
    n = len(keys)
    hashes = [hash_key(k, seed) for k in keys]
    while len(set(hashes)) < n:
        seed = (seed + 1) & LOW
        hashes = [hash_key(k, seed) for k in keys]
    buckets: dict[int, list[int]] = {}
    for i, h in enumerate(hashes):
        buckets.setdefault((h & 0xFFFFFFFF) % n, []).append(i)
    steps, slots, taken = np.zeros(n, np.int32), [0] * n, bytearray(n)
    ordered = sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0]))
    free = None
    for bucket, own in ordered:
        if len(own) == 1:
            if free is None:
                free = iter([s for s in range(n) if not taken[s]])
            slots[own[0]] = next(free)
            steps[bucket] = -slots[own[0]] - 1
            continue
        step = 0
        while True:
            step += 1
            to = [mixed(hashes[i], step) % n for i in own]
            if len(set(to)) == len(to) and not any(taken[s] for s in to):
                break
        steps[bucket] = step
        for i, s in zip(own, to):
            slots[i], taken[s] = s, 1
    return seed, steps, slots


class Shards:
    """Some shards of one key set, side by side: slots run on from shard to shard."""

    def __init__(self, shards: int, seed: int, rows: list[tuple[int, int, bytes, bytes, bytes]]):
        """``rows``: (shard, seed, steps, key lengths by slot, keys by slot) of the shards at hand, of ``shards`` in all."""
        self.shards, self.seed = shards, seed
        self.number = np.array([r[0] for r in rows], np.int64)
        self.at = np.full(shards, -1, np.int64)
        self.at[self.number] = np.arange(len(rows))
        self.seeds = [r[1] for r in rows]
        steps = [np.frombuffer(r[2], np.int32) for r in rows]
        self.sizes = np.array([len(s) for s in steps], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.steps = np.concatenate(steps)
        lengths = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
        self.start = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.keys = b"".join(r[4] for r in rows)

    def __len__(self) -> int:
        return int(self.first[-1])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key, -1 for keys that are not stored: the key at the place is compared."""
        h = np.fromiter((hash_key(k, self.seed) for k in keys), np.uint64, len(keys))
        at = self.at[shard_of(h, self.shards)]
        for i, seed in enumerate(self.seeds):
            if seed != self.seed:
                for j in np.flatnonzero(at == i):
                    h[j] = hash_key(keys[j], seed)
        n = np.where(at < 0, 1, self.sizes[at]).astype(np.uint64)
        first = self.first[at]
        step = self.steps[np.where(at < 0, 0, first + ((h & np.uint64(0xFFFFFFFF)) % n).astype(np.int64))].astype(np.int64)
        slot = np.where(step < 0, -step - 1, (mixed_array(h, np.maximum(step, 0).astype(np.uint64)) % n).astype(np.int64))
        place = np.where(at < 0, -1, first + slot)
        for j, p in enumerate(place.tolist()):
            if p >= 0 and self.keys[self.start[p]:self.start[p + 1]] != stored(keys[j]):
                place[j] = -1
        return place

    def shard_and_slot(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, places, side="right") - 1
        return self.number[at], places - self.first[at]


def shard_of(h, shards: int):
    """Shard of a 64-bit hash, from bits that the buckets of a shard don't use alone."""
    if isinstance(h, np.ndarray):
        return ((h >> np.uint64(34)) % np.uint64(shards)).astype(np.int64)
    return (h >> 34) % shards
