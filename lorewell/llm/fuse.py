"""Static binary-fuse filters over 64-bit keys (Graf and Lemire), built with numpy.

A filter is built once from a fixed key set and never changed. It answers
"maybe" for every key of the set (no false negatives) and "maybe" for about
one foreign key in 256, at roughly nine bits a key.
"""

from __future__ import annotations

import math
import struct

import numpy as np

HEADER = struct.Struct("<QII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots a key, in three neighbouring segments; shape (n, 3)."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    base = first * np.uint64(length)
    a = base + (h & mask)
    b = base + np.uint64(length) + ((h >> np.uint64(18)) & mask)
    c = base + np.uint64(2 * length) + ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask)
    return np.stack([a, b, c], axis=1).astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of uint64 keys (repeats are ignored; an empty set is allowed)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    length = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    segments = max(1, -(-int(n * factor) // length) - 2)
    for attempt in range(200):
        if attempt and attempt % 10 == 0:  # small sets may need more room
            segments += max(1, segments // 10)
        seed = (attempt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
        h = _mix(keys, seed)
        places, slots = _places(h, length, segments), (segments + 2) * length
        count = np.bincount(places.ravel(), minlength=slots)
        owner = np.zeros(slots, np.int64)  # xor of the indices of the keys at each slot
        for j in range(3):
            np.bitwise_xor.at(owner, places[:, j], np.arange(n))
        layers, left = [], n
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            key, first = np.unique(owner[single], return_index=True)
            slot = single[first]
            layers.append((key, slot))
            left -= len(key)
            for j in range(3):
                np.subtract.at(count, places[key, j], 1)
                np.bitwise_xor.at(owner, places[key, j], key)
        if left:
            continue
        table, prints = np.zeros(slots, np.uint8), _fingerprint(h)
        for key, slot in reversed(layers):  # no slot of a layer is read by another key of that layer
            p = places[key]
            table[slot] = prints[key] ^ table[p[:, 0]] ^ table[p[:, 1]] ^ table[p[:, 2]] ^ table[slot]
        return HEADER.pack(seed, length, segments) + table.tobytes()
    raise ValueError(f"no binary-fuse layout found for {n} keys")


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key: False if it surely isn't in the set, else True."""
    seed, length, segments = HEADER.unpack_from(blob)
    table = np.frombuffer(blob, np.uint8, offset=HEADER.size)
    h = _mix(keys.astype(np.uint64), seed)
    p = _places(h, length, segments)
    return (table[p[:, 0]] ^ table[p[:, 1]] ^ table[p[:, 2]]) == _fingerprint(h)
