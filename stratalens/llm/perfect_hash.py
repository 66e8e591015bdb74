"""A minimal perfect hash over 64-bit keys: levels of bit arrays (Limasset et al., 2017), all steps on whole arrays."""

from __future__ import annotations

import numpy as np

from stratalens.llm.words import mix

GAMMA = 2.0
MOST_LEVELS = 64
#: What a key that was not indexed meets: it is found by chance once in 2**32 look-ups.
FINGERPRINT_SEED = np.uint64(0xA0761D6478BD642F)


def document_keys(ids: np.ndarray, missing: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Keys of documents: the id (or none) and its occurrence among rows that repeat it."""
    base = np.where(missing, np.uint64(0x8E9D5F2C3B7A1640), mix(ids.astype(np.int64).view(np.uint64)))
    return base + np.where(repeats > 0, mix(repeats.astype(np.uint64) + np.uint64(0x1F)), np.uint64(0))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ FINGERPRINT_SEED) >> np.uint64(32)).astype(np.uint32)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)
    return (mix(keys + seed) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """``sizes`` of the levels, their ``bits`` end to end, and ``ranks``: the ones before each 64-bit word.

    A key that is alone at its place of a level owns that bit; the others go
    on to the next level. Fails on repeated keys.
    """
    sizes, levels, level = [], [], 0
    while len(keys):
        if level == MOST_LEVELS:
            raise ValueError("keys repeat")
        size = -(-int(GAMMA * len(keys)) // 64) * 64 or 64
        place = _place(keys, level, size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, dtype=bool)
        bits[place[alone]] = True
        sizes.append(size)
        levels.append(bits)
        keys, level = keys[~alone], level + 1
    bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    counts = bits.reshape(-1, 64).sum(axis=1)
    ranks = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64) if len(counts) else np.zeros(0, dtype=np.int64)
    return {"sizes": np.array(sizes, dtype=np.int64), "bits": np.packbits(bits, bitorder="little"), "ranks": ranks}


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, 0 to n - 1; of a key that was not indexed, any slot or -1."""
    found = np.full(len(keys), -1, dtype=np.int64)
    words = index["bits"].view("<u8")
    open_, start = np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"].tolist()):
        if not len(open_):
            break
        bit = start + _place(keys[open_], level, size)
        word = words[bit >> 6]
        below = word & ((np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1))
        own = (word >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        found[open_[own]] = index["ranks"][bit[own] >> 6] + np.bitwise_count(below[own])
        open_, start = open_[~own], start + size
    return found
