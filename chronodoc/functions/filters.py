"""Key filters of sorted tables: bit positions of keys, by arrays."""

from __future__ import annotations

import numpy as np

# fixed values of the stored filters' layout: offset, multiplier, bits of a word
FNV_OFFSET, FNV_PRIME, WORD = 1469598103934665603, 1099511628211, 64


def key_hashes(keys: list[bytes], probes: int) -> np.ndarray:
    """64-bit hash of every key for every probe (probes x keys). Memory is in proportion to the keys' bytes, however
    unequal their lengths are."""
    width = np.array([len(k) for k in keys], np.int64)
    order = np.argsort(-width, kind="stable")
    flat = np.frombuffer(b"".join(keys), np.uint8)
    start = (np.cumsum(width) - width)[order]
    longest = width[order]
    h = np.repeat((np.uint64(FNV_OFFSET) + np.arange(probes, dtype=np.uint64))[:, None], len(keys), 1)
    n = len(keys)
    for j in range(int(longest[0]) if n else 0):
        while longest[n - 1] <= j:  # keys in descending length: those that have a byte at j come first
            n -= 1
        h[:, :n] = (h[:, :n] ^ flat[start[:n] + j].astype(np.uint64)) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[:, order] = h
    return out


def filter_words(keys: list[bytes], words: int, probes: int) -> np.ndarray:
    """The filter of ``words`` 64-bit words that holds all keys."""
    words = max(1, words)
    bits = np.zeros(words * WORD, np.uint8)
    if keys:
        bits[(key_hashes(keys, probes) % np.uint64(words * WORD)).ravel().astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def may_hold(keys: list[bytes], words: np.ndarray, probes: int) -> np.ndarray:
    """True where the filter has all bits of a key; False is certain."""
    at = key_hashes(keys, probes) % np.uint64(len(words) * WORD)
    return ((words[(at // np.uint64(WORD)).astype(np.int64)] >> (at % np.uint64(WORD))) & np.uint64(1) == 1).all(0)
