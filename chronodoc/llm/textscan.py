"""Vectorised scanning of text batches inside Arrow workers.

A batch of texts becomes one array of code points; classes, term borders and term hashes are then array
operations, about as fast as a scan in compiled code. Nothing here depends on Spark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Code points of texts put together before they are scanned; bounds a worker's memory, not the result.
BLOCK = 1 << 20
OTHER, LETTER, MARK, NUMBER, SPACE, UNASSIGNED = range(6)
#: fixed values: the code points with the Unicode property White_Space
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "M": MARK, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(1)
def unassigned() -> np.ndarray:
    """True for code points without a character in this Python's Unicode tables."""
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def salts() -> np.ndarray:
    """A random 64-bit value per code point, the same in every worker."""
    return np.random.default_rng(20240607).integers(0, 2**64, 0x110000, dtype=np.uint64, endpoint=False)


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK * 2)
            for name, b in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a, dtype=np.uint64))
        return cls.up, cls.down


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal spans have equal hashes wherever they lie."""
    up, down = _Powers.upto(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(salts()[cp] * up[: len(cp)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return h ^ (h >> np.uint64(29)) ^ (ends - starts).astype(np.uint64)


@dataclass
class Terms:
    """Terms of a block of texts in order; those of text i are ``bounds[i]:bounds[i + 1]``."""

    lowered: list[str]
    cp: np.ndarray
    cls: np.ndarray
    offsets: np.ndarray  # where text i starts in cp; one more than there are texts
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def scan_terms(texts: list[str]) -> Terms:
    """Maximal runs of Unicode classes L, M, N of the lower-cased texts."""
    low = [t.lower() for t in texts]
    cp = codepoints("\n".join(low) + "\n")
    cls = classes()[cp]
    word = ((cls >= LETTER) & (cls <= NUMBER)).view(np.int8)
    step = np.diff(word, prepend=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in low], out=offsets[1:])
    return Terms(low, cp, cls, offsets, starts, ends, span_hashes(cp, starts, ends), np.searchsorted(starts, offsets))


def hash_terms(words: Iterable[str]) -> np.ndarray:
    """Hashes of single terms, as ``scan_terms`` gives them."""
    words = list(words)
    cp = codepoints("".join(words))
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return span_hashes(cp, ends - np.array([len(w) for w in words], np.int64), ends)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` code points in all; a longer text is a range of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
