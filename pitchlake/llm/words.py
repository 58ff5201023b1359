"""Words of a text as numbers, in tasks: hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def split(text: str, lower: bool = False) -> list[bytes]:
    """The words (runs without ASCII white space) in UTF-8; ``lower``: with A-Z as a-z."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """64-bit hashes by word, worked out once for each kept word."""

    def __init__(self, most: int = 1 << 18) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The hashes spread over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs(hashes: np.ndarray, size: int, factor: np.uint64 = FACTOR) -> np.ndarray:
    """A hash of each ``size`` consecutive words, by doubling; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, step, span = None, 0, factor, hashes, 1
        left = size
        while left:
            if left & 1:
                piece = step[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += span
            left >>= 1
            if left:
                step = step[:-span] * power + step[span:] if len(step) > span else step[:0]
                power = power * power
                span *= 2
        return mix(out)


def least_places(values: np.ndarray, size: int) -> np.ndarray:
    """For each ``size`` consecutive values the place of the least, the first of equal ones."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(values))
    span = 1
    while span * 2 <= size:
        a, b = at[:-span], at[span:]
        at = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = at[:n], at[size - span : size - span + n]
    return np.where(values[b] < values[a], b, a)
