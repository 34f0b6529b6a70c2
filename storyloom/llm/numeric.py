"""Hashes of words and of runs of words, for a slice of documents at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
R = U(0x9E3779B97F4A7C15)
R_INVERSE = U(pow(int(R), -1, 1 << 64))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + U(seed)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Polynomial hashes of any run of a sequence of numbers, from running sums."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.total = np.concatenate([np.zeros(1, U), np.cumsum(x * powers(R, n), dtype=U)])
        self.back = powers(R_INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F), seed)


@dataclass
class Words:
    """Word hashes of documents, one after the other; `first[i]` is where document i begins, `first[-1]` the end."""

    hash: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], lower: bool = False) -> Words:
        """Words are what bytes.split() gives; with `lower`, A-Z are taken as a-z."""
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            joined = np.where((joined >= 65) & (joined <= 90), joined + 32, joined)
        blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
        start, end = edge[::2], edge[1::2]
        size = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
        return cls(Runs(mixed(joined.astype(U), 7)).hash(start, end, 1), first)
