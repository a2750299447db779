"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
CACHE = 200_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingler:
    """Lower-cases A-Z, takes words between ASCII white space, and hashes each run of WORDS words."""

    def __init__(self) -> None:
        self.table: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct shingles; of fewer words, the whole sequence as one; none without words."""
        # On bytes, lower() and split() know only A-Z, and the white space \x20 and \x09 to \x0D.
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.table) > CACHE:
            self.table.clear()
        table = self.table
        for w in set(words).difference(table):
            table[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        each = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        k = min(WORDS, len(words))
        n = len(words) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = (h ^ each[i : i + n]) * _MIX[0]
            h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
        return np.unique(h * _MIX[2])
