"""Word and shingle hashes in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lowered; other letters stay as they are."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by a space; fewer words are one run, none are no run."""
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    view = memoryview(joined)
    return np.array([digest(view[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)


class WordHasher:
    """XXH64 of words, remembered up to a fixed number of distinct words."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
