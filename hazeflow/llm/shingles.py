"""Hashes of word shingles, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def word_shingles(words: list[bytes], n: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and the start and end of every n-word shingle in that.

    Fewer words than n make one shingle of all; no word makes none.
    """
    joined = b" ".join(words)
    if len(words) <= n:
        return joined, [0] * bool(words), [len(joined)] * bool(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included."""
    joined, starts, ends = word_shingles(words, n)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
