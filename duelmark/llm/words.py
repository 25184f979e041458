"""Hashes of words and word sequences for a slice of texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
SEPARATE = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the 64 bits of each value."""
    h = (h ^ (h >> np.uint64(32))) * SEPARATE
    return h ^ (h >> np.uint64(29))


class WordHashes:
    """64-bit hashes of each word, one for each of ``keys`` (what of the word is hashed), kept from batch to batch.

    Starts afresh at ``most`` words, so its memory is bounded.
    """

    def __init__(self, *keys: Callable[[bytes], bytes], most: int = 1_000_000):
        self.keys, self.most = keys or (bytes,), most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tables = np.empty((len(self.keys), 1 << 12), np.uint64)

    def _learn(self, words: set[bytes]) -> None:
        used = len(self.known)
        while used + len(words) > self.tables.shape[1]:
            self.tables = np.concatenate([self.tables, np.empty_like(self.tables)], axis=1)
        words = list(words)
        for table, key in zip(self.tables, self.keys):
            table[used:used + len(words)] = [xxhash.xxh3_64_intdigest(key(w)) for w in words]
        self.known.update(zip(words, range(used, used + len(words))))

    def places(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text begins (with the end of the last), and the column of all words in order in the tables."""
        if len(self.known) > self.most:
            self._clear()
        if fresh := set().union(*split) - self.known.keys():
            self._learn(fresh)
        get = self.known.__getitem__
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((h for words in split for h in map(get, words)), np.int64, int(sizes.sum()))
        return np.concatenate([[0], np.cumsum(sizes)]), at

    def __call__(self, split: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Where each text begins (with the end of the last), then the hashes of all words in order by each key."""
        begins, at = self.places(split)
        return begins, *(table[at] for table in self.tables)


def sequences(hashes: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` words in a row that lie in one text, and the number of that text."""
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(hashes) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += hashes[k:n + k] * ODD[k]
    sizes = np.diff(begins)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[:n] == text[width - 1:]
    return mixed(h[inside]), text[:n][inside]
