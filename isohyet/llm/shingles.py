"""Hashed word shingles, vectorised with numpy; used inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(r"\w+")


class WordHashes(dict):
    """64-bit hash of a word (bytes or str); remembers at most ``limit`` words."""

    limit = 300_000
    made: list[WordHashes] = []

    def __init__(self):
        super().__init__()
        self.made.append(self)

    @classmethod
    def forget(cls, but: WordHashes | None = None) -> None:
        """Empties what other operators' tasks have left in this worker."""
        for other in cls.made:
            if other is not but:
                other.clear()

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def plain_words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes outside 20 and 09-0D hex, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def letters_and_digits(text: str | None) -> list[str]:
    """Lower-case words without punctuation."""
    return _WORDS.findall(text.lower()) if text else []


def word_hashes(words: list, seen: WordHashes) -> np.ndarray:
    if not seen:
        WordHashes.forget()
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; one of the whole sequence if it is shorter."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        acc = mix(acc) * _STEP + h[j : n - k + 1 + j]
    return mix(acc)


def shingle_set(words: list, k: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(windows(word_hashes(words, seen), k))
