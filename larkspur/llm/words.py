"""Word splitting over UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_KEEP = bytes(
    (c + 32) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of bytes other than space and 0x09 to 0x0D."""
    return text.lower().split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of digits, a-z and bytes above 0x7F."""
    return text.translate(_KEEP).split() if text else []


class WordHashes(dict):
    """64-bit hash of each word; forgets all at a bound, and long words at once, which changes
    no hash."""

    bound, longest = 100_000, 64

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordIds(dict):
    """Numbers of words from 1 on in the order they are met, and their 64-bit hashes by number;
    `first` is the hash of number 0. The owner clears it, when it is full, between batches."""

    words, size = 100_000, 8_000_000

    def __init__(self, first: int):
        super().__init__()
        self.hashes = [first]
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        self.bytes += len(word)
        return number

    @property
    def full(self) -> bool:
        return len(self) > self.words or self.bytes > self.size

    def clear(self) -> None:
        super().clear()
        del self.hashes[1:]
        self.bytes = 0

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; fewer words are one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    step = np.uint64(0x9E3779B97F4A7C15)
    size = min(width, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed((h * step) ^ hashes[k : n - size + 1 + k])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
