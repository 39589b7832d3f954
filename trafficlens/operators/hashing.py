"""The 64-bit hash that snapshots are bound to, and the generator of synthetic traces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MASK = (1 << 64) - 1
#: Fixed values of the hash: FNV-1a's offset and prime, splitmix64's constants, and the domain tags.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN = 0x9E3779B97F4A7C15
SECOND_ROW, INDEX_DOMAIN, SIGN_DOMAIN = 0xA5A5A5A55A5A5A5A, 0xD6E8FEB86659FD93, 0xA4093822299F31D0
HASH_VERSION = 2


def splitmix64(x: int) -> int:
    x = (x + GOLDEN) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def hash64(data: bytes, seed: int = 0) -> int:
    h = FNV_OFFSET ^ splitmix64(seed)
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & MASK
    return splitmix64(h)


def _rotate(x: int, left: int) -> int:
    left %= 64
    return ((x << left) | (x >> (64 - left))) & MASK if left else x


@dataclass(frozen=True)
class RowHash:
    """Columns and signs of a key in the rows of a table."""

    first: int
    second: int

    @classmethod
    def of(cls, key: bytes, seed: int) -> RowHash:
        return cls(hash64(key, seed), hash64(key, seed ^ SECOND_ROW) | 1)

    def index(self, row: int, width: int) -> int:
        turned = _rotate(self.second, row % 63 + 1)
        return splitmix64(self.first ^ turned ^ splitmix64(row ^ INDEX_DOMAIN)) % width

    def sign(self, row: int) -> int:
        turned = _rotate(self.second, -(row % 63 + 1))
        return 1 if splitmix64(self.first ^ turned ^ splitmix64(row ^ SIGN_DOMAIN)) & 1 else -1


def splitmix64_many(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash64_many(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """:func:`hash64` of each key, a byte of all keys at a time."""
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    width = max(1, int(sizes.max(initial=0)))
    cells = np.ascontiguousarray(np.array(keys, dtype=f"S{width}").view(np.uint8).reshape(-1, width).T)
    h = np.full(len(keys), FNV_OFFSET ^ splitmix64(seed), dtype=np.uint64)
    for i, column in enumerate(cells):
        h = np.where(sizes > i, (h ^ column) * np.uint64(FNV_PRIME), h)
    return splitmix64_many(h)


@dataclass(frozen=True)
class RowHashes:
    """:class:`RowHash` of many keys."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, keys: list[bytes], seed: int) -> RowHashes:
        return cls(hash64_many(keys, seed), hash64_many(keys, seed ^ SECOND_ROW) | np.uint64(1))

    def _turned(self, left: int, tag: int) -> np.ndarray:
        left %= 64  # never 0
        turned = (self.second << np.uint64(left)) | (self.second >> np.uint64(64 - left))
        return splitmix64_many(self.first ^ turned ^ np.uint64(splitmix64(tag)))

    def index(self, row: int, width: int) -> np.ndarray:
        return (self._turned(row % 63 + 1, row ^ INDEX_DOMAIN) % np.uint64(width)).astype(np.int64)

    def sign(self, row: int) -> np.ndarray:
        return (self._turned(-(row % 63 + 1), row ^ SIGN_DOMAIN) & np.uint64(1)).astype(np.int64) * 2 - 1


class SplitMixRng:
    """A stream of 64-bit numbers."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & MASK
        return splitmix64(self.state)

    def below(self, n: int) -> int:
        return self.next() % n

    def unit(self) -> float:
        return (self.next() >> 11) / float(1 << 53)


