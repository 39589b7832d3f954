"""The versioned binary form of sketches, and of batches of them."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .hashing import HASH_VERSION, hash64

#: Fixed values of the format.
MAGIC, VERSION, FAMILY = b"FSK1", 2, 0
ALGORITHMS = {"count-min": 1, "count-sketch": 2, "hll": 3, "spacesaving": 4, "misra-gries": 5, "hllmap": 6, "exact": 7, "kll": 8, "key-sample": 9}
BATCH_MAGIC, BATCH_VERSION = b"FSKB", 1
MOST_ENTRIES, MOST_NODE, MOST_QUERY, MOST_COMPONENT = 4096, 253, 256, 128


class SnapshotError(ValueError):
    """Bytes that are no snapshot, or not one that fits."""


class Incompatible(ValueError):
    """Sketches that can't be merged."""


class Cursor:
    """Reads little-endian values and refuses to run past the end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise SnapshotError("snapshot is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(f"<{form}", self.take(struct.calcsize(f"<{form}")))[0]

    def blob(self) -> bytes:
        return self.take(self.number("I"))

    def count(self, each: int) -> int:
        """A 32-bit count of items that take ``each`` bytes at least."""
        n = self.number("I")
        if n * each > len(self.data) - self.at:
            raise SnapshotError("snapshot counts more than it holds")
        return n

    def end(self) -> None:
        if self.at != len(self.data):
            raise SnapshotError("bytes follow the snapshot")


def blob(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


@dataclass(frozen=True)
class Header:
    algorithm: str
    seed: int
    start: int
    end: int
    params: bytes


def write_snapshot(algorithm: str, seed: int, start: int, end: int, params: bytes, payload: bytes) -> bytes:
    body = MAGIC + struct.pack("<HHBQHQQ", VERSION, ALGORITHMS[algorithm], FAMILY, seed, HASH_VERSION, start, end) + blob(params) + blob(payload)
    return body + struct.pack("<Q", hash64(body, 0))


def read_snapshot(data: bytes) -> tuple[Header, bytes]:
    if len(data) < 12 or data[:4] != MAGIC:
        raise SnapshotError("not a snapshot")
    if struct.unpack("<Q", data[-8:])[0] != hash64(data[:-8], 0):
        raise SnapshotError("checksum differs")
    c = Cursor(data[4:-8])
    version, algorithm, family, seed, hash_version, start, end = (c.number(f) for f in "HHBQHQQ")
    names = {v: k for k, v in ALGORITHMS.items()}
    if version != VERSION or family != FAMILY or hash_version != HASH_VERSION or algorithm not in names:
        raise SnapshotError("unsupported version, hash or algorithm")
    params, payload = c.blob(), c.blob()
    c.end()
    return Header(names[algorithm], seed, start, end, params), payload


@dataclass(frozen=True)
class Entry:
    query: str
    component: str
    data: bytes


def encode_batch(node: str, entries: list[Entry]) -> bytes:
    """A node's snapshots for the gateway."""
    _check(node, entries)
    body = BATCH_MAGIC + struct.pack("<H", BATCH_VERSION) + blob(node.encode()) + struct.pack("<I", len(entries))
    for e in entries:
        body += blob(e.query.encode()) + blob(e.component.encode()) + blob(e.data)
    return body + struct.pack("<Q", hash64(body, 0))


def decode_batch(data: bytes) -> tuple[str, list[Entry]]:
    if len(data) < 12 or data[:4] != BATCH_MAGIC:
        raise SnapshotError("not a batch")
    if struct.unpack("<Q", data[-8:])[0] != hash64(data[:-8], 0):
        raise SnapshotError("checksum differs")
    c = Cursor(data[4:-8])
    if c.number("H") != BATCH_VERSION:
        raise SnapshotError("unsupported batch version")
    try:
        node = c.blob().decode()
        entries = [Entry(c.blob().decode(), c.blob().decode(), c.blob()) for _ in range(c.count(12))]
    except UnicodeDecodeError as e:
        raise SnapshotError("a name isn't UTF-8") from e
    c.end()
    _check(node, entries)
    return node, entries


def _check(node: str, entries: list[Entry]) -> None:
    if not node or len(node.encode()) > MOST_NODE or len(entries) > MOST_ENTRIES:
        raise SnapshotError("node name or number of entries out of range")
    if any(not e.query or len(e.query.encode()) > MOST_QUERY or not e.component or len(e.component.encode()) > MOST_COMPONENT for e in entries):
        raise SnapshotError("query or component name out of range")
