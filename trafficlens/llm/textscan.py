"""Words, lines and their 64-bit hashes, computed over whole Arrow buffers in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  These are ASCII, so on
UTF-8 bytes the words are the same as on code points.  The hash of a word is a polynomial
in random byte values modulo 2**64, taken from one running sum over the buffer, then mixed
with the word's length.  Words of over 128 bytes are hashed one by one by xxh3.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SEGMENT = 1 << 20
LONG_WORD = 128
_rng = np.random.default_rng(0x5EED)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SEGMENT + 1), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 23:
            _powers[base] = known
    return known[:n]


@dataclass
class Spans:
    """Runs of the buffer: where they start and end, and the row that each is in."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    row_start: np.ndarray  # for each row, the index of its first span; one more at the end


def buffer_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a newline after each, and the offset of each text."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("")
    if texts.type == pa.large_string():
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    else:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.insert(raw, offsets[1:], 10) if len(texts) else raw
    if lower:
        data = LOWER[data]
    return data, offsets + np.arange(len(offsets))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span; spans don't overlap and are in order."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = max(i + 1, int(np.searchsorted(end, at + SEGMENT, side="right")))
        if end[j - 1] - at > SEGMENT:  # one span that is longer than a segment
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), 3)
            i = j
            continue
        part = data[at : end[j - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[part] * _power_table(_BASE, len(part)), out=total[1:])
        s, e = start[i:j] - at, end[i:j] - at
        h = (total[e] - total[s]) * _power_table(_INVERSE, len(part) + 1)[s]
        out[i:j] = mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        i = j
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), 3)
    return out


def _spans(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spans:
    row_start = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(row_start))
    return Spans(start, end, row, _hash(data, start, end), row_start)


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """``data`` and ``offsets`` as :func:`buffer_of` gives them."""
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    return _spans(data, offsets, edge[0::2], edge[1::2])  # the last byte is a newline


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    end = np.flatnonzero(data == 10)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    return _spans(data, offsets, start, end)


def windows(spans: Spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, and the index of each window's first word."""
    n = len(spans.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = spans.hash[: n - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(0xA24BAED4963EE407) + spans.hash[k : n - size + 1 + k]
    inside = np.flatnonzero(spans.row[: n - size + 1] == spans.row[size - 1 :])
    return mix(h[inside]), inside
