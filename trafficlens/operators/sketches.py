"""Mergeable sketches with explicit bounds.

Each is fed by ``update(key, weight)``, answers ``estimate(key)``, merges with its like and
turns to and from snapshot bytes.  Feed pre-aggregated (key, weight) pairs where order
doesn't matter: Spark adds them up first.
"""

from __future__ import annotations

import heapq
import math
import struct
from abc import ABC, abstractmethod

import numpy as np

from .hashing import MASK, RowHash, RowHashes, hash64, splitmix64
from .snapshot import Cursor, Incompatible, SnapshotError, blob, read_snapshot, write_snapshot


class Sketch(ABC):
    algorithm: str
    seed: int
    updates: int

    @abstractmethod
    def update(self, key: bytes, weight: int = 1) -> None: ...

    @abstractmethod
    def estimate(self, key: bytes = b"") -> float: ...

    @abstractmethod
    def params(self) -> bytes: ...

    @abstractmethod
    def payload(self) -> bytes: ...

    @abstractmethod
    def _merge(self, other: Sketch) -> None: ...

    @classmethod
    @abstractmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> Sketch: ...

    def compatibility(self) -> tuple:
        return self.algorithm, self.seed, self.params()

    def merge(self, other: Sketch) -> Sketch:
        if self.compatibility() != other.compatibility():
            raise Incompatible(f"{self.compatibility()} and {other.compatibility()} can't be merged")
        self._merge(other)
        self.updates += other.updates
        return self

    def dump(self, start: int = 0, end: int = 0) -> bytes:
        return write_snapshot(self.algorithm, self.seed, start, end, self.params(), self.payload())

    @classmethod
    def load(cls, data: bytes) -> Sketch:
        head, payload = read_snapshot(data)
        if cls is not Sketch and head.algorithm != cls.algorithm:
            raise SnapshotError(f"{head.algorithm} where {cls.algorithm} is expected")
        if head.algorithm not in KINDS:
            raise SnapshotError(f"no sketch for {head.algorithm}")
        params, body = Cursor(head.params), Cursor(payload)
        try:
            out = KINDS[head.algorithm]._load(params, body, head.seed)
        except (ValueError, MemoryError) as e:
            raise SnapshotError(str(e)) from e
        params.end()
        body.end()
        return out


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise SnapshotError(what)


class CountMin(Sketch):
    """Never below the truth; above it by epsilon * total with probability delta at most."""

    algorithm = "count-min"

    def __init__(self, width: int, depth: int, conservative: bool = True, seed: int = 0) -> None:
        if width < 1 or depth < 1 or width * depth > 1 << 28:
            raise ValueError("width and depth must be positive and their product moderate")
        self.width, self.depth, self.conservative, self.seed = width, depth, conservative, seed
        self.table, self.total, self.updates = np.zeros((depth, width), dtype=np.uint64), 0, 0

    @property
    def epsilon(self) -> float:
        return math.e / self.width

    @property
    def delta(self) -> float:
        return math.exp(-self.depth) + 2.0**-64

    def _cells(self, key: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = RowHash.of(key, self.seed)
        return np.arange(self.depth), np.array([h.index(r, self.width) for r in range(self.depth)])

    def update(self, key: bytes, weight: int = 1) -> None:
        at = self._cells(key)
        now = self.table[at]
        self.table[at] = np.maximum(now, now.min() + np.uint64(weight)) if self.conservative else now + np.uint64(weight)
        self.total, self.updates = self.total + weight, self.updates + 1

    def estimate(self, key: bytes = b"") -> int:
        return int(self.table[self._cells(key)].min())

    def _merge(self, other: CountMin) -> None:
        self.table += other.table
        self.total += other.total

    def params(self) -> bytes:
        return struct.pack("<IIB", self.width, self.depth, self.conservative)

    def payload(self) -> bytes:
        return struct.pack("<QQ", self.total, self.updates) + self.table.astype("<u8").tobytes()

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> CountMin:
        width, depth, flag = (params.number(f) for f in "IIB")
        _need(flag < 2 and width * depth * 8 <= len(payload.data), "count-min sizes don't fit")
        out = cls(width, depth, bool(flag), seed)
        out.total, out.updates = payload.number("Q"), payload.number("Q")
        out.table = np.frombuffer(payload.take(8 * width * depth), dtype="<u8").reshape(depth, width).astype(np.uint64)
        return out


class CountSketch(Sketch):
    """Signed counts; the median over rows, towards zero between two middle rows."""

    algorithm = "count-sketch"

    def __init__(self, width: int, depth: int, seed: int = 0) -> None:
        if width < 1 or depth < 1 or width * depth > 1 << 28:
            raise ValueError("width and depth must be positive and their product moderate")
        self.width, self.depth, self.seed = width, depth, seed
        self.table, self.updates = np.zeros((depth, width), dtype=np.int64), 0

    def _cells(self, key: bytes) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        h = RowHash.of(key, self.seed)
        rows = range(self.depth)
        return (np.arange(self.depth), np.array([h.index(r, self.width) for r in rows])), np.array([h.sign(r) for r in rows])

    def update(self, key: bytes, weight: int = 1) -> None:
        at, sign = self._cells(key)
        self.table[at] += sign * weight
        self.updates += 1

    def update_many(self, keys: list[bytes], weights: np.ndarray, hashes: RowHashes | None = None) -> None:
        """``update`` of each key.  A subclass that has its own is asked key by key."""
        if type(self).update is not CountSketch.update:
            for key, weight in zip(keys, weights.tolist(), strict=True):
                self.update(key, weight)
            return
        hashes = hashes or RowHashes.of(keys, self.seed)
        for r in range(self.depth):
            np.add.at(self.table[r], hashes.index(r, self.width), hashes.sign(r) * weights)
        self.updates += len(keys)

    def estimate_many(self, hashes: RowHashes) -> np.ndarray:
        """``estimate`` of each key."""
        v = np.sort([self.table[r][hashes.index(r, self.width)] * hashes.sign(r) for r in range(self.depth)], axis=0)
        n = self.depth
        if n % 2:
            return v[n // 2]
        both = v[n // 2 - 1] + v[n // 2]
        return np.abs(both) // 2 * np.where(both >= 0, 1, -1)

    def estimate(self, key: bytes = b"") -> int:
        at, sign = self._cells(key)
        v = sorted((self.table[at] * sign).tolist())
        n = len(v)
        if n % 2:
            return v[n // 2]
        both = v[n // 2 - 1] + v[n // 2]
        return int(abs(both) // 2) * (1 if both >= 0 else -1)

    def _merge(self, other: CountSketch) -> None:
        self.table += other.table

    def params(self) -> bytes:
        return struct.pack("<II", self.width, self.depth)

    def payload(self) -> bytes:
        return struct.pack("<Q", self.updates) + self.table.astype("<i8").tobytes()

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> CountSketch:
        width, depth = params.number("I"), params.number("I")
        _need(width * depth * 8 <= len(payload.data), "count-sketch sizes don't fit")
        out = cls(width, depth, seed)
        out.updates = payload.number("Q")
        out.table = np.frombuffer(payload.take(8 * width * depth), dtype="<i8").reshape(depth, width).astype(np.int64)
        return out


def _sigma(x: float) -> float:
    if x == 1:
        return math.inf
    y, z, before = 1.0, x, None
    while z != before:
        x, before = x * x, z
        z += x * y
        y += y
    return z


def _tau(x: float) -> float:
    if x in (0.0, 1.0):
        return 0.0
    y, z, before = 1.0, 1 - x, None
    while z != before:
        x, before, y = math.sqrt(x), z, 0.5 * y
        z -= (1 - x) ** 2 * y
    return z / 3


class HyperLogLog(Sketch):
    """Distinct items; a sorted set of hashes, and so exact, until it would outgrow registers."""

    algorithm = "hll"
    ALPHA = 0.7213475204444817  # 1 / (2 ln 2)

    def __init__(self, precision: int, seed: int = 0) -> None:
        if not 4 <= precision <= 18:
            raise ValueError("precision must lie between 4 and 18")
        self.precision, self.seed, self.updates = precision, seed, 0
        self.few: set[int] | None = set()
        self.registers = np.zeros(0, dtype=np.uint8)

    @property
    def most_few(self) -> int:
        return max(1, (1 << self.precision) // 32)

    def _mark(self, h: int) -> None:
        rest = (h << self.precision) & MASK
        rho = min(64 - rest.bit_length() + 1, 65 - self.precision)
        i = h >> (64 - self.precision)
        self.registers[i] = max(self.registers[i], rho)

    def _put(self, h: int) -> None:
        if self.few is None:
            self._mark(h)
            return
        self.few.add(h)
        if len(self.few) > self.most_few:
            self._dense()

    def _dense(self) -> None:
        if self.few is not None:
            few, self.few = self.few, None
            self.registers = np.zeros(1 << self.precision, dtype=np.uint8)
            for h in few:
                self._mark(h)

    def update(self, key: bytes, weight: int = 1) -> None:
        self._put(hash64(key, self.seed))
        self.updates += 1

    def estimate(self, key: bytes = b"") -> float:
        if self.few is not None:
            return float(len(self.few))
        m, q = len(self.registers), 64 - self.precision
        counts = np.bincount(self.registers, minlength=q + 2)
        z = m * _tau(1 - counts[q + 1] / m)
        for rank in range(q, 0, -1):
            z = 0.5 * (z + counts[rank])
        return float(self.ALPHA * m * m / (z + m * _sigma(counts[0] / m)))

    cardinality = estimate

    @property
    def relative_error(self) -> float:
        return 1.04 / math.sqrt(1 << self.precision)

    def _merge(self, other: HyperLogLog) -> None:
        if other.few is not None:
            for h in other.few:
                self._put(h)
        else:
            self._dense()
            self.registers = np.maximum(self.registers, other.registers)

    def params(self) -> bytes:
        return struct.pack("<B", self.precision)

    def payload(self) -> bytes:
        head = struct.pack("<Q", self.updates)
        if self.few is not None:
            return head + struct.pack("<BI", 0, len(self.few)) + np.array(sorted(self.few), dtype="<u8").tobytes()
        return head + b"\x01" + self.registers.tobytes()

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> HyperLogLog:
        out = cls(params.number("B"), seed)
        out.updates = payload.number("Q")
        form = payload.number("B")
        _need(form < 2, "unknown hll encoding")
        if form == 0:
            n = payload.count(8)
            few = np.frombuffer(payload.take(8 * n), dtype="<u8").tolist()
            _need(n <= out.most_few and all(a < b for a, b in zip(few, few[1:], strict=False)), "hll hashes must be few, sorted and distinct")
            out.few = set(few)
        else:
            out.few = None
            out.registers = np.frombuffer(payload.take(1 << out.precision), dtype=np.uint8).copy()
            _need(int(out.registers.max()) <= 65 - out.precision, "hll register out of range")
        return out


class HllMap(Sketch):
    """An HLL for each key; when full, the key of least (cardinality, key) leaves."""

    algorithm = "hllmap"

    def __init__(self, max_keys: int, precision: int, seed: int = 0) -> None:
        if max_keys < 1:
            raise ValueError("max_keys must be positive")
        self.max_keys, self.precision, self.seed, self.updates, self.evicted = max_keys, precision, seed, 0, 0
        self.map: dict[bytes, HyperLogLog] = {}
        self.heap: list[tuple[float, bytes]] = []
        HyperLogLog(precision)

    def _evict(self) -> None:
        while True:
            size, key = heapq.heappop(self.heap)
            if key not in self.map:
                continue
            now = self.map[key].cardinality()
            if now == size:
                del self.map[key]
                self.evicted += 1
                return
            heapq.heappush(self.heap, (now, key))  # it has grown since

    def insert(self, key: bytes, item: bytes) -> None:
        if key not in self.map:
            if len(self.map) >= self.max_keys:
                self._evict()
            self.map[key] = HyperLogLog(self.precision, self.seed)
            heapq.heappush(self.heap, (0.0, key))
        self.map[key].update(item)
        self.updates += 1

    def update(self, key: bytes, weight: int = 1) -> None:
        self.insert(key, key)

    def estimate(self, key: bytes = b"") -> float:
        return self.map[key].cardinality() if key in self.map else 0.0

    def entries(self) -> list[tuple[bytes, float]]:
        return sorted(((k, h.cardinality()) for k, h in self.map.items()), key=lambda x: (-x[1], x[0]))

    def _merge(self, other: HllMap) -> None:
        for key, h in other.map.items():
            if key in self.map:
                self.map[key].merge(h)
            else:
                self.map[key] = HyperLogLog(self.precision, self.seed).merge(h)
        self.evicted += other.evicted
        for key, _ in self.entries()[self.max_keys :]:
            del self.map[key]
            self.evicted += 1
        self.heap = [(h.cardinality(), k) for k, h in self.map.items()]
        heapq.heapify(self.heap)

    def params(self) -> bytes:
        return struct.pack("<QB", self.max_keys, self.precision)

    def payload(self) -> bytes:
        rows = b"".join(blob(k) + blob(h.dump()) for k, h in sorted(self.map.items()))
        return struct.pack("<QQI", self.updates, self.evicted, len(self.map)) + rows

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> HllMap:
        out = cls(params.number("Q"), params.number("B"), seed)
        out.updates, out.evicted = payload.number("Q"), payload.number("Q")
        n, last = payload.count(8), None
        _need(n <= out.max_keys, "more keys than the map may hold")
        for _ in range(n):
            key, inner = payload.blob(), HyperLogLog.load(payload.blob())
            _need(last is None or last < key, "keys must be sorted and distinct")
            _need(inner.precision == out.precision and inner.seed == seed, "an inner sketch differs from its map")
            out.map[key], last = inner, key
        out.heap = [(h.cardinality(), k) for k, h in out.map.items()]
        heapq.heapify(out.heap)
        return out


class SpaceSaving(Sketch):
    """Weighted heavy hitters: ``count`` is at most ``error`` above the truth, never below."""

    algorithm = "spacesaving"

    def __init__(self, capacity: int, seed: int = 0) -> None:
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.seed, self.total, self.updates = capacity, seed, 0, 0
        self.entries: dict[bytes, list[int]] = {}
        self.heap: list[tuple[int, int, bytes]] = []

    @property
    def epsilon(self) -> float:
        return 1 / self.capacity

    def _push(self, key: bytes) -> None:
        heapq.heappush(self.heap, (self.entries[key][0], hash64(key, self.seed), key))

    def _least(self) -> tuple[int, int, bytes]:
        while True:
            count, mark, key = self.heap[0]
            now = self.entries.get(key)
            if now is not None and now[0] == count:
                return self.heap[0]
            heapq.heappop(self.heap)
            if now is not None:
                heapq.heappush(self.heap, (now[0], mark, key))

    def update(self, key: bytes, weight: int = 1) -> None:
        self.total, self.updates = self.total + weight, self.updates + 1
        if key in self.entries:
            self.entries[key][0] += weight  # its place in the heap is put right when it comes up
            return
        if len(self.entries) < self.capacity:
            self.entries[key] = [weight, 0]
        else:
            least, _, gone = self._least()
            heapq.heappop(self.heap)
            del self.entries[gone]
            self.entries[key] = [least + weight, least]
        self._push(key)

    def estimate(self, key: bytes = b"") -> int:
        return self.entries[key][0] if key in self.entries else 0

    def top(self, n: int | None = None) -> list[tuple[bytes, int, int]]:
        """(key, count, error), greatest first, ties by key."""
        return sorted(((k, c, e) for k, (c, e) in self.entries.items()), key=lambda x: (-x[1], x[0]))[:n]

    def floor(self) -> int:
        """What an absent key may have had: the least count if full, else nothing."""
        return min(c for c, _ in self.entries.values()) if len(self.entries) >= self.capacity else 0

    def _merge(self, other: SpaceSaving) -> None:
        mine, theirs = self.floor(), other.floor()
        out = {}
        for key in self.entries.keys() | other.entries.keys():
            a, b = self.entries.get(key, (mine, mine)), other.entries.get(key, (theirs, theirs))
            out[key] = [a[0] + b[0], a[1] + b[1]]
        kept = sorted(out.items(), key=lambda x: (-x[1][0], x[0]))[: self.capacity]
        self.entries, self.total, self.heap = dict(kept), self.total + other.total, []
        for key in self.entries:
            self._push(key)

    def params(self) -> bytes:
        return struct.pack("<Q", self.capacity)

    def payload(self) -> bytes:
        rows = b"".join(blob(k) + struct.pack("<QQ", c, e) for k, (c, e) in sorted(self.entries.items()))
        return struct.pack("<QQI", self.total, self.updates, len(self.entries)) + rows

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> SpaceSaving:
        out = cls(params.number("Q"), seed)
        out.total, out.updates = payload.number("Q"), payload.number("Q")
        n, last = payload.count(20), None
        _need(n <= out.capacity, "more entries than the capacity")
        for _ in range(n):
            key, count, error = payload.blob(), payload.number("Q"), payload.number("Q")
            _need((last is None or last < key) and error <= count, "entries must be sorted, distinct and above their error")
            out.entries[key], last = [count, error], key
            out._push(key)
        return out


class KeySample(Sketch):
    """Whole weights of the keys with the least hashes: a fair sample of distinct keys, and of all while they are few.

    A key leaves a full sample only if ``capacity`` keys have lesser hashes, and so never comes back: the weights of those
    that stay are exact, however keys are spread over the sketches that are merged.
    """

    algorithm = "key-sample"

    def __init__(self, capacity: int, seed: int = 0) -> None:
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.seed, self.updates, self.full = capacity, seed, 0, False
        self.counts: dict[int, int] = {}
        self.heap: list[int] = []  # of negated hashes

    def _add(self, h: int, weight: int) -> None:
        if h in self.counts:
            self.counts[h] += weight
        elif len(self.counts) < self.capacity:
            self.counts[h] = weight
            heapq.heappush(self.heap, -h)
        else:
            self.full = True
            if h < -self.heap[0]:
                del self.counts[-heapq.heapreplace(self.heap, -h)]
                self.counts[h] = weight

    def update(self, key: bytes, weight: int = 1) -> None:
        self._add(hash64(key, self.seed), weight)
        self.updates += 1

    def estimate(self, key: bytes = b"") -> int:
        return self.counts.get(hash64(key, self.seed), 0)

    def _merge(self, other: KeySample) -> None:
        for h, weight in other.counts.items():
            self._add(h, weight)
        self.full = self.full or other.full

    def params(self) -> bytes:
        return struct.pack("<Q", self.capacity)

    def payload(self) -> bytes:
        return struct.pack("<QBI", self.updates, self.full, len(self.counts)) + b"".join(struct.pack("<QQ", h, c) for h, c in sorted(self.counts.items()))

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> KeySample:
        out = cls(params.number("Q"), seed)
        out.updates, flag = payload.number("Q"), payload.number("B")
        n, last = payload.count(16), None
        _need(flag < 2 and n <= out.capacity and (not flag or n == out.capacity), "more or fewer keys than the sample holds")
        for _ in range(n):
            h, count = payload.number("Q"), payload.number("Q")
            _need((last is None or last < h) and count > 0, "hashes must be sorted, distinct and weighty")
            out.counts[h], last = count, h
        out.heap, out.full = [-h for h in out.counts], bool(flag)
        heapq.heapify(out.heap)
        return out


class MisraGries(Sketch):
    """Lower bounds: the truth is within total / (capacity + 1) above."""

    algorithm = "misra-gries"

    def __init__(self, capacity: int, seed: int = 0) -> None:
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.seed, self.total, self.updates = capacity, seed, 0, 0
        self.counts: dict[bytes, int] = {}

    @property
    def epsilon(self) -> float:
        return 1 / (self.capacity + 1)

    def _subtract(self, amount: int) -> None:
        self.counts = {k: c - amount for k, c in self.counts.items() if c > amount}

    def update(self, key: bytes, weight: int = 1) -> None:
        self.total, self.updates = self.total + weight, self.updates + 1
        while weight:
            if key in self.counts or len(self.counts) < self.capacity:
                self.counts[key] = self.counts.get(key, 0) + weight
                return
            amount = min(weight, min(self.counts.values()))
            self._subtract(amount)
            weight -= amount

    def estimate(self, key: bytes = b"") -> int:
        return self.counts.get(key, 0)

    def candidates(self) -> list[tuple[bytes, int]]:
        return sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))

    def _merge(self, other: MisraGries) -> None:
        for key, count in other.counts.items():
            self.counts[key] = self.counts.get(key, 0) + count
        excess = len(self.counts) - self.capacity
        if excess > 0:
            self._subtract(sorted(self.counts.values())[excess - 1])
        self.total += other.total

    def params(self) -> bytes:
        return struct.pack("<Q", self.capacity)

    def payload(self) -> bytes:
        return struct.pack("<QQI", self.total, self.updates, len(self.counts)) + b"".join(blob(k) + struct.pack("<Q", c) for k, c in sorted(self.counts.items()))

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> MisraGries:
        out = cls(params.number("Q"), seed)
        out.total, out.updates = payload.number("Q"), payload.number("Q")
        n, last = payload.count(12), None
        _need(n <= out.capacity, "more entries than the capacity")
        for _ in range(n):
            key, count = payload.blob(), payload.number("Q")
            _need((last is None or last < key) and count > 0, "entries must be sorted, distinct and positive")
            out.counts[key], last = count, key
        return out


class Kll(Sketch):
    """Quantiles of whole numbers; ranks are within about 2.3 / k."""

    algorithm = "kll"

    def __init__(self, k: int, seed: int = 0) -> None:
        if k < 8:
            raise ValueError("k must be 8 or more")
        self.k, self.seed, self.n, self.updates = k, seed, 0, 0
        self.rng = splitmix64(seed ^ 0x6B6C6C00)  # a fixed tag
        self.levels: list[list[int]] = [[]]

    @property
    def rank_error(self) -> float:
        return 2.3 / self.k

    def _room(self, level: int) -> int:
        room = self.k
        for _ in range(len(self.levels) - 1 - level):
            room = room * 2 // 3
        return max(8, room)

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) > self._room(level):
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.rng = splitmix64(self.rng)
                self.levels[level + 1] += sorted(self.levels[level])[self.rng & 1 :: 2]
                self.levels[level] = []
            level += 1

    def insert(self, value: int) -> None:
        self.n, self.updates = self.n + 1, self.updates + 1
        self.levels[0].append(value)
        self._compress()

    def insert_many(self, values: list[int]) -> None:
        for value in values:
            self.insert(value)

    def update(self, key: bytes, weight: int = 1) -> None:
        self.insert(weight)

    def _weighted(self) -> list[tuple[int, int]]:
        return sorted((v, 1 << i) for i, level in enumerate(self.levels) for v in level)

    def quantile(self, q: float) -> int | None:
        if not self.n:
            return None
        items = self._weighted()
        target = max(1, math.ceil(min(1.0, max(0.0, q)) * sum(w for _, w in items)))
        upto = 0
        for v, w in items:
            upto += w
            if upto >= target:
                return v
        return items[-1][0]

    def rank(self, value: int) -> float:
        items = self._weighted()
        total = sum(w for _, w in items)
        return sum(w for v, w in items if v <= value) / total if total else 0.0

    def estimate(self, key: bytes = b"") -> float:
        middle = self.quantile(0.5)
        return math.nan if middle is None else float(middle)

    def _merge(self, other: Kll) -> None:
        self.levels += [[] for _ in range(len(other.levels) - len(self.levels))]
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine += theirs
        self.n += other.n
        self.rng = splitmix64(self.rng ^ other.rng)
        self._compress()

    def params(self) -> bytes:
        return struct.pack("<Q", self.k)

    def payload(self) -> bytes:
        rows = b"".join(struct.pack("<I", len(v)) + np.array(v, dtype="<u8").tobytes() for v in self.levels)
        return struct.pack("<QQQI", self.n, self.rng, self.updates, len(self.levels)) + rows

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> Kll:
        out = cls(params.number("Q"), seed)
        out.n, out.rng, out.updates = (payload.number("Q") for _ in range(3))
        levels = payload.count(4)
        _need(1 <= levels <= 64, "kll has 1 to 64 levels")
        out.levels = [np.frombuffer(payload.take(8 * payload.count(8)), dtype="<u8").tolist() for _ in range(levels)]
        return out


class ExactCounter(Sketch):
    """Counts and distinct sets: the ground truth of tests."""

    algorithm = "exact"

    def __init__(self, seed: int = 0) -> None:
        self.seed, self.total, self.updates = seed, 0, 0
        self.counts: dict[bytes, int] = {}
        self.sets: dict[bytes, set[bytes]] = {}

    def update(self, key: bytes, weight: int = 1) -> None:
        self.counts[key] = self.counts.get(key, 0) + weight
        self.total, self.updates = self.total + weight, self.updates + 1

    def insert(self, key: bytes, item: bytes) -> None:
        self.sets.setdefault(key, set()).add(item)

    def estimate(self, key: bytes = b"") -> int:
        return self.counts.get(key, 0)

    def distinct(self, key: bytes) -> int:
        return len(self.sets.get(key, ()))

    def top(self, n: int | None = None) -> list[tuple[bytes, int]]:
        return sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))[:n]

    def _merge(self, other: ExactCounter) -> None:
        for key, count in other.counts.items():
            self.counts[key] = self.counts.get(key, 0) + count
        for key, items in other.sets.items():
            self.sets.setdefault(key, set()).update(items)
        self.total += other.total

    def params(self) -> bytes:
        return b""

    def payload(self) -> bytes:
        counts = b"".join(blob(k) + struct.pack("<Q", c) for k, c in sorted(self.counts.items()))
        sets = b"".join(blob(k) + struct.pack("<I", len(s)) + b"".join(map(blob, sorted(s))) for k, s in sorted(self.sets.items()))
        return struct.pack("<QQI", self.total, self.updates, len(self.counts)) + counts + struct.pack("<I", len(self.sets)) + sets

    @classmethod
    def _load(cls, params: Cursor, payload: Cursor, seed: int) -> ExactCounter:
        out = cls(seed)
        out.total, out.updates = payload.number("Q"), payload.number("Q")
        for _ in range(payload.count(12)):
            key = payload.blob()
            out.counts[key] = payload.number("Q")
        for _ in range(payload.count(8)):
            key = payload.blob()
            out.sets[key] = {payload.blob() for _ in range(payload.count(4))}
        return out


KINDS: dict[str, type[Sketch]] = {c.algorithm: c for c in (CountMin, CountSketch, HyperLogLog, HllMap, SpaceSaving, MisraGries, Kll, ExactCounter, KeySample)}


def unevenness(weights: list[int]) -> float:
    """How many bits the entropy of these weights is below that of equal ones."""
    if not weights:
        return 0.0
    mean = sum(weights) / len(weights)
    return sum(w * math.log2(w / mean) for w in weights) / sum(weights)


def entropy_bits(head: SpaceSaving, tail: HyperLogLog, sample: KeySample | None = None) -> float | None:
    """Guaranteed counts of the head exactly, the rest spread over the untracked support: evenly, or as unevenly as ``sample`` is.

    With a sample only keys whose guaranteed count is the larger part of their count are the head: of others a part is unknown.
    A sample that holds every key gives the entropy itself.
    """
    if not head.total:
        return None
    if sample is not None and not sample.full:
        total = sum(sample.counts.values())
        return max(0.0, math.log2(total) - sum(w * math.log2(w) for w in sample.counts.values()) / total)
    known = {k: c - e for k, (c, e) in head.entries.items() if c > e and (sample is None or c >= 2 * e)}
    out = -sum(g / head.total * math.log2(g / head.total) for g in known.values())
    rest = head.total - sum(known.values())
    if rest > 0:
        each = rest / max(1.0, tail.cardinality() - len(head.entries if sample is None else known)) / head.total
        out -= rest / head.total * math.log2(each)
        if sample is not None:
            told = {hash64(k, sample.seed) for k in known}
            out -= rest / head.total * unevenness([w for h, w in sample.counts.items() if h not in told])
    return max(0.0, out)
