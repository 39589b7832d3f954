"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

State is two tables.  ``counts`` holds, for each line key (a 128-bit digest), in how many
documents it is found.  ``filters`` holds, for each shard of the digest space, a cuckoo
filter of the keys that reached ``min_docs``.  Inserting or deleting documents adds or
subtracts counts; keys that cross the threshold enter or leave the filter of their shard,
so deletion restores what insertion made.  A filter may say yes to a key that isn't in
it.  The count table is exact, so each such key among the corpus' own is looked up there
and kept beside the filters as an exception: for documents of the state the answer is exact.

Filters go to the executors by broadcast, in waves of at most ``wave_bytes``; a corpus with
more frequent lines takes more passes over the texts, each with its own wave of shards.

Edge cases: null and empty texts are one empty line, which has no key and stays; a key
counts once a document however often it repeats there; each row is a document, also when
ids repeat or are null; an empty table gives an empty table; columns named ``n_lines`` or
``n_dropped`` are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_own, extend_schema, materialize, replace_column, text_bytes, with_columns

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SLOTS = 4
MAX_KICKS = 400


def line_key(line: bytes) -> bytes:
    """White space ``[\\x20\\x09-\\x0D]`` off both ends, A-Z lower-cased."""
    return line.strip().translate(_LOWER)


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Partial-key cuckoo filter: four 32-bit fingerprints a bucket, and an exact stash.

    A fingerprint that finds no place after ``MAX_KICKS`` moves goes to the stash, so no
    insertion fails.  ``add`` and ``remove`` take keys as (low, high) halves of a digest.
    """

    def __init__(self, buckets: int) -> None:
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint32)
        self.stash: list[tuple[int, int]] = []

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(keys, 1) / SLOTS / 0.85)))))

    def _places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (high >> np.uint64(32)).astype(np.uint32)
        mark[mark == 0] = 1
        first = low & mask
        return mark, first, first ^ (self._jump(mark) & mask)

    @staticmethod
    def _jump(mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        mask = len(self.table) - 1
        for mark, i, j in zip(*(x.tolist() for x in self._places(low, high)), strict=True):
            for at in (i, j):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
            else:
                at = j
                for kick in range(MAX_KICKS):
                    slot = (mark + kick) % SLOTS
                    mark, self.table[at, slot] = int(self.table[at, slot]), mark
                    at ^= int(self._jump(np.array([mark], dtype=np.uint32))[0]) & mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = mark
                        break
                else:
                    self.stash.append((at, mark))

    def remove(self, low: np.ndarray, high: np.ndarray) -> None:
        """Only of keys that were added."""
        for mark, i, j in zip(*(x.tolist() for x in self._places(low, high)), strict=True):
            for at in (i, j):
                there = np.flatnonzero(self.table[at] == mark)
                if len(there):
                    self.table[at, there[0]] = 0
                    break
            else:
                self.stash.remove((i, mark) if (i, mark) in self.stash else (j, mark))

    def has(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mark, i, j = self._places(low, high)
        found = (self.table[i.astype(np.int64)] == mark[:, None]).any(1) | (self.table[j.astype(np.int64)] == mark[:, None]).any(1)
        for at, stashed in self.stash:
            found |= (mark == stashed) & ((i == at) | (j == at))
        return found

    def dump(self) -> bytes:
        stash = np.array(self.stash, dtype=np.uint64).reshape(-1, 2)
        return np.array([len(self.table), len(stash)], dtype=np.uint64).tobytes() + self.table.tobytes() + stash.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        buckets, stashed = np.frombuffer(blob, dtype=np.uint64, count=2).tolist()
        out = cls(0)
        out.table = np.frombuffer(blob, dtype=np.uint32, offset=16, count=buckets * SLOTS).reshape(buckets, SLOTS).copy()
        out.stash = [tuple(x) for x in np.frombuffer(blob, dtype=np.uint64, offset=16 + out.table.nbytes, count=2 * stashed).reshape(-1, 2).tolist()]
        return out


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high & np.uint64(shards - 1)).astype(np.int64)


class Screen:
    """Filters of some shards, and the exceptions to them."""

    def __init__(self, shards: int, blobs: dict[int, bytes], exceptions: set[bytes]) -> None:
        self.shards, self.filters, self.exceptions = shards, {k: CuckooFilter.load(v) for k, v in blobs.items()}, exceptions

    def has(self, digests: list[bytes]) -> np.ndarray:
        out = np.zeros(len(digests), dtype=bool)
        if not digests:
            return out
        low, high = halves(digests)
        shard = shard_of(high, self.shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, cuckoo in self.filters.items():
            rows = order[bounds[s] : bounds[s + 1]]
            if len(rows):
                out[rows] = cuckoo.has(low[rows], high[rows])
        for i in np.flatnonzero(out) if self.exceptions else ():
            out[i] = digests[i] not in self.exceptions
        return out


_screens: dict[str, Screen] = {}


def _screen(broadcast, name: str) -> Screen:
    """Built once a worker process; only the last few waves are held."""
    if name not in _screens:
        while len(_screens) > 1:
            _screens.pop(next(iter(_screens)))
        _screens[name] = Screen(*broadcast.value)
    return _screens[name]


def count_lines(docs: DataFrame, text_col: str, min_length: int) -> DataFrame:
    """``key`` and ``n``, the documents that a key is found in; pre-added in Python and by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[bytes] = Counter()
            for text in text_bytes(batch.column(0)):
                keys = {line_key(x) for x in text.split(b"\n")}
                n.update(digest(k) for k in keys if k and (min_length <= 1 or len(k.decode()) >= min_length))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["key", "n"])

    return docs.select(text_col).mapInArrow(run, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class LineDedup:
    """Incremental line deduplication over a changing set of documents."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_length: int = 1, text_col: str = "text", shards: int = 64, wave_bytes: int = 64 << 20) -> None:
        if shards & (shards - 1):
            raise ValueError("shards must be a power of two")
        self.spark, self.min_docs, self.min_length, self.text_col, self.shards, self.wave_bytes = spark, min_docs, min_length, text_col, shards, wave_bytes
        self.counts = spark.createDataFrame([], "key binary, n bigint")
        self.filters = spark.createDataFrame([], "shard bigint, size bigint, blob binary")
        self._waves: list[tuple] | None = None

    def insert(self, docs: DataFrame) -> LineDedup:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineDedup:
        """``docs`` must have been inserted before."""
        return self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> LineDedup:
        new = count_lines(docs, self.text_col, self.min_length).select("key", F.lit(0).cast("bigint").alias("old"), (F.col("n") * sign).alias("change"))
        old = self.counts.select("key", F.col("n").alias("old"), F.lit(0).cast("bigint").alias("change"))
        both = old.unionByName(new).groupBy("key").agg(F.sum("old").alias("old"), F.sum("change").alias("change"))
        both = materialize(both.select("key", "old", (F.col("old") + F.col("change")).alias("n")), "line-counts")
        crossed = both.where((F.col("old") >= self.min_docs) != (F.col("n") >= self.min_docs))
        crossed = crossed.select(F.expr(f"cast(conv(hex(substring(key, 9, 1)), 16, 10) as bigint) & {self.shards - 1}").alias("shard"), "key", (F.col("n") >= self.min_docs).alias("enters")) if self.shards <= 256 else None
        if crossed is None:
            raise ValueError("at most 256 shards")

        def update(key: tuple, filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            enters = changes[changes.enters].key.tolist() if len(changes) else []
            leaves = changes[~changes.enters].key.tolist() if len(changes) else []
            size = (int(filters["size"].iloc[0]) if len(filters) else 0) + len(enters)
            cuckoo = CuckooFilter.load(filters.blob.iloc[0]) if len(filters) else CuckooFilter.sized(size)
            if enters:
                cuckoo.add(*halves(sorted(enters)))
            if leaves:
                cuckoo.remove(*halves(sorted(leaves)))
            return pd.DataFrame({"shard": [key[0]], "size": [size - len(leaves)], "blob": [cuckoo.dump()]})

        self.filters = materialize(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, self.filters.schema), "line-filters")
        self.counts = both.where("n != 0").select("key", "n")
        self._waves = None
        return self

    def waves(self) -> list[tuple]:
        """Broadcasts of (shards, filters, exceptions), each of bounded size."""
        if self._waves is None:
            sizes = sorted((r.shard, r.bytes) for r in self.filters.where("size > 0").select("shard", F.length("blob").alias("bytes")).collect())
            groups: list[list[int]] = []
            held = 0
            for shard, n in sizes:
                if not groups or held + n > self.wave_bytes:
                    groups.append([])
                    held = 0
                groups[-1].append(shard)
                held += n
            self._waves = []
            for group in groups:
                blobs = {r.shard: bytes(r.blob) for r in self.filters.where(F.col("shard").isin(group)).collect()}
                bare = self.spark.sparkContext.broadcast((self.shards, blobs, set()))
                wrong = self._false(bare, f"bare-{id(bare)}")
                self._waves.append((self.spark.sparkContext.broadcast((self.shards, blobs, wrong)), f"full-{id(bare)}-{len(self._waves)}"))
        return self._waves

    def _false(self, bare, name: str) -> set[bytes]:
        """Keys below the threshold that a filter says yes to: about two in a thousand million."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                hit = _screen(bare, name).has(keys)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, h in zip(keys, hit, strict=True) if h], pa.binary())], names=["key"])

        rare = self.counts.where(F.col("n") < self.min_docs).select("key").mapInArrow(run, "key binary")
        return {bytes(r.key) for r in rare.toLocalIterator()}

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` without their frequent lines, plus ``n_lines`` and ``n_dropped``."""
        docs = drop_own(docs, ["n_lines", "n_dropped"])
        text_col, min_length = self.text_col, self.min_length
        waves = self.waves() or [(self.spark.sparkContext.broadcast((self.shards, {}, set())), "none")]

        def one(df: DataFrame, wave: tuple, first: bool) -> DataFrame:
            broadcast, name = wave

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    screen = _screen(broadcast, name)
                    split = [t.split(b"\n") for t in text_bytes(batch.column(batch.schema.get_field_index(text_col)))]
                    keys = [line_key(x) for lines in split for x in lines]
                    known = [i for i, k in enumerate(keys) if k and (min_length <= 1 or len(k.decode()) >= min_length)]
                    drop = np.zeros(len(keys), dtype=bool)
                    drop[known] = screen.has([digest(keys[i]) for i in known])
                    texts, lost, at = [], [], 0
                    for lines in split:
                        gone = drop[at : at + len(lines)]
                        at += len(lines)
                        n = int(gone.sum())
                        lost.append(n)
                        texts.append(b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if n else b"\n".join(lines))
                    out = replace_column(batch, text_col, pa.array(texts, pa.binary()).cast(pa.string()))
                    if first:
                        yield with_columns(out, n_lines=pa.array([len(x) for x in split], pa.int64()), n_dropped=pa.array(lost, pa.int64()))
                    else:
                        dropped = pa.array(np.asarray(out.column(out.schema.get_field_index("n_dropped"))) + np.array(lost, dtype=np.int64))
                        yield replace_column(out, "n_dropped", dropped)

            schema = extend_schema(df, ("n_lines", T.LongType()), ("n_dropped", T.LongType())) if first else df.schema
            return df.mapInArrow(run, schema)

        def step(df: DataFrame, k: int) -> DataFrame:
            return one(df if k < 2 else materialize(df, "line-wave"), waves[k], not k)

        return reduce(step, range(len(waves)), docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, text_col: str = "text") -> DataFrame:
    """All of ``docs`` inserted into an empty state, then rid of the frequent lines."""
    return LineDedup(docs.sparkSession, min_docs, min_length, text_col).insert(docs).apply(docs)
