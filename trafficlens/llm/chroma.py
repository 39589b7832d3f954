"""Chroma audio fingerprints: from WAV bytes to packed integers, and their alignment.

PCM of 8, 16, 24 and 32 bits is brought to one rate.  Frames of audio are folded to twelve pitch classes.  Sixteen filters, differences of rectangle sums over
frames and classes, are read off an integral image; each gives two bits by three
thresholds, in Gray code, so a frame is an unsigned 32-bit integer.  Two recordings share integers
at one offset more than at others: offset histograms name the offset, and the share of
differing bits there says how alike they are.

Recordings of equal fingerprints are one class.  The search meets all classes with the query
classes, block by block: a table of the block's integers gives each recording's offset histograms, and
the bits of every offset that is hit often enough are compared there and then.

Edge cases: null, broken or too short audio has no fingerprint: class null, no matches;
silence has a fingerprint like any other; repeated rows are of one class; an empty table
gives empty tables.  Long audio is read whole.  Of offsets that tie in hits and distance from 0 the greater
is given.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_own, lean, materialize, slices
from .store import listing, open_read

RATE, FRAME, HOP = 4000, 1024, 512
WIDTH = 8  # frames that a filter may span
PLAYED = 256  # recordings rendered at once
TASK = 512  # recordings that a task aligns
READ = 64  # queries read at once
BLOCK = 1 << 18  # integers of queries that are met at once
MEETINGS = 1 << 20  # rows of a histogram before they are summed
PIECE = 16  # longest run: bounds what one run can meet
#: (kind, first class, classes, frames, thresholds): from a rule, not a table.
FILTERS = [(k % 4, (5 * k) % 12, 2 + k % 5, 1 + k % WIDTH, (-0.25, 0.0, 0.25)) for k in range(16)]
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint64)


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV of samples in -1 to 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def samples_of(media: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples and rate of a PCM WAV, or None if it can't be read."""
    try:
        with wave.open(io.BytesIO(media or b""), "rb") as w:
            width, rate, channels = w.getsampwidth(), w.getframerate(), w.getnchannels()
            data = np.frombuffer(w.readframes(w.getnframes()), dtype=np.uint8).reshape(-1, width)
            if width == 1:  # unsigned
                raw = (data[:, 0].astype(np.float64) - 128) / 128
            else:  # little-endian, as the high bytes of 32 bits
                whole = np.zeros((len(data), 4), dtype=np.uint8)
                whole[:, 4 - width :] = data
                raw = whole.view("<i4")[:, 0] / 2.0**31
            return (raw.reshape(-1, channels).mean(1), rate) if rate > 0 else None
    except (wave.Error, EOFError, ValueError):
        return None


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """The sound at another rate, through its spectrum, without what the lower rate can't hold."""
    n = round(len(samples) * to / rate)
    if rate == to or not n:
        return samples[:n]
    return np.fft.irfft(np.fft.rfft(samples)[: n // 2 + 1], n) * (n / len(samples))


_classes: dict[int, np.ndarray] = {}


def _fold(rate: int) -> np.ndarray:
    """The matrix from spectrum bins to pitch classes, 55 Hz to 1760 Hz."""
    if rate not in _classes:
        hz = np.fft.rfftfreq(FRAME, 1 / rate)
        ok = (hz >= 55) & (hz <= 1760)
        fold = np.zeros((len(hz), 12))
        fold[np.flatnonzero(ok), np.round(12 * np.log2(hz[ok] / 55)).astype(int) % 12] = 1
        _classes[rate] = fold
    return _classes[rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve classes, each frame of unit length (silence: zeros)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames)) ** 2 @ _fold(rate)
    norm = np.linalg.norm(power, axis=1, keepdims=True)
    return np.divide(power, norm, out=np.zeros_like(power), where=norm > 1e-6)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A packed integer for each start of ``WIDTH`` frames."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    wrapped = np.concatenate((image, image), axis=1)  # classes are a circle
    total = np.zeros((len(image) + 1, 25))
    np.cumsum(np.cumsum(wrapped, axis=0), axis=1, out=total[1:, 1:])

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        at = np.arange(n)
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(n, dtype=np.uint64)
    for kind, c, high, long, limits in FILTERS:
        t, half, mid = max(long, 2) if kind in (1, 3) else long, max(1, max(long, 2) // 2), max(1, high // 2)
        if kind == 0:  # low classes against high ones
            value = area(0, t, c, c + mid) - area(0, t, c + mid, c + high)
        elif kind == 1:  # early frames against late ones
            value = area(0, half, c, c + high) - area(half, 2 * half, c, c + high)
        elif kind == 2:  # a band against the next
            value = area(0, t, c, c + high) - area(0, t, (c + high) % 12, (c + high) % 12 + high)
        else:  # a chequer
            value = area(0, half, c, c + mid) + area(half, 2 * half, c + mid, c + high) - area(0, half, c + mid, c + high) - area(half, 2 * half, c, c + mid)
        out = out << np.uint64(2) | _GRAY[np.searchsorted(np.array(limits) * t, value, side="right")]
    return out.astype(np.uint32)


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id_col, prints): packed integers of each recording, as 64-bit array, null if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                read = samples_of(x.as_py())
                got = fingerprint(chroma(resample(*read), RATE)) if read else ()
                out.append(got.astype(np.int64).tolist() if len(got) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[id_col, "prints"])

    inner = drop_own(media, ["prints"]).select(id_col, media_col)
    return inner.mapInArrow(run, f"`{id_col}` {inner.schema[0].dataType.simpleString()}, prints array<bigint>")


def bit_errors(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap, and the share of differing bits, of x[i + offset] and y[i]."""
    a, b = max(offset, 0), max(-offset, 0)
    n = min(len(x) - a, len(y) - b)
    if n < 1:
        return 0, 1.0
    return n, float(np.bitwise_count(x[a : a + n].astype(np.uint32) ^ y[b : b + n].astype(np.uint32)).sum() / (32 * n))


def runs(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, integer, place and length of each run of one integer, of rows laid end to end; runs over ``PIECE`` are cut."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - (np.cumsum(lengths) - lengths)[row]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    since = np.arange(len(values)) - np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    at = np.flatnonzero(since % PIECE == 0)
    return row[at], values[at], place[at], np.diff(np.append(at, len(values)))


class Block:
    """Fingerprints of some queries, laid end to end, with their runs in order of the integer."""

    def __init__(self, owner: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        self.owner, self.values, self.lengths, self.starts = owner, values, lengths, np.cumsum(lengths) - lengths
        row, value, at, long = runs(values, lengths)
        order = np.argsort(value, kind="stable")
        self.row, self.value, self.at, self.long = row[order], value[order], at[order], long[order]
        self.held = np.concatenate(([0], np.cumsum(self.long)))

    def hits(self, values: np.ndarray, lengths: np.ndarray, min_hits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, query, offset and hits of each offset with ``min_hits`` equal integers, rows being recordings laid end to end.

        Two runs of one integer give each offset at which they overlap the length of the overlap.
        """
        row, value, at, long = runs(values, lengths)
        left, right = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        reach = int(lengths.max(initial=0))
        span = reach + int(self.lengths.max(initial=0)) + 1
        cost = self.held[right] - self.held[left] + (right - left) * (long - 1)
        parts, waiting, most = [], 0, 4 * MEETINGS
        for start, end in slices(cost, MEETINGS):
            n = (right - left)[start:end]
            mine = np.repeat(np.arange(start, end), n)
            its = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + left[mine]
            low = self.at[its] - at[mine] - long[mine] + 1
            many = self.long[its] + long[mine] - 1
            pair = np.repeat(np.arange(len(many)), many)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            equal = np.minimum(np.minimum(step + 1, many[pair] - step), np.minimum(self.long[its], long[mine])[pair])
            key = ((row[mine] * len(self.owner) + self.row[its]) * span + low + reach)[pair] + step
            parts.append(_summed(key, equal))
            waiting += len(parts[-1][0])
            if waiting > most:
                parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
                waiting = len(parts[0][0])
                most = max(most, 2 * waiting)
        if not parts:
            return (np.zeros(0, dtype=np.int64),) * 4
        key, n = _summed(*map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0]
        key, n = key[n >= min_hits], n[n >= min_hits]
        both, offset = np.divmod(key, span)
        return *np.divmod(both, len(self.owner)), offset - reach, n

    def best(self, values: np.ndarray, lengths: np.ndarray, min_hits: int, min_overlap: int, max_error: float) -> tuple[np.ndarray, ...]:
        """Row, query, offset, hits, overlap and bit error of each pair that is alike, at its best offset."""
        row, query, offset, n = self.hits(values, lengths, min_hits)
        skip_x, skip_y = np.maximum(offset, 0), np.maximum(-offset, 0)
        overlap = np.minimum(self.lengths[query] - skip_x, lengths[row] - skip_y)
        ok = np.flatnonzero(overlap >= max(min_overlap, 1))
        from_x, from_y, overlap = (self.starts[query] + skip_x)[ok], ((np.cumsum(lengths) - lengths)[row] + skip_y)[ok], overlap[ok]
        error = np.zeros(len(ok))
        for start, end in slices(overlap, MEETINGS):
            long = overlap[start:end]
            first = np.cumsum(long) - long
            at = np.arange(long.sum())
            bits = np.bitwise_count(self.values[at + np.repeat(from_x[start:end] - first, long)] ^ values[at + np.repeat(from_y[start:end] - first, long)])
            error[start:end] = np.add.reduceat(bits, first, dtype=np.int64) / (32 * long)
        like = error <= max_error
        ok, overlap, error = ok[like], overlap[like], error[like]
        row, query, offset, n = row[ok], query[ok], offset[ok], n[ok]
        order = np.lexsort((-offset, np.abs(offset), -n, query, row))
        both = row[order] * len(self.owner) + query[order]
        top = order[np.flatnonzero(np.diff(both, prepend=-1))]
        return row[top], query[top], offset[top], n[top], overlap[top], error[top]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n[:0]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, integers laid end to end, and how many each class has, of (class, prints)."""
    lists = batch.column(1)
    return batch.column(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(files: list[str]) -> Iterator[Block]:
    """The queries of Parquet files of (class, prints), in blocks of about ``BLOCK`` integers."""
    held, size = [], 0

    def block() -> Block:
        return Block(*map(np.concatenate, zip(*held, strict=True)))

    for uri in files:
        with open_read(uri) as f:
            for batch in pq.ParquetFile(f).iter_batches(READ, columns=["class", "prints"]):
                owner, values, lengths = _flat(batch)
                ends = np.cumsum(lengths)
                for start, end in slices(lengths, BLOCK):
                    n = int(lengths[start:end].sum())
                    if held and size + n > BLOCK:
                        yield block()
                        held, size = [], 0
                    held.append((owner[start:end], values[ends[end - 1] - n : ends[end - 1]], lengths[start:end]))
                    size += n
    if held:
        yield block()


def align(prints: DataFrame, queries: DataFrame, id_col: str, min_hits: int = 3, min_overlap: int = 8, max_error: float = 0.15) -> DataFrame:
    """(query_class, class, offset, hits, overlap, bit_error) of classes alike, of ``class_of`` tables.

    ``prints`` and ``queries`` are (class, prints).  The queries are written to the shared folder, and each task
    meets its recordings with all of them, a block of bounded size after the other, so no integer is
    shuffled.  Every place of an integer counts, and a held note costs by its length and not by the square.
    Every offset of ``min_hits`` is tested; of those that pass, a pair has the one of most hits, then the nearest.
    """
    asked = materialize(queries.select("class", "prints"), "print-queries")
    files = [uri for uri, size in listing(prints.sparkSession, asked._scratch, ".parquet") if size]
    tasks = max(1, -(-prints.count() // TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, values, lengths = _flat(batch)
            for block in _blocks(files):
                row, query, offset, n, overlap, error = block.best(values, lengths, min_hits, min_overlap, max_error)
                other = block.owner[query] != owner[row]
                columns = [block.owner[query], owner[row], offset.astype(np.int32), n, overlap, error]
                yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in columns], names=["query_class", "class", "offset", "hits", "overlap", "bit_error"])

    given = prints.select("class", "prints").repartition(tasks, "class")
    return given.mapInArrow(lean(run), "query_class bigint, class bigint, offset int, hits bigint, overlap bigint, bit_error double")


def classes(found: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(id_col, class) of each recording, and (class, prints) of each class: the least id of equal fingerprints."""
    marked = found.withColumn("mark", F.when(F.col("prints").isNotNull(), F.md5(F.concat_ws(",", F.col("prints").cast("array<string>")))))
    own = materialize(marked.where("mark is not null").groupBy("mark").agg(F.min(id_col).cast("bigint").alias("class"), F.min("prints").alias("prints")), "print-classes")
    return marked.select(id_col, "mark").join(own.select("mark", "class"), "mark", "left").select(id_col, "class"), own.where(F.col("class").isNotNull()).select("class", "prints")


def search(media: DataFrame, id_col: str, media_col: str, every: int = 50) -> DataFrame:
    """A row for each recording: its class, and for classes of queries (ids divisible by ``every``) those alike.

    (id_col, class, query, match_class, offset, hits, bit_error): one row for each match of
    the class, or one with nulls where there is none or the row isn't a query.
    """
    found = materialize(fingerprints(media, id_col, media_col), "fingerprints")
    members, prints = classes(found, id_col)
    members = materialize(members, "print-members")
    asked = members.where(F.col(id_col) % every == 0).select("class").distinct()
    matches = materialize(align(prints, prints.join(asked, "class", "left_semi"), id_col), "print-matches")
    # Members of one class ask the same: the matches are listed at the class' first query.
    first = members.where(F.col(id_col) % every == 0).groupBy("class").agg(F.min(id_col).alias("asker"))
    listed = matches.join(first.where("class is not null").withColumnRenamed("class", "query_class"), "query_class").select(F.col("asker").alias(id_col), F.col("class").alias("match_class"), "offset", "hits", "bit_error")
    query = (F.coalesce(F.col(id_col) % every, F.lit(1)) == 0).alias("query")
    return members.select(id_col, "class", query).join(listed, id_col, "left")


def render(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, media): each vector played as notes of two frames, one a component, as WAV.

    The test tables hold no sound; this gives the operator recordings of known likeness.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(2 * HOP) / RATE
        table = np.sin(2 * np.pi * 110 * 2 ** (np.arange(36) / 12)[:, None] * at) * 0.5
        for batch in batches:
            for i in range(0, batch.num_rows, PLAYED):
                part, out = batch.slice(i, PLAYED), []
                for v in part.column(1).to_pylist():
                    if not v or any(x is None for x in v):
                        out.append(None)
                        continue
                    v = np.array(v, dtype=np.float64)
                    scale = np.abs(v).max() or 1.0
                    out.append(wav_bytes(table[np.clip(np.round((v / scale + 1) * 17.5), 0, 35).astype(int)].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=[id_col, "media"])

    inner = vectors.select(id_col, vector_col)
    return inner.mapInArrow(run, f"`{id_col}` {inner.schema[0].dataType.simpleString()}, media binary")
