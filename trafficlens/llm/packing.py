"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are dealt to shards of about ``shard_rows`` by a hash of their id, so only small
columns move.  Each shard packs its own, longest first.  Bins are kept by the room left in
them; each carries a bitmap of the duplicate clusters in it and bitmaps of
its sources, one plane for each permitted document of a source.  For a document, the search
starts at the least sufficient room and goes on to the next until the first, that is the
tightest, bin that conflicts in neither bitmap; if there is none, a bin is opened.

A text longer than a bin is cut into full bins, each its own, and a rest that is packed.
A bin holds at most ``per_source`` documents of a source and one of a cluster.

Edge cases: a null length counts as 0; documents of length 0 are packed like others and
take no room; null sources don't limit each other, null clusters don't conflict;
ties go by id, then source and cluster; repeated rows are packed each; an empty table gives
an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "part bigint, bin_id string, start bigint, n_tokens bigint"


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int, per_source: int) -> Iterator[tuple[int, int, int, int]]:
    """(length, source, cluster) in packing order to (part, bin, start, length) of each item's parts, item after item.

    Yields ``(-1, 0, 0, 0)`` after the last part of each item.
    """
    rooms: list[int] = []  # rooms of which there are bins, in order
    by_room: dict[int, list[int]] = {}
    clusters: list[int] = []
    planes: list[list[int]] = []
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    room_of: list[tuple[int, int]] = []  # room and time of the last change of each bin; full ones -1
    opened_for: dict[tuple[int, object, object], int] = {}

    def open_bin() -> int:
        clusters.append(0)
        planes.append([0] * per_source)
        room_of.append((-1, 0))
        return len(clusters) - 1

    def put(number: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(number)
        room_of[number] = room, next(clock)

    clock = count()
    for length, source, cluster in items:
        part = 0
        while length > capacity:
            yield part, open_bin(), 0, capacity  # full: never searched
            part, length = part + 1, length - capacity
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        fits = lambda number, c=c, s=s: not clusters[number] & c and not planes[number][-1] & s
        found, since = None, opened_for.get((length, source, cluster))
        if since is not None:
            # An equal document found no place in the bins before ``since``; what came into them since has made none fit.
            later = [(*room_of[i], i) for i in range(since, len(room_of)) if room_of[i][0] >= length and fits(i)]
            found = min(later)[2] if later else None
        else:
            for room in rooms[bisect_left(rooms, length) :]:
                found = next(filter(fits, by_room[room]), None)
                if found is not None:
                    break
        if found is None:
            number, room = open_bin(), capacity
            opened_for[length, source, cluster] = len(clusters) if c else len(clusters) - 1
        else:
            number, room = found, room_of[found][0]
            by_room[room].remove(number)
            if not by_room[room]:
                del by_room[room]
                del rooms[bisect_left(rooms, room)]
        clusters[number] |= c
        plane = planes[number]
        for k in range(per_source):
            if not plane[k] & s:
                plane[k] |= s
                break
        yield part, number, capacity - room, length
        put(number, room - length)
        yield -1, 0, 0, 0


def pack(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster", capacity: int = 2048, per_source: int = 2, shard_rows: int = 8192) -> DataFrame:
    """(id_col, part, bin_id, start, n_tokens): where each part of each document lies."""
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be positive")
    small = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col), F.lit(0)).cast("bigint").alias("length"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    small = small.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    id_type = small.schema["id"].dataType

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        ids = rows.id.tolist()
        items = [(n, s if isinstance(s, str) else None, c if isinstance(c, str) else None) for n, s, c in zip(rows.length.tolist(), rows.source, rows.cluster, strict=True)]
        out, at = [], 0
        for part, number, start, n in best_fit(items, capacity, per_source):
            if part < 0:
                at += 1
            else:
                out.append((ids[at], part, f"{key[0]}-{number}", start, n))
        return pd.DataFrame(out, columns=[id_col, "part", "bin_id", "start", "n_tokens"])

    return small.groupBy("shard").applyInPandas(run, f"`{id_col}` {id_type.simpleString()}, {OUT}")


def with_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (words and an end) and ``cluster`` (a digest of the words, without case), in place of the text."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    words = F.when(F.length("flat") == 0, 0).otherwise(F.length("flat") - F.length(F.translate("flat", " ", "")) + 1)
    kept = [c for c in docs.columns if c not in (text_col, "n_tokens", "cluster", "flat")]
    return docs.withColumn("flat", flat).select(*kept, (words + 1).cast("bigint").alias("n_tokens"), F.md5(F.col("flat")).alias("cluster"))
