"""Exact Jaccard join of shingle sets as a metric-space join, up to connected components.

Jaccard distance ``d`` is a metric; sets link when ``d <= E = 1 - similarity``.

**Cells of shingle pivots.**  Nearly all texts lie at distance 1 from each other, so whole
documents taken as pivots would tell nothing and their windows would hold every document.
The first pivots are therefore the sets {s} of one shingle, which split the space finely:
``d(A, {s})`` is below 1 only for s in A.  A's pivots are ranked by one fixed order of all
shingles (common ones last, then by hash), and A's cell is that of its first.  The window:
a set within E of A lacks at most ``floor(E * |A|)`` of A's shingles, so the first shingle
that the two share is among the first ``floor(E * |A|) + 1`` of either.  A is replicated
to the cells of these, and to no others.

**Reach.**  If the first shingle that A and B share stands at place i of A, they share
``|A| - i`` at most, so a link needs ``|B| <= (1 + 1 / t) * (|A| - i) - |A|`` for similarity
t.  This is A's reach in that region.  Two documents are compared in a region only if each
is within the other's reach; where they meet again at a later shingle, the first meeting
has settled them.  As ``d`` is at least ``1 - |A| / |B|``, regions are cut into rings by size,
and a ring's smaller neighbours visit it only as far as they reach.

**Cells of document pivots.**  In each region some documents are pivots, and what is within
reach of them is compared: first by signatures, parity bitmaps whose differing bits are a
lower bound of the sets' difference, and where these leave a link open, by whole sets.  Those within E of a pivot are linked to it; each
goes to the Voronoi cell of its nearest pivot.  By the triangle inequality, a document
beyond ``2 * E`` of the pivot has no link into the cell; all others of the region whose
component is another are the cell's window.  Cell and window are a region of its own
in which cell meets window; the documents outside all cells form another.  Both recurse without
the pivots, until nothing in a region may still link two components.  Every link between
two components is found, none is guessed; links within a component that is known already
needn't be.

Common shingles: a shingle found twice within one task's stretch is counted over all
stretches; those in ``common`` documents or more are put last in the order.  The order can
be any for the result to be exact; this one keeps regions small.  The list has at most
``MOST_COMMON`` entries, the most common first, so a shingle that isn't in it has at most one
in ``MOST_COMMON`` of all places, or one place a stretch; only such are gathered by shingle in one task.

Shingles are 64-bit hashes of five lower-cased (A-Z) words.  Edge cases: fewer words than
five are one shingle; no words or null: no shingles, linked with nothing; equal sets are
one class, collapsed before the join; rows are judged each by its own text also if ids
repeat; any bigint is an id; a null id has the component of its links, or null; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import byte_sizes, discard, lean, materialize, screen_words, slices, without
from .components import components

STRETCH = 1 << 21  # shingles that a task counts at once
MOST_COMMON = 1 << 20  # entries of the broadcast list of common shingles (9 MB)
SCREEN_BITS = 1 << 26  # of the table of wanted texts (8 MB)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = textscan.buffer_of(texts, lower=True)
    spans = textscan.words(data, offsets)
    hashes, first = textscan.windows(spans, size)
    bounds = np.searchsorted(spans.row[first], np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        a, b = spans.row_start[i], spans.row_start[i + 1]
        if 0 < b - a < size:
            out.append(np.frombuffer(hashlib.blake2b(spans.hash[a:b].tobytes(), digest_size=8).digest(), dtype=np.uint64))
        else:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
    return out


def digest_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature(found: np.ndarray) -> bytes:
    """For each residue of the hashes modulo a power of two, at least their number, a bit: whether an odd number has it."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ, of the longer signature after it is folded to the shorter: no more than hashes in one set only."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batch: pa.RecordBatch, at: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column(at)
    sizes = byte_sizes(texts)
    for a, b in slices(sizes, 2 << 20):
        yield from enumerate(shingle_sets(texts.slice(a, b - a), size), a)


def common_shingles(docs: DataFrame, text_col: str, size: int, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and the power of two of their count; bounded in number by a count made first."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for batch in batches:
            for _, found in _sets(batch, 0, size):
                mark = hashlib.blake2b(found.tobytes(), digest_size=12).digest()
                if not len(found) or mark in seen:  # copies within the stretch
                    continue
                seen.add(mark)
                held.append(found)
                total += len(found)
                if total >= STRETCH:
                    yield flush(held)
                    held, total, seen = [], 0, set()
        if held:
            yield flush(held)

    counts = docs.select(text_col).mapInArrow(lean(run), "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= common)
    counts = materialize(counts.select("s", F.floor(F.log2("n")).cast("int").alias("power")), "common")
    least, total = 99, 0
    for r in sorted(counts.groupBy("power").count().collect(), key=lambda r: -r.power):
        total += r["count"]
        if total > MOST_COMMON:
            break
        least = r.power
    rows = counts.where(F.col("power") >= least).toPandas()
    s, power = rows.s.to_numpy(np.int64).view(np.uint64), rows.power.to_numpy(np.uint8)
    order = np.argsort(s)
    return s[order], power[order]


def ordered(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], many: int) -> np.ndarray:
    """The first ``many`` of a sorted set in the fixed order: by power of two if common, then by hash."""
    hashes, powers = common
    if not len(hashes):
        return found[:many]
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    power = np.where(hashes[at] == found, powers[at], 0)
    return found[np.argsort(power, kind="stable")[:many]]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def reach(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest size of a set that can link with one of ``n`` if the first shared shingle stands at ``place``."""
    return (100 + percent) * (n - place) // percent - n


class Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, common: int) -> None:
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
        self.common = self.spark.sparkContext.broadcast(common_shingles(docs, text_col, size, common))

    def rows(self) -> DataFrame:
        """(id, mark, n, digest, signature, prefix) of each document."""
        size, common, percent = self.size, self.common, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, digests, signatures, prefixes = [], [], [], []
                for _, found in _sets(batch, 2, size):
                    n.append(len(found))
                    digests.append(digest_of(found) if len(found) else None)
                    signatures.append(signature(found) if len(found) else None)
                    prefixes.append(ordered(found, common.value, prefix_length(len(found), percent)).tobytes() if len(found) else None)
                if n:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(prefixes, pa.binary())], names=["id", "mark", "n", "digest", "signature", "prefix"])

        return self.docs.mapInArrow(lean(run), "id bigint, mark bigint, n bigint, digest binary, signature binary, prefix binary")

    def regions(self, classes: DataFrame) -> DataFrame:
        """(rid, node, n, reach) of each shingle pivot's cell and window, where two classes or more may meet."""
        percent, common = self.percent, self.common

        def deal(hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known = common.value[0]
                for batch in batches:
                    for i in range(0, batch.num_rows, 256):
                        part = batch.slice(i, 256)
                        blobs = part.column(2).to_pylist()
                        many = np.array([len(b) // 8 for b in blobs])
                        n = np.repeat(np.asarray(part.column(1)), many)
                        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        rid = np.frombuffer(b"".join(blobs), dtype=np.int64)
                        value = rid.view(np.uint64)
                        listed = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value if len(known) else np.zeros(len(rid), dtype=bool)
                        keep = listed if hot else ~listed
                        node = np.repeat(np.asarray(part.column(0)), many)
                        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rid, node, n, reach(n, place, percent))], names=["rid", "node", "n", "reach"])

            return lean(run)

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # the last row, if it is the first of its region: not yet known to be shared
            last = None
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                rid = columns[0]
                if not len(rid):
                    continue
                again = np.empty(len(rid), dtype=bool)
                again[0] = last is not None and rid[0] == last
                again[1:] = rid[1:] == rid[:-1]
                keep = again.copy()
                keep[:-1] |= again[1:]
                rows = [c[keep] for c in columns]
                if held is not None and again[0]:
                    rows = [np.concatenate(([h], r)) for h, r in zip(held, rows, strict=True)]
                held = None if again[-1] else [c[-1] for c in columns]
                last = rid[-1]
                if len(rows[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=batch.schema.names)

        kind = "rid bigint, node bigint, n bigint, reach bigint"
        source = classes.select("node", "n", "prefix")
        few = source.mapInArrow(deal(False), kind).repartition("rid").sortWithinPartitions("rid").mapInArrow(lean(shared), kind)
        return few.unionByName(source.mapInArrow(deal(True), kind))

    def rings(self, shared: DataFrame) -> DataFrame:
        """(rid, node, n, reach, side): regions by size, and of regions with the same documents one.

        A ring spans sizes up to ``100 / percent`` times its least.  A set is at home in its
        own ring (side 1) and a visitor (side 2) in the next if its reach ends there.
        """
        width = math.log(100 / self.percent) if self.percent < 100 else 1.0
        ring = lambda c: F.floor(F.log(F.col(c).cast("double")) / width + 1e-9)
        at = shared.withColumn("home", ring("n")).withColumn("last", F.when(F.col("reach") >= F.col("n"), F.greatest(ring("reach"), "home")).otherwise(F.col("home")))
        dealt = at.select(F.explode(F.sequence("home", "last")).alias("ring"), "rid", "home", "node", "n", "reach")
        dealt = dealt.select(F.xxhash64("rid", "ring").alias("rid"), "node", "n", "reach", F.when(F.col("ring") == F.col("home"), 1).otherwise(2).alias("side"))
        early = F.min(F.when(F.col("reach") >= F.col("n"), F.col("n")))
        marks = dealt.groupBy("rid").agg(F.bit_xor(F.xxhash64("node", "side")).alias("x"), F.bit_xor(F.xxhash64("node", "side", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("size"), early.alias("least"), F.max("reach").alias("most"), F.min("side").alias("home"))
        marks = marks.where("size > 1 and least is not null and home = 1")
        live = dealt.join(marks, "rid").where("n <= most and reach >= least")
        return live.groupBy(F.xxhash64("x", "y", "size").alias("rid"), "node").agg(F.first("n").alias("n"), F.max("reach").alias("reach"), F.min("side").alias("side"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the ``wanted`` (node, mark, digest).

        A bit table of bounded size passes over most other texts; what it lets through by
        chance meets no digest and goes.
        """
        size = self.size
        bits, found_words = screen_words(wanted, "mark", wanted.count(), SCREEN_BITS)
        words = found_words.toPandas()
        table = np.zeros(bits // 64, dtype=np.uint64)
        table[words.word.to_numpy(np.int64)] = words.bits.to_numpy(np.int64).view(np.uint64)
        screen = self.spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                mark = np.asarray(batch.column(0)).view(np.uint64)
                at = mark & np.uint64(bits - 1)
                held = np.flatnonzero(screen.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
                picked = [i for i in held.tolist() if not (mark[i] in seen or seen.add(mark[i]))]
                for a in range(0, len(picked), 512):
                    some = batch.take(pa.array(picked[a : a + 512], pa.int64()))
                    found = [s for _, s in _sets(some, 1, size) if len(s)]
                    if found:
                        flat = pa.array(np.concatenate(found).view(np.int64))
                        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), flat)
                        yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in found], pa.binary()), lists], names=["digest", "shingles"])

        found = self.docs.select("mark", "text").mapInArrow(lean(run), "digest binary, shingles array<bigint>")
        return found.join(wanted.select("digest", "node"), "digest").groupBy("node").agg(F.first("shingles").alias("shingles"))

    def test(self, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(a, b, link, near, similarity) of pairs of classes.

        ``near`` is whether they may be within ``2E``: by their signatures, or by whole sets
        where the signatures leave a link open.
        """
        percent, wide = self.percent, max(0, 2 * self.percent - 100)

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_a, n_b, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
                most = [(p + q - max(differing(s, t), abs(p - q))) // 2 for p, q, s, t in zip(n_a, n_b, x, y, strict=True)]
                share = [(100 * m, p + q - m) for m, p, q in zip(most, n_a, n_b, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m >= percent * u for m, u in share], pa.bool_()), pa.array([m >= wide * u for m, u in share], pa.bool_())], names=["a", "b", "open", "near"])

        of = lambda k: wanted.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"signature_{k}"))
        signed = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "signature_a", "signature_b")
        bounded = materialize(signed.mapInArrow(lean(bound), "a bigint, b bigint, open boolean, near boolean"), "bounded")
        open_ = bounded.where("open").select("a", "b")
        far = bounded.where("not open").select("a", "b", F.lit(False).alias("link"), "near", F.lit(0.0).alias("similarity"))
        if open_.isEmpty():
            return far
        nodes = materialize(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(wanted.select("node", "mark", "digest"), "node"), "open")
        sets = materialize(self.sets(nodes), "sets")
        side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}"))
        shared = open_.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("bigint").alias("shared"), (F.size("set_a") + F.size("set_b")).cast("bigint").alias("both"))
        shared = shared.withColumn("union", F.col("both") - F.col("shared"))
        exact = shared.select("a", "b", (100 * F.col("shared") >= percent * F.col("union")).alias("link"), (100 * F.col("shared") >= wide * F.col("union")).alias("near"), (F.col("shared") / F.col("union")).alias("similarity"))
        exact = materialize(exact, "exact")
        discard(sets, nodes)
        return exact.unionByName(far)

    @staticmethod
    def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    @staticmethod
    def live(rows: DataFrame) -> DataFrame:
        """``rows`` (with label) that may have a partner of another label in their region, with the region's largest label."""
        early = F.min(F.when(F.col("reach") >= F.col("n"), F.col("n")))
        by_label = rows.groupBy("rid", "label").agg(F.count(F.lit(1)).alias("like"), early.alias("least"), F.max("reach").alias("most"), F.min("side").alias("home"))
        region = by_label.groupBy("rid").agg(F.max_by("label", F.struct("like", "label")).alias("big"), F.count(F.lit(1)).alias("labels"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("home").alias("home"))
        region = region.where("labels > 1 and least is not null and home = 1").select("rid", "big", "least", "most")
        return rows.join(region, "rid").where("n <= most and reach >= least").drop("least", "most")

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(id, n, digest) of each document; (digest, node, least) of each class; (node, label) of linked classes."""
        every = materialize(self.rows(), "prefixes")
        grouped = every.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.first("mark").alias("mark"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("prefix").alias("prefix"))
        classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
        members, prefixes = materialize(every.select("id", "n", "digest"), "members"), every
        discard(prefixes)
        shared = materialize(self.regions(classes), "shared")
        prefixed, classes = classes, materialize(classes.drop("prefix"), "classes")
        discard(prefixed)
        rows = materialize(self.rings(shared), "rings")
        wanted = materialize(rows.select("node").distinct().join(classes.select("node", "n", "mark", "digest", "signature"), "node"), "wanted")
        discard(shared)
        # Pivots are those of the earliest place: they lack least of what the region shares, so they are central in it.
        place = F.col("n") - self.percent * (F.col("n") + F.col("reach")) / (100 + self.percent)
        labels, older, buckets = None, [rows], 1
        while True:
            live = materialize(self.live(self.labelled(rows, labels)), "live")
            discard(*older)
            chosen = live.where("label != big" if labels is not None else "true").groupBy("rid", F.pmod(F.xxhash64("node", F.lit(buckets)), F.lit(buckets)).alias("bucket"))
            pivots = chosen.agg(F.min(F.struct(place.alias("place"), "node", "n", "reach", "side", "label")).alias("v"))
            pivots = materialize(pivots.select("rid", *(F.col(f"v.{c}").alias(c if c == "rid" else f"{c}_p") for c in ("node", "n", "reach", "side", "label"))), "pivots")
            if pivots.isEmpty():
                discard(live, pivots)
                break
            meet = (F.col("label") != F.col("label_p")) & (F.col("side") + F.col("side_p") < 4) & (F.col("n") <= F.col("reach_p")) & (F.col("n_p") <= F.col("reach"))
            tried = materialize(live.join(pivots, "rid").where(meet).select("rid", "node", "node_p", F.least("node", "node_p").alias("a"), F.greatest("node", "node_p").alias("b")), "tried")
            tested = materialize(self.test(tried.select("a", "b").distinct(), wanted), "tested")
            links = tested.where("link").select("a", "b")
            if not links.isEmpty():
                labels = components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
            rows = materialize(self.split(live, pivots, tried.join(tested, ["a", "b"]), labels), "recursion")
            discard(tried, tested, pivots, live)
            older, buckets = [rows], min(512, buckets * 16)
        discard(wanted)
        return members, classes.select("digest", "node", "least"), labels

    def split(self, live: DataFrame, pivots: DataFrame, found: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The regions of the next round: cells of pivots with their windows, and what lies outside all cells."""
        closest = F.max_by("node_p", F.struct("similarity", -F.col("node_p")))
        cell = found.where("link").groupBy("rid", "node").agg(closest.alias("cell"))
        rest = live.select("rid", "node", "n", "reach", "side").join(pivots.select("rid", F.col("node_p").alias("node")), ["rid", "node"], "left_anti").join(cell, ["rid", "node"], "left")
        rest = self.labelled(rest, labels)
        outside = rest.where("cell is null").select("rid", "node", "n", "reach", "side")
        inside = rest.where("cell is not null")
        core = inside.select(F.xxhash64("rid", "cell").alias("rid"), "node", "n", "reach", F.lit(1).alias("side"))
        cells = inside.groupBy("rid", "cell").agg(F.min("label").alias("label_c"), F.min("n").alias("least"), F.max("reach").alias("most")).withColumnRenamed("cell", "pivot")
        window = rest.join(cells, "rid").where("label != label_c and n <= most and reach >= least")
        window = window.join(found.where("not near").select("rid", "node", F.col("node_p").alias("pivot")), ["rid", "node", "pivot"], "left_anti")
        return outside.unionByName(core).unionByName(window.select(F.xxhash64("rid", "pivot").alias("rid"), "node", "n", "reach", F.lit(2).alias("side")))


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, common: int) -> DataFrame:
    """(id, n, digest, label, component) of each row; label and component are null without words."""
    members, classes, labels = Join(docs, id_col, text_col, size, percent, common).run()
    named = classes.withColumn("label", F.col("node")) if labels is None else Join.labelled(classes, labels)
    named = materialize(named.select("digest", "label", "least"), "named")
    found = named.join(named.groupBy("label").agg(F.min("least").alias("component")), "label")
    return members.join(found.select("digest", "label", "component"), "digest", "left")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, common: int = 4) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row: the least id that links reach, its own included."""
    out = _linked(docs, id_col, text_col, size, percent, common)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, common: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the least id.  Rows without words stay.

    Where the least id is null or stands in several rows, one row stays: that of the least
    digest of its shingles, then of the least digest of its whole row.
    """
    linked = materialize(_linked(docs, id_col, text_col, size, percent, common), "linked")
    unclear = linked.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or id is null")
    if not unclear.isEmpty():
        return _keep_rows(docs, linked, id_col, text_col, size)
    return without(docs, linked.where("n > 0 and id != component").select("id"), id_col)


def _keep_rows(docs: DataFrame, linked: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """:func:`keep_one` where an id doesn't tell rows apart: rows get numbers of their own."""
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [digest_of(s) if len(s) else None for _, s in _sets(batch, 2, size)]
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=["_row", "id", "digest"])

    ids = numbered.select("_row", F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(*docs.columns).alias("whole"))
    rows = ids.select("_row", "id", "text").mapInArrow(lean(run), "_row bigint, id bigint, digest binary").where("digest is not null")
    rows = rows.join(ids.select("_row", "whole"), "_row").join(linked.select("digest", "label").distinct(), "digest")
    kept = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "whole", "_row")).alias("first")).select("first._row")
    lost = rows.select("_row").join(kept, "_row", "left_anti")
    return numbered.join(lost, "_row", "left_anti").select(docs.columns)
