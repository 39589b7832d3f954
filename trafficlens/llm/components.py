"""Connected components of an edge table by alternating large-star and small-star steps.

Nodes never gather on the driver: it sees one checksum a step.  Each step is a map-side
aggregated minimum and a join whose hot side Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

ONE_TASK = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v) with v < u.  Large: each node's larger neighbours are hung on its least one; small: its smaller ones."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
    joined = sides.join(least, F.col("u") == F.col("k"))
    moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges to (node, least of its component), in one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in root]
    rows = [(x, r) for x, r in rows if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``edges`` (a, b) to (node, label): each node of an edge but the least of its component, and that least.

    Edges are counted: up to ``one_task`` of them, a few MB, are joined in one task on an
    executor; more go through the stars.  Both give the same rows.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= one_task:
        return materialize(now.coalesce(1).mapInArrow(_forest, "node bigint, label bigint"), "labels")
    mark = None
    while True:
        before, now = now, materialize(_star(_star(now, True), False), "stars")
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        mark = seen
