"""The exact measures over a stream.

Each micro-batch is added up by pane; pane totals, far fewer than events, are appended to a
table, and the windows that have closed are read from it and published once.  A watermark
per micro-batch replaces the per-event clock: an event is late if its pane had left the
ring before its batch began, and late events are counted, not kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import pane_of
from ..operators.exact import WINDOW, capped, labels
from ..operators.panes import matches
from ..plans.dsl import Query
from ..plans.planner import plan


@dataclass
class Progress:
    first: int | None = None
    back: int | None = None
    published: int | None = None
    late: int = 0
    events: int = 0


class Replay:
    """Runs one count, sum or heavy-hitter query over a stream of flow events."""

    def __init__(self, query: Query, panes_path: str, publish: Callable[[DataFrame], None]) -> None:
        if query.measure.kind not in ("count", "sum", "heavy_hitters"):
            raise ValueError("the stream adds up counts and sums; run other measures in batch or bounded mode")
        self.query, self.path, self.publish, self.plan, self.progress = query, panes_path, publish, plan(query), Progress()

    def batch(self, events: DataFrame, batch_id: int) -> None:
        """A micro-batch; running one again overwrites its own pane totals."""
        q, p = self.query, self.progress
        slide, size = q.window.slide, q.window.size
        rows = events.where(matches(q.filter)).withColumn("pane", pane_of(F.col("ts_nanos"), slide))
        oldest = None if p.back is None else max(p.first, p.back - size + slide)
        weight = F.lit(1) if q.measure.kind == "count" else F.col(q.measure.field.column)
        grouped = rows.groupBy("pane", *(f.text().alias(f.label) for f in q.group_by)).agg(F.sum(weight.cast("bigint")).alias("w"), F.count(F.lit(1)).alias("n"))
        out = f"{self.path}/batch={batch_id}"
        grouped.where(F.lit(True) if oldest is None else F.col("pane") >= oldest).write.mode("overwrite").parquet(out)
        seen = events.sparkSession.read.schema(grouped.schema).parquet(out).agg(F.min("pane").alias("lo"), F.max("pane").alias("hi"), F.sum("n").alias("n")).first()
        total = rows.count()
        p.events += total
        p.late += total - (seen.n or 0)
        if seen.lo is None:
            return
        p.first = seen.lo if p.first is None else min(p.first, seen.lo) if p.published is None else p.first
        back = max(seen.hi, p.back if p.back is not None else seen.hi)
        if p.back is not None and back == p.back and p.published is not None and p.published >= back:
            return
        p.back = back
        self._emit(events.sparkSession, back)

    def _emit(self, spark: SparkSession, upto: int) -> None:
        """Publishes the windows that end at or before ``upto``, the pane that is open."""
        p, q = self.progress, self.query
        since = p.first if p.published is None else p.published
        if upto <= since:
            return
        self.publish(self.windows(spark, since, upto))
        p.published = upto

    def finish(self, spark: SparkSession) -> None:
        """The trailing window, which no later event closes."""
        if self.progress.back is not None:
            self._emit(spark, self.progress.back + self.query.window.slide)

    def windows(self, spark: SparkSession, since: int, upto: int) -> DataFrame:
        """Windows with ``since < end <= upto``, in the result columns of the exact engine."""
        q, slide, size = self.query, self.query.window.slide, self.query.window.size
        panes = spark.read.parquet(self.path).drop("batch")
        ends = F.expr(f"sequence(greatest(pane + {slide}L, {since + slide}L), least(pane + {size}L, {upto}L), {slide}L)")
        rows = panes.where((F.col("pane") > since - size) & (F.col("pane") < upto)).where(F.expr(f"greatest(pane + {slide}L, {since + slide}L) <= least(pane + {size}L, {upto}L)"))
        rows = rows.withColumn("window_end_nanos", F.explode(ends)).withColumn("window_start_nanos", F.greatest(F.col("window_end_nanos") - size, F.lit(self.progress.first)))
        totals = rows.groupBy(*WINDOW, *labels(q)).agg(F.sum("w").cast("double").alias("estimate"), F.sum("n").alias("n"))
        totals = totals.withColumn("update_count", F.sum("n").over(W.partitionBy(*WINDOW)))
        return capped(totals, q, self.plan.series_bound).select(*WINDOW, *labels(q), "estimate", "update_count")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
