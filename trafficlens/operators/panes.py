"""Panes and windows: which windows an event counts in, by event time and arrival order.

A window ending at ``end`` covers the panes of ``[end - size, end)``.  ``back`` is the latest
pane that had arrived with or before an event; the event counts in the windows that end
from ``max(pane, back) + slide`` up to ``pane + size``.  It is late, and counts in none,
if its pane is before ``max(first, back - size + slide)``, ``first`` being the pane of the
first event.  Windows start at ``end - size``, but not before the first pane, and the last
ends one slide after the last pane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import pane_of
from ..plans.dsl import Filter, Query

BLOCK = 1 << 20


def matches(where: Filter) -> Column:
    """The conjunction; an empty list is no condition."""
    out = F.lit(True)
    if where.protocol is not None:
        out = out & (F.col("protocol") == where.protocol)
    for column, values in (("dst_port", where.dst_ports), ("src_port", where.src_ports), ("interface_index", where.interfaces)):
        if values:
            out = out & F.col(column).isin(*values)
    return out


def running_back(rows: DataFrame, pane: str = "pane", seq: str = "arrival_seq", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``back``, the running maximum of ``pane`` in order of ``seq``.

    In blocks of ``seq``: the block maxima, few, are run in one task, rows in theirs only.
    """
    rows = rows.withColumn("_block", F.expr(f"{seq} div {block}"))
    tops = rows.groupBy("_block").agg(F.max(pane).alias("_top"))
    before = tops.select("_block", F.max("_top").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    own = F.max(pane).over(W.partitionBy("_block").orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(before, "_block").withColumn("back", F.greatest("_own", "_before")).drop("_block", "_own", "_before")


def arrived(events: DataFrame, query: Query, clock: str = "matched", ordered: bool = True) -> DataFrame:
    """Matching events with ``pane``, and ``back`` and ``late`` if they aren't known to be in order."""
    if clock not in ("matched", "all"):
        raise ValueError("clock is matched or all")
    rows = events.withColumn("pane", pane_of(F.col("ts_nanos"), query.window.slide))
    if ordered:
        return rows.where(matches(query.filter)).withColumn("back", F.col("pane"))
    if clock == "all":
        return running_back(rows).where(matches(query.filter))
    return running_back(rows.where(matches(query.filter)))


def bounds(events: DataFrame, query: Query, clock: str = "matched", ordered: bool = True) -> DataFrame:
    """One row: ``p0``, the pane of the first event that drives the clock, and ``p1``, the last pane."""
    driving = events if clock == "all" else events.where(matches(query.filter))
    pane = pane_of(F.col("ts_nanos"), query.window.slide)
    first = F.min(pane) if ordered else F.min_by(pane, F.col("arrival_seq"))
    return driving.agg(first.alias("p0"), F.max(pane).alias("p1"))


def is_late(query: Query) -> Column:
    return F.col("pane") < F.greatest(F.col("p0"), F.col("back") - (query.window.size - query.window.slide))


def late_count(events: DataFrame, query: Query, clock: str = "matched") -> DataFrame:
    """One row: how many matching events came too late."""
    rows = arrived(events, query, clock, ordered=False).join(F.broadcast(bounds(events, query, clock, ordered=False)))
    return rows.agg(F.coalesce(F.sum(is_late(query).cast("bigint")), F.lit(0)).alias("late_events"))


def fan_out(panes: DataFrame, limits: DataFrame, query: Query) -> DataFrame:
    """A row of pane totals for each window that it counts in.  ``limits`` is one row."""
    size, slide = query.window.size, query.window.slide
    rows = panes.join(F.broadcast(limits)).where(~is_late(query))
    ends = F.expr(f"sequence(greatest(pane, back) + {slide}L, least(pane + {size}L, p1 + {slide}L), {slide}L)")
    rows = rows.where(F.expr(f"greatest(pane, back) + {slide}L <= least(pane + {size}L, p1 + {slide}L)"))
    rows = rows.withColumn("window_end_nanos", F.explode(ends))
    return rows.withColumn("window_start_nanos", F.greatest(F.col("window_end_nanos") - size, F.col("p0"))).drop("pane", "back", "p0", "p1")
