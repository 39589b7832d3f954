"""The six measures as plain DataFrame plans, exact and able to spill.

Events are added up by pane first, with map-side aggregation, and only pane totals are
copied to the windows that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import KEY_SEPARATOR
from ..plans.dsl import Query
from ..plans.planner import Plan, plan
from .panes import arrived, bounds, fan_out

WINDOW = ["window_start_nanos", "window_end_nanos"]


def labels(query: Query) -> list[str]:
    return [f.label for f in query.group_by]


def alerting(query: Query, estimate: Column) -> Column:
    """Above ``gt`` or below ``lt``; always, without either."""
    tests = [t for t in ((estimate > query.gt) if query.gt is not None else None, (estimate < query.lt) if query.lt is not None else None) if t is not None]
    return F.lit(True) if not tests else tests[0] if len(tests) == 1 else tests[0] | tests[1]


def capped(rows: DataFrame, query: Query, bound: int) -> DataFrame:
    """The ``bound`` greatest groups of each window, ties by key, then those that alert."""
    if query.group_by:
        key = F.concat_ws(KEY_SEPARATOR, *labels(query))
        order = W.partitionBy("window_end_nanos").orderBy(F.desc("estimate"), key)
        rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= bound).drop("_rank")
    return rows.where(alerting(query, F.col("estimate")))


def windowed(events: DataFrame, query: Query, extra: dict[str, Column], weight: Column, clock: str, ordered: bool) -> DataFrame:
    """Totals ``w`` and ``n`` by window, group labels and ``extra`` columns."""
    groups = {f.label: f.text() for f in query.group_by} | extra
    rows = arrived(events, query, clock, ordered).select("pane", "back", *(c.alias(k) for k, c in groups.items()), weight.cast("bigint").alias("_w"))
    panes = rows.groupBy("pane", "back", *groups).agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"))
    fanned = fan_out(panes, bounds(events, query, clock, ordered), query)
    return fanned.groupBy(*WINDOW, *groups).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def with_updates(rows: DataFrame) -> DataFrame:
    """Adds ``update_count``, the matching events of the window over all groups."""
    total = rows.groupBy("window_end_nanos").agg(F.sum("n").alias("update_count"))
    return rows.join(total, "window_end_nanos")


def run(events: DataFrame, query: Query, clock: str = "matched", ordered: bool = True, planned: Plan | None = None) -> DataFrame:
    """Window bounds, group labels, ``estimate`` and ``update_count``; windows without events give no row."""
    planned = planned or plan(query)
    m, keys = query.measure, labels(query)
    one = F.lit(1)
    if m.kind in ("count", "sum", "heavy_hitters"):
        weight = one if m.kind == "count" else F.col(m.field.column)
        totals = windowed(events, query, {}, weight, clock, ordered)
        rows = with_updates(totals).withColumn("estimate", F.col("w").cast("double"))
    elif m.kind == "distinct_count":
        items = windowed(events, query, {"_item": m.field.text()}, one, clock, ordered)
        totals = items.groupBy(*WINDOW, *keys).agg(F.count(one).alias("d"), F.sum("n").alias("n"))
        rows = with_updates(totals).withColumn("estimate", F.col("d").cast("double"))
    elif m.kind == "entropy":
        items = windowed(events, query, {"_item": m.field.text()}, one, clock, ordered)
        whole = items.groupBy(*WINDOW).agg(F.sum("n").alias("update_count"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
        rows = whole.withColumn("estimate", F.greatest(F.lit(0.0), F.log2("update_count") - F.col("_s") / F.col("update_count")))
    else:
        values = windowed(events, query, {"_value": F.col(m.field.column).cast("bigint")}, one, clock, ordered)
        order = W.partitionBy(*WINDOW).orderBy("_value")
        upto = values.withColumn("_upto", F.sum("n").over(order)).withColumn("update_count", F.sum("n").over(W.partitionBy(*WINDOW)))
        rank = F.greatest(F.lit(1), F.ceil(F.lit(float(m.q)) * F.col("update_count")))
        rows = upto.where(F.col("_upto") >= rank).groupBy(*WINDOW, "update_count").agg(F.min("_value").cast("double").alias("estimate"))
    return capped(rows, query, planned.series_bound).select(*WINDOW, *keys, "estimate", "update_count")


def estimates(rows: DataFrame, query: Query, algorithm: str = "exact") -> DataFrame:
    """The result schema; exact bounds are the estimate itself."""
    group = F.array(*(F.struct(F.lit(f.name).alias("name"), F.col(f.label).alias("value")) for f in query.group_by)) if query.group_by else F.array().cast("array<struct<name:string,value:string>>")
    have = lambda c, default: F.col(c) if c in rows.columns else default
    return rows.select(
        F.lit(query.name).alias("query_name"), *WINDOW, group.alias("group"), "estimate",
        have("lower_bound", F.col("estimate")).alias("lower_bound"), have("upper_bound", F.col("estimate")).alias("upper_bound"), have("confidence", F.lit(1.0)).alias("confidence"),
        F.lit(algorithm).alias("algorithm"), F.lit(0).cast("bigint").alias("sketch_bytes"), "update_count",
    )


def latest(rows: DataFrame, by: str | None = "query_name") -> DataFrame:
    """Only the rows of the last window, of each query if ``by`` names one."""
    last = F.max("window_end_nanos").over(W.partitionBy(by)) if by else None
    if by is None:
        return rows.join(F.broadcast(rows.agg(F.max("window_end_nanos").alias("_last"))), F.col("window_end_nanos") == F.col("_last")).drop("_last")
    return rows.withColumn("_last", last).where(F.col("window_end_nanos") == F.col("_last")).drop("_last")
