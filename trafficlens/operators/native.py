"""The native mode: Spark's own mergeable sketches, built for panes and merged for windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dsl import Query
from ..plans.planner import clamp, hll_error, plan
from .exact import WINDOW, capped, labels
from .panes import arrived, bounds, fan_out


def run(events: DataFrame, query: Query, clock: str = "matched", ordered: bool = True) -> DataFrame:
    """Distinct counts by HLL and quantiles by KLL; other measures have no native sketch that fits."""
    p, m, keys = plan(query), query.measure, labels(query)
    rows = arrived(events, query, clock, ordered)
    groups = [f.text().alias(f.label) for f in query.group_by]
    limits = bounds(events, query, clock, ordered)
    if m.kind == "distinct_count":
        lg_k = clamp(p.sketches[0].precision, 4, 21)
        panes = rows.select("pane", "back", *groups, m.field.text().alias("_item")).groupBy("pane", "back", *keys).agg(F.hll_sketch_agg("_item", F.lit(lg_k)).alias("s"), F.count(F.lit(1)).alias("n"))
        out = fan_out(panes, limits, query).groupBy(*WINDOW, *keys).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).cast("double").alias("estimate"), F.sum("n").alias("n"))
        total = out.groupBy("window_end_nanos").agg(F.sum("n").alias("update_count"))
        rel = 2 * hll_error(lg_k)
        out = out.join(total, "window_end_nanos").withColumns({"lower_bound": F.col("estimate") * (1 - rel), "upper_bound": F.col("estimate") * (1 + rel)})
    elif m.kind == "quantile":
        k, e = clamp(p.sketches[0].k, 8, 65_535), 2.3 / p.sketches[0].k
        panes = rows.select("pane", "back", F.col(m.field.column).cast("bigint").alias("_v")).groupBy("pane", "back").agg(F.expr(f"kll_sketch_agg_bigint(_v, {k})").alias("s"), F.count(F.lit(1)).alias("n"))
        merged = fan_out(panes, limits, query).groupBy(*WINDOW).agg(F.expr(f"kll_merge_agg_bigint(s, {k})").alias("s"), F.sum("n").alias("update_count"))
        at = lambda q: F.expr(f"cast(kll_sketch_get_quantile_bigint(s, {min(1.0, max(0.0, q))}D) as double)")
        out = merged.select(*WINDOW, at(m.q).alias("estimate"), at(m.q - e).alias("lower_bound"), at(m.q + e).alias("upper_bound"), "update_count")
    else:
        raise ValueError(f"{m.kind} has no native sketch; use the exact or the bounded mode")
    return capped(out, query, p.series_bound).select(*WINDOW, *keys, "estimate", "lower_bound", "upper_bound", "update_count")
