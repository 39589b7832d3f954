"""The registered queries of the engine over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact, panes
from ..schema import EVENTS_SQL, LINEITEM_SQL, from_events, from_lineitem
from . import oracle
from .dsl import Query, parse_query

#: Name to query document.
DOCUMENTS = {
    "count_by_protocol_tumbling": "{window: {size: 24h}, groupBy: [protocol], measure: {type: count}}",
    "count_global_sliding": "{window: {size: 24h, slide: 6h}, measure: {type: count}}",
    "sum_bytes_by_protocol_tumbling": "{window: {size: 24h}, groupBy: [protocol], measure: {type: sum, value: bytes}, export: {maxSeries: 32}}",
    "sum_packets_by_src_sliding": "{window: {size: 24h, slide: 6h}, groupBy: [src.ip], measure: {type: sum, value: packets}}",
    "top_talkers": "{window: {size: 24h, slide: 6h}, groupBy: [src.ip, dst.ip], measure: {type: heavy_hitters, value: bytes, limit: 100}, export: {maxSeries: 100}}",
    "top_talkers_cap_wins": "{window: {size: 24h}, groupBy: [src.ip], measure: {type: heavy_hitters, value: bytes, limit: 50}, export: {maxSeries: 5}}",
    "distinct_dst_by_src": "{window: {size: 24h}, groupBy: [src.ip], measure: {type: distinct_count, field: dst.ip}, resources: {maxMemory: 1GiB}}",
    "distinct_src_global": "{window: {size: 24h, slide: 6h}, measure: {type: distinct_count, field: src.ip}}",
    "suspected_scanners": "{window: {size: 24h, slide: 6h}, match: {protocol: tcp}, groupBy: [src.ip], measure: {type: distinct_count, field: dst.ip, error: {epsilon: 0.02}}, alertIf: {gt: 1}, export: {maxSeries: 500}}",
    "source_entropy": "{window: {size: 24h, slide: 6h}, measure: {type: entropy, field: src.ip}, export: {maxSeries: 1}}",
    "packet_size_p50": "{window: {size: 24h, slide: 6h}, measure: {type: quantile, field: bytes, error: {epsilon: 0.01}}}",
    "packet_size_p90": "{window: {size: 24h, slide: 6h}, measure: {type: quantile, field: bytes, q: 0.9, error: {epsilon: 0.01}}}",
    "packet_size_p99": "{window: {size: 24h, slide: 6h}, measure: {type: quantile, field: bytes, q: 0.99, error: {epsilon: 0.01}}}",
    "filter_numeric_protocol": "{window: {size: 24h}, match: {protocol: '47'}, groupBy: [protocol, interface.index], measure: {type: count}}",
    "filter_dst_ports": "{window: {size: 24h}, match: {dst.port: [1, 2, 3, 5, 8]}, groupBy: [dst.port], measure: {type: sum, value: bytes}}",
    "filter_src_ports": "{window: {size: 24h}, match: {src.port: 40000, protocol: UDP}, measure: {type: count}}",
    "filter_interfaces": "{window: {size: 24h, slide: 12h}, where: {interfaces: [0, 3]}, group_by: [interface.index, direction], measure: {type: count}}",
    "alert_gt_after_cap": "{window: {size: 24h}, groupBy: [src.ip], measure: {type: sum, field: bytes}, alertIf: {gt: 10000}, export: {maxSeries: 3}}",
    "alert_lt_global": "{window: {size: 24h, slide: 6h}, measure: {type: count}, alertIf: {lt: 330}}",
    "alert_either_global": "{window: {size: 24h, slide: 6h}, measure: {type: count}, alertIf: {lt: 320, gt: 340}}",
    "count_by_node_flags": "{window: {size: 48h, slide: 24h}, groupBy: [node.id, tcp.flags], measure: {type: count}}",
}
LINEITEM_DOCUMENTS = {
    "lineitem_top_suppliers": "{window: {size: 720h}, groupBy: [src.ip], measure: {type: heavy_hitters, value: bytes, limit: 20}}",
    "lineitem_parts_by_protocol": "{window: {size: 2160h, slide: 720h}, groupBy: [protocol], measure: {type: distinct_count, field: dst.ip}}",
    "lineitem_bytes_p95": "{window: {size: 720h}, measure: {type: quantile, field: bytes, q: 0.95, error: {epsilon: 0.01}}}",
}
#: A fixed disorder: every seventh event arrives 900 places late.
SHUFFLE_SQL = f"SELECT * REPLACE (CASE WHEN arrival_seq % 7 = 3 THEN arrival_seq * 2 + 1801 ELSE arrival_seq * 2 END AS arrival_seq) FROM ({EVENTS_SQL})"
OUT_OF_ORDER = {"out_of_order_windows": "matched", "clock_all_windows": "all"}
DISORDERED = "{name: disordered, window: {size: 24h, slide: 6h}, match: {protocol: tcp}, groupBy: [protocol], measure: {type: count}}"


def query_of(name: str, document: str) -> Query:
    return parse_query(document.replace("{", f"{{name: {name}, ", 1) if not document.startswith("{name") else document)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("arrival_seq")
    return events(spark, sf_dir).withColumn("arrival_seq", F.when(seq % 7 == 3, seq * 2 + 1801).otherwise(seq * 2))


def _exact(query: Query, source: Callable[[SparkSession, str], DataFrame], ordered: bool = True, clock: str = "matched") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = exact.run(source(spark, sf_dir), query, clock, ordered)
        return out.withColumn("estimate", F.round("estimate", 6)) if query.measure.kind == "entropy" else out

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: _exact(query_of(n, d), events) for n, d in DOCUMENTS.items()}
    out |= {n: _exact(query_of(n, d), lineitem) for n, d in LINEITEM_DOCUMENTS.items()}
    late = query_of("disordered", DISORDERED)
    out |= {n: _exact(late, shuffled, False, clock) for n, clock in OUT_OF_ORDER.items()}
    out["late_events_count"] = lambda spark, d: panes.late_count(shuffled(spark, d), late)
    out["late_events_clock_all"] = lambda spark, d: panes.late_count(shuffled(spark, d), late, "all")
    sliding = query_of("latest", DOCUMENTS["sum_packets_by_src_sliding"])
    out["latest_window_only"] = lambda spark, d: exact.latest(exact.run(events(spark, d), sliding), None)

    def pane_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panes.arrived(events(spark, sf_dir), sliding)
        return rows.groupBy("pane").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))

    out["pane_histogram"] = pane_histogram
    return out


def oracle_sql() -> dict[str, str]:
    out = {n: oracle.oracle(query_of(n, d), EVENTS_SQL) for n, d in DOCUMENTS.items()}
    out |= {n: oracle.oracle(query_of(n, d), LINEITEM_SQL) for n, d in LINEITEM_DOCUMENTS.items()}
    late = query_of("disordered", DISORDERED)
    out |= {n: oracle.oracle(late, SHUFFLE_SQL, False, clock) for n, clock in OUT_OF_ORDER.items()}
    out["late_events_count"] = oracle.late_oracle(late, SHUFFLE_SQL)
    out["late_events_clock_all"] = oracle.late_oracle(late, SHUFFLE_SQL, "all")
    sliding = query_of("latest", DOCUMENTS["sum_packets_by_src_sliding"])
    out["latest_window_only"] = f"WITH a AS ({oracle.oracle(sliding, EVENTS_SQL)}) SELECT * FROM a WHERE window_end_nanos = (SELECT max(window_end_nanos) FROM a)"
    out["pane_histogram"] = f"SELECT ts_nanos - ts_nanos % {sliding.window.slide} AS pane, count(*) AS n, sum(bytes) AS bytes FROM ({EVENTS_SQL}) GROUP BY ALL"
    return out
