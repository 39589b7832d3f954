"""Queries that hold sketches, merges, sinks and sources to what they promise.

Sketch queries return a boolean for each window; their SQL returns the same windows with TRUE.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import KEY_SEPARATOR
from ..operators import bounded, exact, gateway, native
from ..operators.exact import WINDOW
from ..operators.hashing import RowHashes
from ..operators.panes import bounds
from ..operators.sketches import CountSketch, MisraGries, Sketch
from ..schema import EVENTS_SQL
from ..sinks import render
from ..sources.packets import events_of_files, write_capture
from ..sources.synth import synth
from ..streaming.replay import Replay
from .catalog import DOCUMENTS, events, query_of
from .oracle import oracle, windows_sql
from .planner import plan

TALKERS = query_of("talkers", "{window: {size: 48h, slide: 24h}, groupBy: [src.ip, dst.ip], measure: {type: heavy_hitters, value: bytes, limit: 50, error: {epsilon: 0.01}}, export: {maxSeries: 50}}")
PORTS = query_of("ports", "{window: {size: 48h, slide: 24h}, groupBy: [dst.port], measure: {type: count, error: {epsilon: 0.01}}, export: {maxSeries: 100}}")
FANOUT = query_of("fanout", "{window: {size: 48h, slide: 24h}, groupBy: [protocol], measure: {type: distinct_count, field: dst.ip}}")
SOURCES = query_of("sources", "{window: {size: 48h, slide: 24h}, measure: {type: distinct_count, field: src.ip}}")
SIZES = query_of("sizes", "{window: {size: 48h, slide: 24h}, measure: {type: quantile, field: bytes, q: 0.9, error: {epsilon: 0.02}}}")
ENTROPY = query_of("entropy", "{window: {size: 48h, slide: 24h}, measure: {type: entropy, field: src.ip}}")


def _per_window(rows: DataFrame, ok: object, name: str) -> DataFrame:
    return rows.groupBy("window_end_nanos").agg(F.min(F.coalesce(ok, F.lit(False))).alias(name))


def _truth(spark: SparkSession, d: str, query) -> DataFrame:
    """Exact rows of all groups."""
    import dataclasses

    wide = dataclasses.replace(query, max_series=1 << 40, measure=dataclasses.replace(query.measure, limit=1 << 40), max_memory=1 << 62)
    p = dataclasses.replace(plan(query), series_bound=1 << 40)
    return exact.run(events(spark, d), wide, planned=p).select(*WINDOW, *exact.labels(query), F.col("estimate").alias("truth"), F.col("update_count").alias("truth_updates"))


def _against(spark: SparkSession, d: str, query, name: str, ok: Callable[[], object], rows: Callable | None = None) -> DataFrame:
    got = (rows or bounded.run)(events(spark, d), query)
    return _per_window(got.join(_truth(spark, d, query), [*WINDOW, *exact.labels(query)], "left"), ok(), name)


def spacesaving_contract(spark: SparkSession, d: str) -> DataFrame:
    return _against(spark, d, TALKERS, "within", lambda: (F.col("lower_bound") <= F.col("truth")) & (F.col("truth") <= F.col("upper_bound")) & (F.col("update_count") == F.col("truth_updates")))


def countmin_contract(spark: SparkSession, d: str) -> DataFrame:
    return _against(spark, d, PORTS, "within", lambda: (F.col("estimate") >= F.col("truth")) & (F.col("estimate") <= F.col("truth") + 0.01 * F.col("truth_updates")))


def hll_interval(spark: SparkSession, d: str) -> DataFrame:
    return _against(spark, d, SOURCES, "within", lambda: F.abs(F.col("estimate") - F.col("truth")) <= 3 * 0.0163 * F.col("truth"))


def hllmap_interval(spark: SparkSession, d: str) -> DataFrame:
    return _against(spark, d, FANOUT, "within", lambda: F.abs(F.col("estimate") - F.col("truth")) <= 3 * 0.0163 * F.col("truth"))


def native_hll(spark: SparkSession, d: str) -> DataFrame:
    return _against(spark, d, FANOUT, "within", lambda: F.abs(F.col("estimate") - F.col("truth")) <= 3 * 0.0163 * F.col("truth"), native.run)


def _ranks(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Whether the rank of each window's quantile is within twice the contract."""
    values = exact.windowed(events(spark, d), SIZES, {"_value": F.col("bytes")}, F.lit(1), "matched", True)
    joined = rows.select(*WINDOW, "estimate").join(values, WINDOW)
    below, upto, total = F.sum(F.when(F.col("_value") < F.col("estimate"), F.col("n"))), F.sum(F.when(F.col("_value") <= F.col("estimate"), F.col("n"))), F.sum("n")
    ranked = joined.groupBy("window_end_nanos").agg((F.coalesce(below, F.lit(0)) / total).alias("lo"), (F.coalesce(upto, F.lit(0)) / total).alias("hi"))
    slack = 2 * SIZES.epsilon
    return ranked.select("window_end_nanos", ((F.col("lo") <= SIZES.measure.q + slack) & (F.col("hi") >= SIZES.measure.q - slack)).alias("within"))


def kll_rank_contract(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(bounded.run(events(spark, d), SIZES), spark, d)


def native_kll(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(native.run(events(spark, d), SIZES), spark, d)


def entropy_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _against(spark, d, ENTROPY, "within", lambda: F.abs(F.col("estimate") - F.col("truth")) <= 0.1)


class Frequent:
    """Three Misra-Gries parts of a window's (key, w) totals; of the totals only those are held that the bounds can fail for."""

    def __init__(self) -> None:
        self.parts, self.n, self.total, self.held = [MisraGries(64) for _ in range(3)], 0, 0, {}

    def add(self, keys: list[bytes], weights: np.ndarray) -> None:
        for key, w in zip(keys, weights.tolist(), strict=True):
            self.parts[self.n % 3].update(key, w)
            self.held[key] = w
            self.n, self.total = self.n + 1, self.total + w
        # A key comes once: what no part holds is estimated as nothing, which is within the bound if its weight is.
        self.held = {k: w for k, w in self.held.items() if 65 * w > self.total or any(k in p.counts for p in self.parts)}

    def holds(self) -> bool:
        a, b, c = self.parts
        whole = Sketch.load(a.merge(b).merge(c).dump())
        return all(w - whole.total / 65 <= whole.estimate(k) <= w for k, w in self.held.items())


class Changed:
    """Count sketches of a window's (key, w) totals and of their negatives; of each key its hashes and its total are held, 24 bytes."""

    def __init__(self) -> None:
        self.now, self.before = CountSketch(512, 5, 3), CountSketch(512, 5, 3)
        self.seen: list[tuple[RowHashes, np.ndarray]] = []
        self.least: bytes | None = None

    def add(self, keys: list[bytes], weights: np.ndarray) -> None:
        hashes = RowHashes.of(keys, self.now.seed)
        self.now.update_many(keys, weights, hashes)
        self.before.update_many(keys, -weights, hashes)
        self.seen.append((hashes, weights))
        self.least = min(keys) if self.least is None else min(self.least, *keys)

    def holds(self) -> bool:
        # A row is off by more than four standard errors for 1 key in 16 at most (Chebyshev), three of five rows for 10 in 16 ** 3.
        error = 4 * math.sqrt(sum(float(np.square(w.astype(np.float64)).sum()) for _, w in self.seen) / self.now.width)
        missed = sum(int((np.abs(self.now.estimate_many(h) - w) > error).sum()) for h, w in self.seen)
        self.before.update(self.least, 1000)
        both = self.now.merge(self.before)
        grown = both.estimate(self.least) == 1000 and both.estimate(b"absent") in range(-1000, 1001)
        return grown and missed <= 1 + sum(len(w) for _, w in self.seen) * 10 / 16**3


def _library(spark: SparkSession, d: str, judge: type[Frequent] | type[Changed]) -> DataFrame:
    """A verdict a window over its (key, w) totals, whose number is that of groups: they pass by in batches."""
    totals = exact.windowed(events(spark, d), TALKERS, {}, F.col("bytes"), "matched", True)
    keyed = totals.select("window_end_nanos", F.concat_ws(KEY_SEPARATOR, *exact.labels(TALKERS)).alias("key"), "w")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for pdf in batches:
            for end, part in pdf.groupby("window_end_nanos"):
                if end != at:
                    if held is not None:
                        yield pd.DataFrame({"window_end_nanos": [at], "within": [held.holds()]})
                    at, held = int(end), judge()
                held.add([k.encode() for k in part.key], part.w.to_numpy(dtype=np.int64))
        if held is not None:
            yield pd.DataFrame({"window_end_nanos": [at], "within": [held.holds()]})

    return keyed.repartition("window_end_nanos").sortWithinPartitions("window_end_nanos").mapInPandas(run, "window_end_nanos bigint, within boolean")


def misra_gries_contract(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d, Frequent)


def countsketch_holds(pdf: pd.DataFrame) -> bool:
    """Every key of a window goes in; its estimates are held to the sketch's error bound for the whole total."""
    changed = Changed()
    changed.add([k.encode() for k in pdf.key], pdf.w.to_numpy(dtype=np.int64))
    return changed.holds()


def countsketch_change(spark: SparkSession, d: str) -> DataFrame:
    """A window less itself is nothing; a key that grew shows its growth; every key is within the error bound."""
    return _library(spark, d, Changed)


def merge_equals_single(spark: SparkSession, d: str) -> DataFrame:
    """HLL states of three nodes, sent as snapshots and merged by the gateway, against one pass."""
    e = events(spark, d)
    limits = bounds(e, SOURCES)
    rows = None
    for node in range(3):
        states = bounded.window_states(bounded.pane_states(e.where(F.col("arrival_seq") % 3 == node), SOURCES), limits, SOURCES)
        sent = bounded.snapshots(states, SOURCES, f"node{node}").withColumn("received_nanos", F.lit(1).cast("bigint"))
        rows = sent if rows is None else rows.unionByName(sent)
    merged = gateway.merge(rows, SOURCES, 2)
    single = bounded.run(e, SOURCES).select("window_end_nanos", F.col("estimate").alias("one"), F.col("update_count").alias("all"))
    return _per_window(merged.join(single, "window_end_nanos"), (F.col("estimate") == F.col("one")) & (F.col("update_count") == F.col("all")), "within")


def gateway_fail_closed(spark: SparkSession, d: str) -> DataFrame:
    """The window vote over nodes made of users; some lag, some have gone silent."""
    e = events(spark, d)
    node = F.concat(F.lit("node"), F.element_at(F.split("src_ip", "[.]"), 4))
    end = F.expr("ts_nanos - pmod(ts_nanos, 86400000000000) + 86400000000000")
    rows = e.select(F.concat(F.lit("q"), F.col("dst_port") % 5).alias("query"), node.alias("node"), (end - 86400000000000).alias("window_start_nanos"), end.alias("window_end_nanos"), F.lit("hll").alias("component"), F.col("ts_nanos").alias("received_nanos"))
    now = rows.agg(F.max("received_nanos").alias("now")).first().now
    return gateway.chosen(gateway.newest(gateway.fresh(rows, now, 3 * 86400000000000)))


GATEWAY_SQL = f"""
WITH e AS (SELECT * FROM ({EVENTS_SQL})),
r AS (SELECT 'q' || (dst_port % 5) AS query, 'node' || split_part(src_ip, '.', 4) AS node,
             ts_nanos - ts_nanos % 86400000000000 AS s, ts_nanos - ts_nanos % 86400000000000 + 86400000000000 AS t, ts_nanos AS received FROM e),
h AS (SELECT query, node, max(received) AS heard FROM r GROUP BY ALL HAVING max(received) > (SELECT max(received) FROM r) - 259200000000000),
n AS (SELECT query, node, max(t) AS t, max(t) - 86400000000000 AS s FROM r JOIN h USING (query, node) GROUP BY ALL),
k AS (SELECT query, count(*) AS nodes_known, max(t) AS t FROM n GROUP BY ALL)
SELECT query, min(s) AS window_start_nanos, t AS window_end_nanos, count(*) AS nodes_merged, nodes_known, count(*) = nodes_known AS complete
FROM n JOIN k USING (query, t) GROUP BY query, t, nodes_known
"""
RENDERED = query_of("protocol_bytes", DOCUMENTS["sum_bytes_by_protocol_tumbling"].replace("maxSeries: 32", "maxSeries: 3"))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    import dataclasses

    p = dataclasses.replace(plan(RENDERED), series_bound=100)  # so that the sink's own cap has work to do
    return exact.latest(exact.estimates(exact.run(events(spark, d), RENDERED, planned=p), RENDERED))


def prometheus_lines(spark: SparkSession, d: str) -> DataFrame:
    text = render.prometheus(_rendered(spark, d), [plan(RENDERED)])
    return spark.createDataFrame([(x,) for x in text.splitlines() if not x.startswith("#")], "line string")


def otlp_points(spark: SparkSession, d: str) -> DataFrame:
    doc = render.otlp(_rendered(spark, d).collect(), {RENDERED.name: RENDERED})
    rows = [
        (m["name"], next(a["value"]["stringValue"] for a in p["attributes"] if a["key"] == "network.protocol.name"), p["timeUnixNano"], p["asDouble"])
        for m in doc["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]
        for p in m["gauge"]["dataPoints"]
    ]
    return spark.createDataFrame(rows, "name string, protocol string, time string, value double")


def _rendered_sql(select: str) -> str:
    import dataclasses

    return f"""WITH a AS ({oracle(dataclasses.replace(RENDERED, max_series=100), EVENTS_SQL)}),
l AS (SELECT *, row_number() OVER (ORDER BY estimate DESC, protocol) AS rn, count(*) OVER () AS total FROM a WHERE window_end_nanos = (SELECT max(window_end_nanos) FROM a))
{select}"""


PROMETHEUS_SQL = _rendered_sql("""SELECT 'trafficlens_estimate{query="protocol_bytes",algorithm="exact",error_kind="additive-overestimate",window="24h",protocol="' || protocol || '"} ' || CAST(estimate AS BIGINT) AS line FROM l WHERE rn <= 3
UNION ALL SELECT DISTINCT 'trafficlens_export_series_dropped{query="protocol_bytes"} ' || (total - 3) FROM l WHERE total > 3""")
OTLP_SQL = _rendered_sql("""SELECT 'network.trafficlens.bytes.' || kind AS name, protocol, CAST(window_end_nanos AS VARCHAR) AS time, CASE kind WHEN 'confidence' THEN 1.0::DOUBLE ELSE estimate END AS value
FROM l, (SELECT unnest(['estimated', 'lower_bound', 'upper_bound', 'confidence']) AS kind)""")


def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of windows, loaded and written again, byte for byte."""
    e = events(spark, d)
    rows = None
    for q in (TALKERS, PORTS, FANOUT, SIZES):
        states = bounded.window_states(bounded.pane_states(e, q), bounds(e, q), q)
        sent = bounded.snapshots(states, q, "n")
        rows = sent if rows is None else rows.unionByName(sent)

    def run(batches):
        for pdf in batches:
            same = [Sketch.load(bytes(b)).dump(s, t) == bytes(b) for b, s, t in zip(pdf.bytes, pdf.window_start_nanos, pdf.window_end_nanos, strict=True)]
            yield pd.DataFrame({"query": pdf["query"], "component": pdf.component, "window_end_nanos": pdf.window_end_nanos, "within": same})

    return rows.mapInPandas(run, "query string, component string, window_end_nanos bigint, within boolean")


def carried(address: str) -> Column:
    """``10.0.a.b`` as an address that a packet can hold: what the third number has over 255 goes into the second.

    The adapter makes sources of users so, and with more than 65,536 users their third numbers outgrow a byte.
    """
    n = F.split(address, "[.]")
    third = n[2].cast("bigint")
    return F.when(third > 255, F.concat_ws(".", n[0], (third / 256).cast("bigint").cast("string"), (third % 256).cast("string"), n[3])).otherwise(F.col(address))


def uncarried(address: str) -> Column:
    """The inverse of :func:`carried`."""
    n = F.split(address, "[.]")
    second = n[1].cast("bigint")
    return F.when(second > 0, F.concat_ws(".", n[0], F.lit("0"), (second * 256 + n[2].cast("bigint")).cast("string"), n[3])).otherwise(F.col(address))


def pcap_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events written as captures, one an hour of the day, and read back."""
    e = events(spark, d).withColumn("bytes", F.least("bytes", F.lit(60_000))).withColumn("part", F.expr("(ts_nanos div 3600000000000) % 24"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("arrival_seq")[["ts_nanos", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "tcp_flags"]]
        return pd.DataFrame({"path": [f"{pdf.part.iloc[0]:02}.pcap"], "content": [write_capture((dict(zip(rows.columns, r, strict=True)) for r in rows.itertuples(index=False, name=None)), 0)]})

    files = e.withColumn("src_ip", carried("src_ip")).groupBy("part").applyInPandas(write, "path string, content binary")
    read = events_of_files(files).withColumn("src_ip", uncarried("src_ip"))
    return read.groupBy("protocol", "src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("dst_port").alias("ports"), F.min("ts_nanos").alias("first"))


PCAP_SQL = f"""
SELECT protocol, src_ip, count(*) AS n, sum(greatest(least(bytes, 60000), CASE protocol WHEN 6 THEN 40 WHEN 17 THEN 28 ELSE 20 END)) AS bytes,
       sum(CASE WHEN protocol IN (6, 17) THEN dst_port ELSE 0 END) AS ports, min(ts_nanos) AS first
FROM ({EVENTS_SQL}) GROUP BY protocol, src_ip
"""


def synth_mix(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the three kinds of traffic, in whole tenths."""
    kind = F.when(F.col("src_ip").startswith("10.66."), "scan").when(F.col("src_ip").startswith("10.1.1."), "heavy").otherwise("rest")
    rows = synth(spark, 20_000).groupBy(kind.alias("kind")).agg(F.round(F.count(F.lit(1)) / 2000).cast("bigint").alias("tenths"))
    return rows.select("kind", "tenths")


SYNTH_SQL = "SELECT * FROM (VALUES ('scan', 1::BIGINT), ('heavy', 2::BIGINT), ('rest', 7::BIGINT)) t(kind, tenths)"
STREAMED = query_of("streamed", DOCUMENTS["sum_packets_by_src_sliding"])


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The stream's windows, published as they close, put together."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="trafficlens-stream-")
    import uuid

    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    replay = Replay(STREAMED, f"{base}/panes", lambda rows: rows.write.mode("append").parquet(f"{base}/out"))
    raw = spark.read.parquet(f"{d}/events.parquet")
    from ..schema import from_events

    # ``Trigger.AvailableNow`` reads what is there and stops.
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    replay.start(from_events(stream), f"{base}/checkpoint").awaitTermination()
    replay.finish(spark)
    return spark.read.parquet(f"{base}/out")


def _windows_true(query, name: str = "within", last_only: bool = False) -> str:
    sql = f"{windows_sql(query, EVENTS_SQL)} SELECT DISTINCT window_end_nanos, true AS {name} FROM win"
    return sql + " WHERE window_end_nanos = (SELECT max(window_end_nanos) FROM win)" if last_only else sql


CHECKED = {
    "spacesaving_contract": (spacesaving_contract, _windows_true(TALKERS)),
    "countmin_contract": (countmin_contract, _windows_true(PORTS)),
    "hll_interval": (hll_interval, _windows_true(SOURCES)),
    "hllmap_interval": (hllmap_interval, _windows_true(FANOUT)),
    "kll_rank_contract": (kll_rank_contract, _windows_true(SIZES)),
    "entropy_estimate": (entropy_estimate, _windows_true(ENTROPY)),
    "misra_gries_contract": (misra_gries_contract, _windows_true(TALKERS)),
    "countsketch_change": (countsketch_change, _windows_true(TALKERS)),
    "native_hll": (native_hll, _windows_true(FANOUT)),
    "native_kll": (native_kll, _windows_true(SIZES)),
    "merge_equals_single": (merge_equals_single, _windows_true(SOURCES, last_only=True)),
    "gateway_fail_closed": (gateway_fail_closed, GATEWAY_SQL),
    "prometheus_lines": (prometheus_lines, PROMETHEUS_SQL),
    "otlp_points": (otlp_points, OTLP_SQL),
    "snapshot_roundtrip": (snapshot_roundtrip, " UNION ALL ".join(f"SELECT '{q.name}' AS query, component, window_end_nanos, true AS within FROM ({windows_sql(q, EVENTS_SQL)} SELECT DISTINCT window_end_nanos FROM win), (SELECT unnest({list(bounded.components(q))}) AS component)" for q in (TALKERS, PORTS, FANOUT, SIZES))),
    "pcap_roundtrip": (pcap_roundtrip, PCAP_SQL),
    "synth_mix": (synth_mix, SYNTH_SQL),
    "stream_replay": (stream_replay, oracle(STREAMED, EVENTS_SQL)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in CHECKED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CHECKED.items()}
