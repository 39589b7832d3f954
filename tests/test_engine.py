import dataclasses
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trafficlens.operators import bounded, exact, gateway, panes
from trafficlens.plans import catalog, oracle
from trafficlens.plans.dsl import parse_query
from trafficlens.plans.planner import plan
from trafficlens.schema import complete
from trafficlens.sources.packets import PcapDataSource, read_pcap, write_capture
from trafficlens.sources.synth import synth

S = 1_000_000_000
SF = "/root/testdata/sf0.001"


def q(text, window="{size: 60s, slide: 10s}"):
    return parse_query(f"{{name: q, window: {window}, {text}}}")


def flows(spark, rows):
    """(seconds, src, dst, bytes, protocol) in order of arrival."""
    data = [(int(t * S), s, d, b, p, i) for i, (t, s, d, b, p) in enumerate(rows)]
    return complete(spark.createDataFrame(data, "ts_nanos long, src_ip string, dst_ip string, bytes long, protocol int, arrival_seq long"))


def at(spark, *seconds):
    return flows(spark, [(t, "a", "b", 1, 6) for t in seconds])


def ends(rows):
    return {r.window_end_nanos // S: int(r.estimate) for r in rows.collect()}


def test_decaying_gap(spark):
    got = ends(exact.run(at(spark, 0, 10, 20, 30, 40, 50, 1000), q("groupBy: [protocol], measure: {type: count}"), ordered=False))
    assert {k: v for k, v in got.items() if k <= 110} == {10: 1, 20: 2, 30: 3, 40: 4, 50: 5, 60: 6, 70: 5, 80: 4, 90: 3, 100: 2, 110: 1}
    assert {k: v for k, v in got.items() if k > 110} == {1010: 1}


def test_far_future_and_disorder_after_a_gap(spark):
    query = q("groupBy: [src.ip], measure: {type: heavy_hitters, value: bytes}")
    events = flows(spark, [(1, "a", "x", 5, 6), (1_000_000, "b", "x", 5, 6), (999_990, "c", "x", 5, 6)])
    assert panes.late_count(events, query).first()[0] == 0
    last = exact.latest(exact.run(events, query, ordered=False), None).collect()
    assert {r.src_ip for r in last} == {"b", "c"}
    far = flows(spark, [(1, "a", "x", 5, 6), (7_258_118_400, "b", "x", 5, 6)])
    assert {r.src_ip for r in exact.latest(exact.run(far, query), None).collect()} == {"b"}


def test_expiry(spark):
    events = at(spark, *([1] * 5), 105)
    assert max(ends(exact.run(events, q("measure: {type: count}", "{size: 20s, slide: 10s}"))).items()) == (110, 1)


def ring(rows, size, slide):
    """What each window counts and how many are late, event by event."""
    first, back, late, out = None, None, 0, {}
    for t in rows:
        pane = t - t % slide
        first, back = (pane, pane) if first is None else (first, max(back, pane))
        if pane < max(first, back - size + slide):
            late += 1
            continue
        for end in range(max(pane, back) + slide, pane + size + 1, slide):
            out[end] = out.get(end, 0) + 1
    return {k: v for k, v in out.items() if k <= back + slide}, late


@pytest.mark.parametrize("seed", range(3))
def test_arrival_order(spark, seed):
    rng = random.Random(seed)
    t, rows = 50, []
    for _ in range(120):
        t += rng.choice([0, 1, 3, 9, 70]) if rng.random() < 0.9 else 400
        rows.append(max(0, t - rng.randrange(0, 80)))
    query = q("measure: {type: count}")
    want, late = ring(rows, 60, 10)
    assert ends(exact.run(at(spark, *rows), query, ordered=False)) == want
    assert panes.late_count(at(spark, *rows), query).first()[0] == late


def test_running_back_over_blocks(spark):
    rng = random.Random(1)
    values = [rng.randrange(1000) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "arrival_seq long, pane long")
    got = {r.arrival_seq: r.back for r in panes.running_back(df, block=32).collect()}
    assert [got[i] for i in range(500)] == [max(values[: i + 1]) for i in range(500)]


def test_clock_of_all_events(spark):
    query = q("match: {protocol: udp}, measure: {type: count}")
    events = flows(spark, [(5, "a", "b", 1, 17), (100, "a", "b", 1, 6), (45, "a", "b", 1, 17)])
    assert panes.late_count(events, query).first()[0] == 0
    assert panes.late_count(events, query, "all").first()[0] == 1


def test_no_match_gives_no_rows(spark):
    assert exact.run(at(spark, 1, 2), q("match: {protocol: udp}, measure: {type: count}")).count() == 0


def test_cap_comes_before_alert(spark):
    events = flows(spark, [(1, s, "x", b, 6) for s, b in (("a", 10), ("b", 20), ("c", 30))])
    query = q("groupBy: [src.ip], measure: {type: sum, value: bytes}, alertIf: {gt: 5}, export: {maxSeries: 2}", "{size: 10s}")
    assert [r.src_ip for r in exact.run(events, query).orderBy("src_ip").collect()] == ["b", "c"]


def test_bounded_equals_exact_on_small_streams(spark):
    rng = random.Random(3)
    events = flows(spark, [(i / 3, f"s{rng.randrange(9)}", f"d{rng.randrange(30)}", rng.randrange(1, 99), rng.choice([6, 17])) for i in range(300)])
    for text in ("groupBy: [src.ip], measure: {type: heavy_hitters, value: bytes}", "groupBy: [src.ip], measure: {type: distinct_count, field: dst.ip}", "measure: {type: distinct_count, field: dst.ip}", "groupBy: [protocol], measure: {type: count}"):
        query = q(text)
        keys = [*exact.WINDOW, *exact.labels(query), "estimate", "update_count"]
        key = lambda r: tuple(map(str, r))
        assert sorted(bounded.run(events, query).select(*keys).collect(), key=key) == sorted(exact.run(events, query).select(*keys).collect(), key=key)


def test_gateway_waits_for_all_nodes(spark):
    query = q("measure: {type: distinct_count, field: src.ip}", "{size: 10s}")
    events = flows(spark, [(t, f"s{t}", "x", 1, 6) for t in range(20)])

    def sent(node, rows):
        limits = rows.agg(F.lit(0).cast("bigint").alias("p0"), F.lit(10 * S).alias("p1"))
        states = bounded.window_states(bounded.pane_states(rows, query), limits, query)
        return bounded.snapshots(states, query, node).withColumn("received_nanos", F.lit(5).cast("bigint"))

    a, b = sent("a", events.where("ts_nanos % 2 = 0")), sent("b", events.where(f"ts_nanos >= {4 * S}"))
    both = gateway.merge(a.unionByName(b), query, 6).collect()
    assert len(both) == 1 and both[0].estimate == 10 and both[0].window_end_nanos == 20 * S
    lagging = a.unionByName(b.where(f"window_end_nanos = {10 * S}"))
    assert gateway.merge(lagging, query, 6).count() == 0
    gone = lagging.withColumn("received_nanos", F.expr(f"if(node = 'b', 1, {400 * S})"))
    assert gateway.merge(gone, query, 400 * S).count() == 1


def test_sources(spark, tmp_path):
    rows = [r.asDict() for r in synth(spark, 300).orderBy("arrival_seq").collect()]
    (tmp_path / "a.pcap").write_bytes(write_capture(iter(rows), 0))
    spark.dataSource.register(PcapDataSource)
    for got in (read_pcap(spark, f"{tmp_path}/a.pcap"), spark.read.format("pcap").load(f"{tmp_path}/a.pcap")):
        again = [r.asDict() for r in got.orderBy("arrival_seq").collect()]
        assert [(r["ts_nanos"], r["src_ip"], r["dst_port"], r["bytes"]) for r in again] == [(r["ts_nanos"], r["src_ip"], r["dst_port"], r["bytes"]) for r in rows]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["top_talkers", "suspected_scanners", "source_entropy", "packet_size_p90", "out_of_order_windows", "lineitem_top_suppliers"])
def test_oracle(spark, duck, name):
    want = duck.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(str, got.round(6).astype(str).values.tolist())) == sorted(map(str, want.round(6).astype(str).values.tolist()))


def test_plan_adds_up_before_it_fans_out(spark):
    query = dataclasses.replace(catalog.query_of("t", catalog.DOCUMENTS["count_global_sliding"]))
    text = exact.run(catalog.events(spark, SF), query)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode") > text.index("Aggregate")
    assert plan(query).series_bound == 1000 and "range" in oracle.oracle(query, "select 1")
