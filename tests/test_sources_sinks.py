import json
import random
import struct
import time
import urllib.error
import urllib.request

import pytest

from trafficlens.cli import gateway_answers
from trafficlens.operators.gateway import Gateway
from trafficlens.operators.sketches import HyperLogLog
from trafficlens.operators.snapshot import Entry, encode_batch
from trafficlens.plans.dsl import parse_query
from trafficlens.sinks import http, render
from trafficlens.sources.packets import RING, CaptureError, parse_packet, parse_ring_record, read_capture, write_capture

EVENTS = [
    {"ts_nanos": 1_700_000_000_000_000_123, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 1234, "dst_port": 443, "protocol": 6, "bytes": 1500, "tcp_flags": 18},
    {"ts_nanos": 1_700_000_001_000_000_000, "src_ip": "2001:db8::1", "dst_ip": "2001:db8::2", "src_port": 5353, "dst_port": 53, "protocol": 17, "bytes": 90, "tcp_flags": 0},
    {"ts_nanos": 1_700_000_002_000_000_000, "src_ip": "10.0.0.3", "dst_ip": "10.0.0.4", "src_port": 0, "dst_port": 0, "protocol": 1, "bytes": 84, "tcp_flags": 0},
]


def test_capture_round_trip():
    for payload in (0, 64, 1 << 16):
        assert list(read_capture(write_capture(iter(EVENTS), payload))) == EVENTS


def test_captures_hold_events_of_more_users_than_a_byte_numbers(spark, tmp_path):
    """With over 65,536 users a source is 10.0.256.0, which no packet can hold: the round trip failed."""
    import duckdb

    from trafficlens.plans import contracts

    users = [0, 255, 256, 65_535, 65_536, 90_001, 900_000]
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 700) AS ts, {users}[i % {len(users)} + 1]::BIGINT AS user_id,
        ['view', 'click', 'error', 'signup', 'purchase'][i % 5 + 1] AS event_type, i / 10.0::DOUBLE AS value, '{{"k": ' || i % 100 || '}}' AS props FROM range(300) t(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    rows = contracts.pcap_roundtrip(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({contracts.PCAP_SQL})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want) and any(r[1] == "10.0.3515.160" for r in want)


def test_captures_arrive_in_time_order(spark, tmp_path):
    """Two files of 600 s, the later one first by name: no event comes too late for its window."""
    from trafficlens.operators import exact
    from trafficlens.plans.dsl import parse_query
    from trafficlens.sources.packets import PcapDataSource, read_pcap

    at = lambda start: ({**EVENTS[0], "ts_nanos": (start + i) * 1_000_000_000} for i in range(600))
    (tmp_path / "a.pcap").write_bytes(write_capture(at(1_700_000_640), 0))
    (tmp_path / "b.pcap").write_bytes(write_capture(at(1_700_000_040), 0))
    query = parse_query("{name: all, window: {size: 60s}, measure: {type: count}}")
    spark.dataSource.register(PcapDataSource)
    for read in (read_pcap(spark, str(tmp_path)), spark.read.format("pcap").load(f"{tmp_path}/a.pcap,{tmp_path}/b.pcap")):
        assert [r.ts_nanos for r in read.orderBy("arrival_seq").select("ts_nanos").collect()] == [(1_700_000_040 + i) * 1_000_000_000 for i in range(1200)]
        assert sorted(r.estimate for r in exact.run(read, query).select("estimate").collect()) == [60.0] * 20


def test_capture_damage():
    data = write_capture(iter(EVENTS), 0)
    assert len(list(read_capture(data[:24]))) == 0
    assert len(list(read_capture(data + b"\0" * 7))) == 3  # a cut record header ends the file
    for bad in (data[:-1], b"", b"\x0a\x0d\x0d\x0a" + data[4:], data[:28] + struct.pack("<I", 2_000_000_000) + data[32:]):
        with pytest.raises(CaptureError):
            list(read_capture(bad))


def frame(data):
    return data[24 + 16 :]


def test_packet_forms():
    tcp = frame(write_capture(iter(EVENTS[:1]), 1 << 16))
    want = {k: v for k, v in EVENTS[0].items() if k != "ts_nanos"}
    vlan = tcp[:12] + b"\x81\x00\x00\x05\x88\xa8\x00\x06" + tcp[12:]
    assert parse_packet(1, tcp) == want and parse_packet(1, vlan) == want and parse_packet(101, tcp[14:]) == want
    assert parse_packet(113, b"\0" * 14 + b"\x08\x00" + tcp[14:]) == want
    assert parse_packet(147, tcp) is None and parse_packet(1, tcp[:30]) is None and parse_packet(1, tcp, 40) is None
    later = bytearray(tcp)
    later[14 + 7] = 5  # not the first fragment
    assert parse_packet(1, bytes(later))["dst_port"] == 0


def test_arbitrary_frames_are_refused_quietly():
    rng = random.Random(5)
    for _ in range(3000):
        data = bytearray(rng.randbytes(rng.randrange(0, 120)))
        if len(data) > 20 and rng.random() < 0.7:
            data[12:15] = rng.choice([b"\x08\x00\x45", b"\x86\xdd\x60", b"\x81\x00\x00"])
        parse_packet(rng.choice([1, 101, 113]), bytes(data))


def test_ring_records():
    data = RING.pack(4, 1, 6, 2, 1000, 80, 3, 60, 5, b"\0" * 12 + b"\x0a\0\0\x01", b"\0" * 12 + b"\x0a\0\0\x02")
    got = parse_ring_record(data, 100)
    assert RING.size == 56 and (got["ts_nanos"], got["src_ip"], got["direction"], got["dst_port"]) == (105, "10.0.0.1", "ingress", 80)
    with pytest.raises(CaptureError):
        parse_ring_record(data[:-1], 0)
    with pytest.raises(CaptureError):
        parse_ring_record(b"\x05" + data[1:], 0)


def test_labels_and_numbers():
    assert render.label_name("9a.b-c") == "_9a_b_c" and render.escape('a"\\\n') == 'a\\"\\\\\\n'
    assert render.number(3.0) == "3" and render.number(2.5) == "2.5" and render.number(1e16) == "1e+16"
    assert "trafficlens_agent_events_total 5" in render.health({"events": 5}, {"ready": 1})
    assert set(render.firing({"events_dropped": 1, "sketch_memory_bytes": 95, "sketch_memory_budget_bytes": 100})) == {"events_dropped", "memory_near_budget"}


def test_post_retries(monkeypatch):
    seen, naps = [], []

    def answer(request, timeout):
        seen.append(1)
        raise urllib.error.HTTPError("u", 503 if len(seen) < 3 else 400, "", {}, None)

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    with pytest.raises(render.PostError):
        render.post("http://x", b"{}", sleep=naps.append)
    assert len(seen) == 3 and naps == [0.2, 0.8]
    with pytest.raises(render.PostError):
        render.post("http://x", b"x" * 10, most=5)


QUERY = parse_query("{name: sources, window: {size: 60s}, measure: {type: distinct_count, field: src.ip}}")


def sketch(start, end, p=12):
    h = HyperLogLog(p)
    h.update(b"10.0.0.1")
    return h.dump(start, end)


def test_gateway_admission():
    g = Gateway([QUERY], max_nodes=2)
    push = lambda node, *entries, now=1: g.push(encode_batch(node, list(entries)), now)
    assert push("a", Entry("sources", "hll", sketch(0, 60)))[0] == 200
    assert push("a", Entry("sources", "hll", sketch(0, 60, 11)))[0] == 400
    assert push("a", Entry("other", "hll", sketch(0, 60)))[0] == 400
    assert push("a", Entry("sources", "kll", sketch(0, 60)))[0] == 400
    assert push("b", Entry("sources", "hll", sketch(60, 120)), Entry("other", "hll", b"x"))[0] == 200
    assert push("b", Entry("sources", "hll", sketch(60, 120)), Entry("sources", "hll", sketch(0, 60)))[1]["accepted"] == 0  # which is meant?
    assert push("c", Entry("sources", "hll", sketch(0, 60)))[0] == 400  # a third node
    assert push("b", Entry("sources", "hll", sketch(0, 60)), now=9)[0] == 200
    assert g.states["sources", "b"]["end"] == 120 and g.states["sources", "b"]["received"] == 9
    assert g.push(b"junk", 1)[0] == 400 and g.nodes() == ["a", "b"]


def test_http():
    g = Gateway([QUERY])
    server = http.serve(http.gateway_routes(lambda: False, lambda: "m 1\n", lambda: ["sources"], g.nodes), lambda body: g.push(body, 1))
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: urllib.request.urlopen(base + p).read().decode()
    assert get("/healthz") == "ok\n" and get("/metrics") == "m 1\n" and json.loads(get("/v1/nodes")) == []
    body = encode_batch("a", [Entry("sources", "hll", sketch(0, 60))])
    assert json.loads(urllib.request.urlopen(urllib.request.Request(base + "/v1/snapshots", body)).read())["accepted"] == 1
    for path in ("/readyz", "/nothing"):
        with pytest.raises(urllib.error.HTTPError):
            get(path)
    server.shutdown()


def test_gateway_answers(spark):
    second = parse_query("{name: other, window: {size: 60s}, measure: {type: distinct_count, field: src.ip}}")
    g = Gateway([QUERY, second], max_nodes=3)

    def hosts(start, end, *names):
        h = HyperLogLog(12)
        for n in names:
            h.update(n)
        return h.dump(start * 10**9, end * 10**9)

    rows, votes = g.answer(spark, 10)
    assert rows.count() == 0 and votes == []
    server = http.serve(gateway_answers(g, spark, 10**18), lambda body: g.push(body, time.time_ns()))
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: urllib.request.urlopen(base + p).read().decode()
    push = lambda node, *entries: urllib.request.urlopen(urllib.request.Request(base + "/v1/snapshots", encode_batch(node, list(entries)))).read()
    push("a", Entry("sources", "hll", hosts(0, 60, b"x", b"y")))
    push("b", Entry("sources", "hll", hosts(0, 60, b"y", b"z")), Entry("other", "hll", hosts(0, 60, b"q")))
    push("a", Entry("other", "hll", hosts(60, 120, b"q")))
    first, last = json.loads(get("/v1/queries"))[::-1], None
    assert [(q["query"], q["nodes_merged"], q["nodes_known"], q["complete"], len(q["estimates"])) for q in first] == [("sources", 2, 2, True, 1), ("other", 1, 2, False, 0)]
    one = first[0]["estimates"][0]
    assert round(one["estimate"]) == 3 and one["update_count"] == 4 and one["window_end_nanos"] == 60 * 10**9
    text = get("/metrics")
    assert 'query="sources"' in text and 'query="other"' not in text and "gateway_queries_waiting 1" in text
    push("b", Entry("other", "hll", hosts(60, 120, b"r")))
    last = json.loads(get("/v1/queries"))[0]
    assert last["complete"] and round(last["estimates"][0]["estimate"]) == 2
    server.shutdown()
