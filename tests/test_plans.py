import pytest

from trafficlens.plans.dsl import QueryError, humanize, parse_duration, parse_memory, parse_query
from trafficlens.plans.planner import PlanError, explain, plan

BASE = "name: q\nwindow: {size: 60s, slide: 10s}\n"


def query(rest, window="{size: 60s, slide: 10s}", name="q"):
    return parse_query(f"name: {name}\nwindow: {window}\n{rest}")


def test_defaults():
    q = query("measure: {type: count}")
    assert (q.epsilon, q.delta, q.max_series, q.max_memory, q.prometheus) == (0.001, 0.01, 1000, 128 << 20, True)
    assert query("measure: {type: distinct_count, field: dst.ip}").epsilon == 0.0163
    assert query("measure: {type: count}", "{size: 60s}").window.panes == 1
    assert query("measure: {type: sum, field: bytes}").measure.field.name == "bytes"


@pytest.mark.parametrize(
    "rest",
    [
        "measure: {type: median}",
        "measure: {type: count}\nextra: 1",
        "measure: {type: count, error: {epsilon: 0}}",
        "measure: {type: count, error: {epsilon: 1.0}}",
        "measure: {type: count, error: {sigma: 1}}",
        "measure: {type: sum}",
        "measure: {type: sum, value: src.ip}",
        "measure: {type: quantile, field: src.port}",
        "measure: {type: heavy_hitters, value: bytes}",
        "groupBy: [src.ip]\nmeasure: {type: heavy_hitters, value: bytes, limit: 0}",
        "groupBy: [src.ip, src.ip]\nmeasure: {type: count}",
        "groupBy: [host]\nmeasure: {type: count}",
        "groupBy: [dst.ip]\nmeasure: {type: distinct_count, field: dst.ip}",
        "measure: {type: count}\nmatch: {protocol: sctp-x}",
        "measure: {type: count}\nmatch: {protocol: 256}",
        "measure: {type: count}\nmatch: {protocol: [6]}",
        "measure: {type: count}\nmatch: {dst.port: 65536}",
        "measure: {type: count}\nmatch: {payload: x}",
        "measure: {type: count}\nexport: {maxSeries: 0}",
        "measure: {type: count}\nresources: {maxMemory: 5MB}",
        "measure: {type: count}\nmatch: {protocol: 6}\nwhere: {protocol: 6}",
    ],
)
def test_rejected(rest):
    with pytest.raises(QueryError):
        query(rest)


@pytest.mark.parametrize("window", ["{size: 0s}", "{size: 60s, slide: 0s}", "{size: 10s, slide: 60s}", "{size: 60s, slide: 7s}", "{size: 60}", "{size: 60d}"])
def test_windows_rejected(window):
    with pytest.raises(QueryError):
        query("measure: {type: count}", window)


@pytest.mark.parametrize("name", ["''", "'a b'", "x" * 257])
def test_names_rejected(name):
    with pytest.raises(QueryError):
        query("measure: {type: count}", name=name)


def test_units():
    assert parse_duration("5ms") == 5_000_000 and parse_duration("2h") == 7_200_000_000_000 and parse_duration("7ns") == 7
    assert parse_memory("64MiB") == 64 << 20
    for bad in ("5", "MB", "5MB", None, "99999999999999999999h"):
        with pytest.raises(QueryError):
            parse_duration(bad)
    assert [humanize(parse_duration(x)) for x in ("60s", "120s", "3600s", "90s", "1ms", "5ns")] == ["60s", "2m", "1h", "90s", "1ms", "5ns"]


def test_golden_plans():
    p = plan(query("groupBy: [src.ip, dst.ip]\nmeasure: {type: heavy_hitters, value: bytes, limit: 100}\nexport: {maxSeries: 100}"))
    assert p.describe() == "SpaceSaving(capacity=1000)" and (p.state_memory, p.memory) == (271_128, 3_524_664)
    p = plan(query("groupBy: [src.ip]\nmeasure: {type: distinct_count, field: dst.ip, error: {epsilon: 0.02}}\nexport: {maxSeries: 500}\nresources: {maxMemory: 64MiB}\nalertIf: {gt: 500}"))
    assert p.describe() == "HLLMap(max_keys=1213, precision=12)" and (p.state_memory, p.memory) == (5_160_166, 67_082_158)
    assert any("2000" in w for w in p.warnings) and p.series_bound == 500
    p = plan(query("measure: {type: quantile, field: bytes, q: 0.99, error: {epsilon: 0.01}}"))
    assert p.describe() == "KLL(k=230)" and (p.state_memory, p.memory) == (5_584, 72_592)
    p = plan(query("groupBy: [protocol]\nmeasure: {type: sum, value: bytes}\nexport: {maxSeries: 32}", "{size: 60s}"))
    assert p.describe() == "Composite[SpaceSaving(capacity=256) + CountMin(width=2719, depth=5, conservative=true)]" and p.memory == 478_920
    p = plan(query("measure: {type: entropy, field: src.ip}", "{size: 30s, slide: 10s}"))
    assert (p.state_memory, p.memory) == (235_288, 1_647_016)
    sizes = [plan(query(f"measure: {{type: distinct_count, field: src.ip, error: {{epsilon: {e}}}}}")).sketches[0].precision for e in (0.001, 0.01, 0.02, 0.05)]
    assert sizes == [18, 14, 12, 9]
    assert plan(query("measure: {type: quantile, field: bytes}")).sketches[0].k == 2300


@pytest.mark.parametrize(
    "rest",
    [
        "groupBy: [protocol]\nmeasure: {type: count}\nalertIf: {lt: 5}",
        "groupBy: [protocol]\nmeasure: {type: entropy, field: src.ip}",
        "groupBy: [protocol]\nmeasure: {type: quantile, field: bytes}",
        "measure: {type: quantile, field: bytes, q: 1.5}",
        "measure: {type: count, error: {delta: 1.0e-20}}",
        "measure: {type: count}\nresources: {maxMemory: 1KiB}",
        "groupBy: [src.ip]\nmeasure: {type: distinct_count, field: dst.ip}\nresources: {maxMemory: 1MiB}",
    ],
)
def test_plans_rejected(rest):
    with pytest.raises(PlanError):
        plan(query(rest))


def test_explain():
    text = explain(plan(query("groupBy: [src.ip]\nmatch: {protocol: tcp, dst.port: [80, 443]}\nmeasure: {type: heavy_hitters, value: bytes, limit: 10}\nexport: {maxSeries: 5}\nalertIf: {gt: 9}")))
    for part in ("to port 80/443", "by (src.ip), in panes of 10s", "heavy_hitters of bytes in SpaceSaving", "60s out of 6 panes", "5 series at most", "above 9", "mind | asks for 10 keys"):
        assert part in text
