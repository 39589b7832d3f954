"""Command line: replay, explain, validate, merge-snapshots, synth, bench, agent, gateway."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import bounded, exact, native
from .operators.gateway import Gateway
from .operators.sketches import HllMap, HyperLogLog, Kll, Sketch, SpaceSaving
from .operators.snapshot import Incompatible, SnapshotError, read_snapshot
from .plans.dsl import Query, QueryError, load_queries, parse_query
from .plans.planner import PlanError, explain, plan
from .sinks import http, render
from .sources.packets import read_pcap, write_capture
from .sources.synth import synth


def session() -> SparkSession:
    return SparkSession.builder.appName("trafficlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def evaluate(events: DataFrame, query: Query, mode: str, seed: int = 0) -> DataFrame:
    """Result rows of one query in a mode."""
    if mode == "exact":
        return exact.estimates(exact.run(events, query, ordered=False), query)
    if mode == "native":
        return exact.estimates(native.run(events, query, ordered=False), query, "native")
    return exact.estimates(bounded.run(events, query, ordered=False, seed=seed), query, plan(query).describe())


def replay(args: argparse.Namespace) -> int:
    spark = session()
    queries = load_queries(args.query)
    events = (read_pcap(spark, args.pcap) if args.pcap else spark.read.parquet(args.events)).cache()
    out = None
    for q in queries:
        rows = evaluate(events, q, args.mode, args.seed)
        out = rows if out is None else out.unionByName(rows)
        if args.snapshots:
            states = bounded.window_states(bounded.pane_states(events, q, ordered=False, seed=args.seed), bounded.bounds(events, q, ordered=False), q)
            bounded.snapshots(states, q, args.node).write.mode("append").parquet(args.snapshots)
    if args.format == "json":
        print(render.to_json(out))
    elif args.format == "prometheus":
        print(render.prometheus(exact.latest(out), [plan(q) for q in queries]), end="")
    else:
        print(render.table(out), end="")
    return 0


def validate(args: argparse.Namespace) -> int:
    failed = 0
    for path in args.query:
        try:
            plan(parse_query(Path(path).read_text()))
            print(f"OK   {path}")
        except (OSError, QueryError, PlanError) as e:
            failed += 1
            print(f"FAIL {path}: {e}")
    return 1 if failed else 0


def show_plan(args: argparse.Namespace) -> int:
    for q in load_queries(args.query):
        print(explain(plan(q)))
    return 0


def merge_snapshots(args: argparse.Namespace) -> int:
    """Merges files of one algorithm and window and lists the twenty greatest."""
    heads, merged = set(), None
    for path in args.snapshot:
        data = Path(path).read_bytes()
        head, _ = read_snapshot(data)
        heads.add((head.algorithm, head.start, head.end))
        if len(heads) > 1:
            raise Incompatible("snapshots of different algorithms or windows")
        sketch = Sketch.load(data)
        merged = sketch if merged is None else merged.merge(sketch)
    _, start, end = heads.pop()
    print(f"{merged.algorithm}: {len(args.snapshot)} snapshots, {merged.updates} updates")
    if isinstance(merged, SpaceSaving):
        for key, count, error in merged.top(20):
            print(f"{key.decode(errors='replace')}\t{count}\t{count - error}")
    elif isinstance(merged, HllMap):
        for key, size in merged.entries()[:20]:
            print(f"{key.decode(errors='replace')}\t{size:.1f}")
    elif isinstance(merged, HyperLogLog):
        print(f"{merged.cardinality():.1f}")
    elif isinstance(merged, Kll):
        print("\t".join(f"q{q}={merged.quantile(q)}" for q in (0.5, 0.9, 0.99)))
    if args.out:
        Path(args.out).write_bytes(merged.dump(start, end))
    return 0


def make_trace(args: argparse.Namespace) -> int:
    rows = synth(session(), args.packets, args.seconds, args.seed, args.scanners, args.talkers)
    if args.out.endswith(".pcap"):
        events = (r.asDict() for r in rows.orderBy("arrival_seq").toLocalIterator())
        Path(args.out).write_bytes(write_capture(events))
    else:
        rows.write.mode("overwrite").parquet(args.out)
    return 0


def bench(args: argparse.Namespace) -> int:
    """Events a second of each mode over a synthetic trace, and the line rate that this stands for."""
    spark = session()
    events = synth(spark, args.packets).cache()
    n, mean = events.count(), events.selectExpr("avg(bytes)").first()[0]
    for q in load_queries(args.query):
        began = time.time()
        rows = evaluate(events, q, args.mode).count()
        rate = n / (time.time() - began)
        print(json.dumps({"query": q.name, "mode": args.mode, "rows": rows, "events_per_s": round(rate), "gbps": round(rate * mean * 8 / 1e9, 3), "events_per_s_at_target": round(args.gbps * 1e9 / (8 * mean))}))
    return 0


def agent(args: argparse.Namespace) -> int:
    """Evaluates once and serves the result over HTTP."""
    spark, queries = session(), load_queries(args.query)
    events = spark.read.parquet(args.events)
    rows = None
    for q in queries:
        one = evaluate(events, q, args.mode)
        rows = one if rows is None else rows.unionByName(one)
    rows = exact.latest(rows).cache()
    text = render.prometheus(rows, [plan(q) for q in queries]) + render.health({"events": events.count()})
    server = http.serve(http.agent_routes(lambda: True, lambda: text, lambda: [json.loads(r) for r in rows.toJSON().collect()]), port=args.port)
    return _wait(server, args.once)


def gateway_answers(state: Gateway, spark: SparkSession, stale_nanos: int) -> dict[str, http.Route]:
    """Routes of a gateway; one merge at a time, over the states that are there when it is asked."""
    lock = threading.Lock()

    def answer() -> tuple[DataFrame, list[dict]]:
        with lock:
            rows, votes = state.answer(spark, time.time_ns(), stale_nanos)
            return spark.createDataFrame(rows.collect(), rows.schema), votes  # capped by each plan

    def metrics() -> str:
        rows, votes = answer()
        gauges = {"nodes_known": len(state.nodes()), "queries_complete": sum(v["complete"] for v in votes), "queries_waiting": sum(not v["complete"] for v in votes)}
        return render.prometheus(rows, list(state.plans.values())) + render.health(state.counters, gauges, "gateway")

    def queries() -> list[dict]:
        rows, votes = answer()
        found = json.loads(render.to_json(rows))
        known = {v["query"]: v for v in votes}
        return [{"query": name, **known.get(name, {"nodes_merged": 0, "nodes_known": 0, "complete": False}), "estimates": [r for r in found if r["query_name"] == name]} for name in sorted(state.plans)]

    return http.gateway_routes(lambda: True, metrics, queries, state.nodes)


def gateway(args: argparse.Namespace) -> int:
    state = Gateway(load_queries(args.query), args.max_nodes)
    routes = gateway_answers(state, session(), args.stale_seconds * 1_000_000_000)
    return _wait(http.serve(routes, lambda body: state.push(body, time.time_ns()), port=args.port), args.once)


def _wait(server, once: bool) -> int:
    print(f"listening on {server.server_address[0]}:{server.server_address[1]}", flush=True)
    try:
        while not once:
            time.sleep(1)
    except KeyboardInterrupt:
        pass
    server.shutdown()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trafficlens", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        p = commands.add_parser(name)
        for flag, how in options:
            p.add_argument(flag, **how)
        p.set_defaults(run=run)

    query = ("--query", {"nargs": "+", "required": True})
    mode = ("--mode", {"choices": ["exact", "native", "bounded"], "default": "exact"})
    seed = ("--seed", {"type": int, "default": 0})
    port, once = ("--port", {"type": int, "default": 0}), ("--once", {"action": "store_true"})
    command("replay", replay, query, mode, seed, ("--pcap", {}), ("--events", {}), ("--format", {"choices": ["table", "json", "prometheus"], "default": "table"}), ("--snapshots", {}), ("--node", {"default": "local"}))
    command("explain", show_plan, query)
    command("validate", validate, query)
    command("merge-snapshots", merge_snapshots, ("snapshot", {"nargs": "+"}), ("--out", {}))
    command("synth", make_trace, ("--out", {"required": True}), ("--packets", {"type": int, "default": 50_000}), ("--seconds", {"type": int, "default": 120}), ("--seed", {"type": int, "default": 7}), ("--scanners", {"type": int, "default": 2}), ("--talkers", {"type": int, "default": 3}))
    command("bench", bench, query, mode, ("--packets", {"type": int, "default": 1_000_000}), ("--gbps", {"type": float, "default": 10}))
    command("agent", agent, query, mode, ("--events", {"required": True}), port, once)
    command("gateway", gateway, query, ("--max-nodes", {"type": int, "default": 1024}), ("--stale-seconds", {"type": int, "default": 300}), port, once)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (QueryError, PlanError, SnapshotError, Incompatible, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
