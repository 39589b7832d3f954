"""Results as Prometheus text, OTLP JSON, JSON and tables; posting them; tracking what was sent.

What is rendered is already capped by each plan, so a result fits the driver.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import FIELDS
from ..plans.dsl import Query, humanize
from ..plans.planner import Plan

RETRIED = (429, 502, 503, 504)
OTLP_MOST, PUSH_MOST = 8 << 20, 64 << 20
PREFIX = "trafficlens"


def label_name(name: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return "_" + name if name[:1].isdigit() else name


def escape(value: str) -> str:
    return value.replace("\\", r"\\").replace("\n", r"\n").replace('"', r"\"")


def number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(float(value))


def cap(estimates: DataFrame, most: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The greatest rows of each query, at most ``most`` of its name, and (query_name, dropped) of those that lost some."""
    bound = F.lit(1 << 62)
    for name, n in most.items():
        bound = F.when(F.col("query_name") == name, n).otherwise(bound)
    ranked = estimates.withColumn("_rank", F.row_number().over(W.partitionBy("query_name").orderBy(F.desc("estimate"), F.to_json("group"))))
    lost = ranked.where(F.col("_rank") > bound).groupBy("query_name").agg(F.count(F.lit(1)).alias("dropped"))
    return ranked.where(F.col("_rank") <= bound).drop("_rank"), lost


def prometheus(estimates: DataFrame, plans: list[Plan]) -> str:
    """Text exposition 0.0.4 of the rows given, usually those of the latest windows."""
    shown = [p for p in plans if p.query.prometheus]
    rows, lost = cap(estimates.where(F.col("query_name").isin([p.query.name for p in shown])), {p.query.name: p.query.max_series for p in shown})
    kinds = {p.query.name: p for p in shown}
    out = [f"# HELP {PREFIX}_estimate Windowed estimate of a query.", f"# TYPE {PREFIX}_estimate gauge"]
    for r in rows.orderBy("query_name", F.desc("estimate"), F.to_json("group")).collect():
        p = kinds[r.query_name]
        labels = {"query": r.query_name, "algorithm": r.algorithm, "error_kind": p.error_kind, "window": humanize(p.query.window.size)} | {label_name(g.name): g.value for g in r.group}
        out.append(f"{PREFIX}_estimate{{{','.join(f'{k}="{escape(v)}"' for k, v in labels.items())}}} {number(r.estimate)}")
    dropped = lost.orderBy("query_name").collect()
    if dropped:
        out += [f"# HELP {PREFIX}_export_series_dropped Series beyond the export cap.", f"# TYPE {PREFIX}_export_series_dropped gauge"]
        out += [f'{PREFIX}_export_series_dropped{{query="{escape(r.query_name)}"}} {r.dropped}' for r in dropped]
    return "\n".join(out) + "\n"


def unit(query: Query) -> str:
    """The unit in a metric's name."""
    m = query.measure
    return {"count": "count", "distinct_count": "distinct", "entropy": "entropy", "quantile": "quantile"}.get(m.kind) or m.field.label


def otlp(estimates: Iterable, queries: dict[str, Query], resource: dict[str, str] | None = None) -> dict:
    """An OTLP/HTTP metrics request of result rows."""
    attribute = lambda k, v: {"key": k, "value": {"stringValue": v}}
    metrics: dict[str, list] = {}
    for r in estimates:
        base = f"network.{PREFIX}.{unit(queries[r.query_name])}"
        attributes = [attribute(f"{PREFIX}.query", r.query_name), attribute(f"{PREFIX}.algorithm", r.algorithm)]
        attributes += [attribute(FIELDS[g.name].attribute, g.value) for g in r.group]
        for name, value in ((f"{base}.estimated", r.estimate), (f"{base}.lower_bound", r.lower_bound), (f"{base}.upper_bound", r.upper_bound), (f"{base}.confidence", r.confidence)):
            if value is not None:
                point = {"attributes": attributes, "startTimeUnixNano": str(r.window_start_nanos), "timeUnixNano": str(r.window_end_nanos), "asDouble": value}
                metrics.setdefault(name, []).append(point)
    own = [attribute(k, v) for k, v in (resource or {}).items()]
    scope = {"scope": {"name": PREFIX}, "metrics": [{"name": n, "gauge": {"dataPoints": p}} for n, p in sorted(metrics.items())]}
    return {"resourceMetrics": [{"resource": {"attributes": own}, "scopeMetrics": [scope]}]}


class PostError(RuntimeError):
    """A post that failed for good."""


def post(url: str, body: bytes, content_type: str = "application/json", most: int = OTLP_MOST, attempts: int = 3, pause: float = 0.2, sleep: Callable[[float], None] = time.sleep) -> int:
    """POST with retries of what may pass; pauses grow fourfold."""
    if len(body) > most:
        raise PostError(f"a body of {len(body)} bytes is over {most}")
    for attempt in range(attempts):
        try:
            request = urllib.request.Request(url, body, {"Content-Type": content_type}, method="POST")
            with urllib.request.urlopen(request, timeout=10) as answer:
                return answer.status
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt + 1 == attempts:
                raise PostError(f"{url} answered {e.code}") from e
        except OSError as e:
            if attempt + 1 == attempts:
                raise PostError(f"{url}: {e}") from e
        sleep(pause * 4**attempt)
    raise PostError("no attempts")


@dataclass
class Sent:
    """The last window exported of each query; older ones are skipped."""

    ends: dict[str, int] = field(default_factory=dict)

    def unsent(self, estimates: DataFrame) -> DataFrame:
        keep = F.lit(True)
        for name, end in self.ends.items():
            keep = keep & ((F.col("query_name") != name) | (F.col("window_end_nanos") > end))
        return estimates.where(keep)

    def note(self, rows: Iterable) -> None:
        for r in rows:
            self.ends[r.query_name] = max(self.ends.get(r.query_name, 0), r.window_end_nanos)


def to_json(estimates: DataFrame) -> str:
    rows = estimates.orderBy("query_name", "window_end_nanos", F.desc("estimate"), F.to_json("group")).toJSON().collect()
    return json.dumps([json.loads(r) for r in rows], indent=2)


def table(estimates: DataFrame, most: int = 50) -> str:
    """The last window as text: rank, labels, estimate and bounds."""
    last = estimates.agg(F.max("window_end_nanos").alias("_l"))
    rows = estimates.join(F.broadcast(last), F.col("window_end_nanos") == F.col("_l")).orderBy(F.desc("estimate"), F.to_json("group")).limit(most).collect()
    show = lambda v: "-" if v is None else number(round(v, 3))
    cells = [("rank", "labels", "estimate", "low", "high")]
    cells += [(str(i), " ".join(f"{g.name}={g.value}" for g in r.group) or "-", show(r.estimate), show(r.lower_bound), show(r.upper_bound)) for i, r in enumerate(rows, 1)]
    wide = [max(len(c[k]) for c in cells) for k in range(5)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(c, wide, strict=True)).rstrip() for c in cells) + "\n"


def health(counters: dict[str, float], gauges: dict[str, float] | None = None, role: str = "agent") -> str:
    """Counters and gauges of a running process as exposition text."""
    out = []
    for kind, values in (("counter", counters), ("gauge", gauges or {})):
        for name, value in values.items():
            full = f"{PREFIX}_{role}_{label_name(name)}" + ("_total" if kind == "counter" else "")
            out += [f"# TYPE {full} {kind}", f"{full} {number(float(value))}"]
    return "\n".join(out) + "\n"


#: Name, test over the counters and gauges of :func:`health`: what an operator should look at.
ALERTS: dict[str, Callable[[dict[str, float]], bool]] = {
    "events_dropped": lambda h: h.get("events_dropped", 0) > 0,
    "late_events": lambda h: h.get("late_events", 0) > 0.01 * max(1, h.get("events", 0)),
    "parse_errors": lambda h: h.get("parse_errors", 0) > 0.05 * max(1, h.get("events", 0)),
    "invalid_timestamps": lambda h: h.get("invalid_timestamps", 0) > 0,
    "memory_near_budget": lambda h: h.get("sketch_memory_bytes", 0) >= 0.9 * h.get("sketch_memory_budget_bytes", float("inf")),
    "export_failing": lambda h: h.get("export_failures", 0) > 0,
    "series_dropped": lambda h: h.get("series_dropped", 0) > 0,
    "merge_gap": lambda h: h.get("nodes_merged", 0) < h.get("nodes_known", 0),
}


def firing(values: dict[str, float]) -> list[str]:
    return [name for name, test in ALERTS.items() if test(values)]
