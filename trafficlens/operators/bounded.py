"""The bounded mode: a plan's sketches as mergeable states, one for each pane.

Spark first adds events up by (pane, key), with map-side aggregation; each task then feeds
its share into sketches and emits them as snapshots; states of one pane, and then of one
window, merge by key of the pane or window.  A state's size is bounded by the plan, so
what a merge holds doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import KEY_SEPARATOR, group_key
from ..plans.dsl import Query
from ..plans.planner import Plan, plan
from . import sketches as S
from .exact import WINDOW, alerting
from .panes import arrived, bounds, fan_out
from .snapshot import Incompatible, SnapshotError, read_snapshot

#: Names of a plan's states, in the order of its sketches: fixed values of the snapshot form.
COMPONENTS = {"count": ("keys-spacesaving", "count-min"), "sum": ("keys-spacesaving", "count-min"), "heavy_hitters": ("spacesaving",), "entropy": ("head-spacesaving", "tail-hll", "tail-sample"), "quantile": ("kll",)}
STATE = "pane bigint, n bigint, states array<binary>"


def components(query: Query) -> tuple[str, ...]:
    if query.measure.kind == "distinct_count":
        return ("hllmap",) if query.group_by else ("hll",)
    return COMPONENTS[query.measure.kind]


def fresh(p: Plan, seed: int = 0) -> list[S.Sketch]:
    """Empty states of a plan.  CountSketch and Misra-Gries are library sketches; no plan holds them."""
    made = {
        "SpaceSaving": lambda s: S.SpaceSaving(s.capacity, seed),
        "CountMin": lambda s: S.CountMin(s.width, s.depth, s.conservative, seed),
        "HyperLogLog": lambda s: S.HyperLogLog(s.precision, seed),
        "HLLMap": lambda s: S.HllMap(s.max_keys, s.precision, seed),
        "KLL": lambda s: S.Kll(s.k, seed),
        "KeySample": lambda s: S.KeySample(s.capacity, seed),
    }
    return [made[s.kind](s) for s in p.sketches]


def feed(states: list[S.Sketch], kind: str, key: bytes, item: bytes, weight: int, times: int) -> None:
    """``weight`` in all, over ``times`` events of one (key, item)."""
    for s in states:
        if isinstance(s, S.Kll):
            s.insert_many([int(item)] * times)
        elif isinstance(s, S.HllMap):
            s.insert(key, item)
        elif isinstance(s, S.HyperLogLog):
            s.update(item)
        else:
            s.update(item if kind == "entropy" else key, weight)


def merged(blobs: list[list[bytes]]) -> list[S.Sketch]:
    """States merged one by one; those that don't fit raise."""
    out = [S.Sketch.load(b) for b in blobs[0]]
    for row in blobs[1:]:
        out = [a.merge(S.Sketch.load(b)) for a, b in zip(out, row, strict=True)]
    return out


def pane_states(events: DataFrame, query: Query, clock: str = "matched", ordered: bool = True, seed: int = 0, planned: Plan | None = None) -> DataFrame:
    """(pane, back, n, states): partial states of each pane, several a pane, from each task."""
    p, m = planned or plan(query), query.measure
    kind, size, slide = m.kind, query.window.size, query.window.slide
    item = F.lit("") if kind in ("count", "sum", "heavy_hitters") else F.col(m.field.column).cast("string") if kind == "quantile" else m.field.text()
    weight = F.col(m.field.column) if kind in ("sum", "heavy_hitters") else F.lit(1)
    rows = arrived(events, query, clock, ordered).select("pane", "back", group_key(list(query.group_by)).alias("key"), item.alias("item"), weight.cast("bigint").alias("w"))
    limits = F.broadcast(bounds(events, query, clock, ordered))
    rows = rows.join(limits).where(F.col("pane") >= F.greatest("p0", F.col("back") - (size - slide)))
    # ``back`` only tells in which windows an event counts; panes that agree on it share a state.
    rows = rows.groupBy("pane", "back", "key", "item").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple[list[S.Sketch], list[int]]] = {}
        for pdf in batches:
            for pane, back, key, text, w, n in pdf[["pane", "back", "key", "item", "w", "n"]].itertuples(index=False):
                if (pane, back) not in held:
                    held[pane, back] = fresh(p, seed), [0]
                states, count = held[pane, back]
                feed(states, kind, key.encode(), text.encode(), int(w), int(n))
                count[0] += int(n)
        for (pane, back), (states, count) in held.items():
            yield pd.DataFrame({"pane": [pane], "back": [back], "n": [count[0]], "states": [[s.dump(pane, pane + slide) for s in states]]})

    # A pane's keys go to a few tasks, so that a pane has few partial states.
    spread = F.pmod(F.xxhash64("key", "item"), F.lit(4))
    return rows.repartition("pane", spread).mapInPandas(run, "pane bigint, back bigint, n bigint, states array<binary>")


def window_states(panes: DataFrame, limits: DataFrame, query: Query) -> DataFrame:
    """(window bounds, update_count, states) merged from pane states."""
    fanned = fan_out(panes, limits, query)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, end = int(pdf.window_start_nanos.iloc[0]), int(pdf.window_end_nanos.iloc[0])
        pdf = pdf.sort_values("n", kind="stable")
        states = merged([list(map(bytes, row)) for row in pdf.states])
        return pd.DataFrame({"window_start_nanos": [start], "window_end_nanos": [end], "update_count": [int(pdf.n.sum())], "states": [[s.dump(start, end) for s in states]]})

    return fanned.groupBy(*WINDOW).applyInPandas(run, "window_start_nanos bigint, window_end_nanos bigint, update_count bigint, states array<binary>")


def rows_of(states: list[S.Sketch], query: Query, bound: int) -> list[tuple[bytes, float, float | None, float | None, float | None]]:
    """(key, estimate, lower, upper, confidence), greatest first, at most ``bound``."""
    kind, first = query.measure.kind, states[0]
    if kind in ("count", "sum"):
        cm = states[1]
        slack, sure = cm.epsilon * cm.total, 1 - cm.delta
        out = []
        for key, _, _ in first.top(bound):
            e = float(cm.estimate(key))
            out.append((key, e, max(0.0, e - slack), e, sure))
        return out
    if kind == "heavy_hitters":
        return [(k, float(c), float(c - e), float(c), None) for k, c, e in first.top(bound)]
    if kind == "distinct_count":
        rel = 2 * 1.04 / 2 ** (first.precision / 2)
        found = first.entries()[:bound] if isinstance(first, S.HllMap) else [(b"", first.cardinality())]
        return [(k, c, c * (1 - rel), c * (1 + rel), 0.95) for k, c in found]
    if kind == "entropy":
        return [(b"", S.entropy_bits(*states), None, None, None)]
    q, e = query.measure.q, first.rank_error
    low, high = first.quantile(max(0.0, q - e)), first.quantile(min(1.0, q + e))
    return [(b"", float(first.quantile(q)), float(low), float(high), 0.99)]


def estimates_of(windows: DataFrame, query: Query, planned: Plan | None = None) -> DataFrame:
    """Window bounds, labels, estimate with bounds, and ``update_count``."""
    p = planned or plan(query)
    labels, bound = [f.label for f in query.group_by], p.series_bound

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                states = [S.Sketch.load(bytes(b)) for b in r.states]
                for key, *values in rows_of(states, query, bound):
                    parts = key.decode().split(KEY_SEPARATOR) if labels else []
                    out.append((r.window_start_nanos, r.window_end_nanos, *parts, *values, sum(len(b) for b in r.states), r.update_count))
            if out:
                yield pd.DataFrame(out, columns=[*WINDOW, *labels, "estimate", "lower_bound", "upper_bound", "confidence", "sketch_bytes", "update_count"])

    texts = "".join(f"`{k}` string, " for k in labels)
    rows = windows.mapInPandas(run, f"window_start_nanos bigint, window_end_nanos bigint, {texts}estimate double, lower_bound double, upper_bound double, confidence double, sketch_bytes bigint, update_count bigint")
    return rows.where(alerting(query, F.col("estimate")))


def run(events: DataFrame, query: Query, clock: str = "matched", ordered: bool = True, seed: int = 0) -> DataFrame:
    p = plan(query)
    states = pane_states(events, query, clock, ordered, seed, p)
    return estimates_of(window_states(states, bounds(events, query, clock, ordered), query), query, p)


def snapshots(windows: DataFrame, query: Query, node: str) -> DataFrame:
    """(node, query, component, window bounds, update_count, bytes): what a node sends to a gateway."""
    parts = F.arrays_zip(F.array(*map(F.lit, components(query))).alias("component"), F.col("states").alias("bytes"))
    exploded = windows.select(*WINDOW, "update_count", F.explode(parts).alias("s"))
    return exploded.select(F.lit(node).alias("node"), F.lit(query.name).alias("query"), F.col("s.component").alias("component"), *WINDOW, "update_count", F.col("s.bytes").alias("bytes"))


def check_state(parts: dict[str, bytes], query: Query, p: Plan, seed: int = 0) -> tuple[int, int, list[S.Sketch]]:
    """A window's state from its components, or an error: the set, windows and parameters must be the plan's."""
    want = components(query)
    if sorted(parts) != sorted(want):
        raise SnapshotError(f"components {sorted(parts)} where {sorted(want)} are expected")
    heads = {k: read_snapshot(parts[k])[0] for k in want}
    if len({(h.start, h.end) for h in heads.values()}) != 1:
        raise SnapshotError("components are of different windows")
    out = []
    for name, local in zip(want, fresh(p, seed), strict=True):
        sketch = S.Sketch.load(parts[name])
        if sketch.compatibility() != local.compatibility():
            raise Incompatible(f"{name} differs from the local plan")
        out.append(sketch)
    head = heads[want[0]]
    return head.start, head.end, out


def latest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_last", F.max("window_end_nanos").over(W.partitionBy("query"))).where("window_end_nanos = _last").drop("_last")
