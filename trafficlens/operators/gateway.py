"""Merging the states of many nodes: only whole, only of one window, or not at all.

Input rows are (node, query, component, window bounds, update_count, bytes, received_nanos).
A node's freshest window of a query counts; of windows with the latest end, the start that
most nodes have wins, the smaller on a tie.  While a node that is known lags behind, the
query gives no estimate.
"""

from __future__ import annotations

import threading

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.dsl import Query
from ..plans.planner import Plan, format_bytes, plan
from .bounded import check_state, estimates_of, merged
from .exact import WINDOW, estimates
from .snapshot import Incompatible, SnapshotError, decode_batch

STALE_NANOS = 300_000_000_000


def fresh(rows: DataFrame, now_nanos: int, stale_nanos: int = STALE_NANOS) -> DataFrame:
    """Without nodes that weren't heard of for ``stale_nanos``; an older window refreshes its node too."""
    heard = rows.groupBy("query", "node").agg(F.max("received_nanos").alias("heard")).where(F.col("heard") > now_nanos - stale_nanos)
    return rows.join(heard, ["query", "node"])


def newest(rows: DataFrame) -> DataFrame:
    """Each node's state of its latest window; of pushes of one window the last."""
    order = W.partitionBy("query", "node", "component").orderBy(F.desc("window_end_nanos"), F.desc("received_nanos"))
    first = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return first.withColumn("_end", F.max("window_end_nanos").over(W.partitionBy("query", "node"))).where("window_end_nanos = _end").drop("_end")


def chosen(rows: DataFrame) -> DataFrame:
    """(query, window bounds, nodes_merged, nodes_known, complete) by the vote over :func:`newest` rows."""
    states = rows.select("query", "node", *WINDOW).distinct()
    known = states.groupBy("query").agg(F.countDistinct("node").alias("nodes_known"), F.max("window_end_nanos").alias("_end"))
    votes = states.groupBy("query", *WINDOW).agg(F.countDistinct("node").alias("nodes_merged"))
    at_end = votes.join(known, "query").where("window_end_nanos = _end")
    order = W.partitionBy("query").orderBy(F.desc("nodes_merged"), "window_start_nanos")
    best = at_end.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return best.select("query", *WINDOW, "nodes_merged", "nodes_known", (F.col("nodes_merged") == F.col("nodes_known")).alias("complete"))


def merge(rows: DataFrame, query: Query, now_nanos: int, stale_nanos: int = STALE_NANOS, seed: int = 0, planned: Plan | None = None) -> DataFrame:
    """Estimates of ``query`` over all nodes, or no rows while one lags.  States that don't fit the plan raise."""
    p = planned or plan(query)
    rows = newest(fresh(rows.where(F.col("query") == query.name), now_nanos, stale_nanos))
    ready = rows.join(chosen(rows).where("complete").select("query", *WINDOW), ["query", *WINDOW])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        start, end = int(pdf.window_start_nanos.iloc[0]), int(pdf.window_end_nanos.iloc[0])
        states, n = [], 0
        for _, own in pdf.sort_values("node").groupby("node"):
            s, e, sketches = check_state({c: bytes(b) for c, b in zip(own.component, own.bytes, strict=True)}, query, p, seed)
            if (s, e) != (start, end):
                raise SnapshotError("a snapshot's window differs from its row")
            states.append([x.dump() for x in sketches])
            n += int(own.update_count.iloc[0])
        return pd.DataFrame({"window_start_nanos": [start], "window_end_nanos": [end], "update_count": [n], "states": [[x.dump(start, end) for x in merged(states)]]})

    windows = ready.groupBy(*WINDOW).applyInPandas(join, "window_start_nanos bigint, window_end_nanos bigint, update_count bigint, states array<binary>")
    return estimates_of(windows, query, p)


class Gateway:
    """Admission of pushed batches: valid entries are kept, each of its node and query, within the budgets."""

    def __init__(self, queries: list[Query], max_nodes: int = 1024, budget: int = 1 << 30, seed: int = 0) -> None:
        self.plans = {q.name: plan(q) for q in queries}
        for p in self.plans.values():
            if p.state_memory > budget:
                raise ValueError(f"one state of {p.query.name} is over {format_bytes(budget)}")
        self.max_nodes, self.budget, self.seed = max_nodes, budget, seed
        self.states: dict[tuple[str, str], dict] = {}
        self.lock = threading.Lock()
        self.counters = dict.fromkeys(("batches", "accepted", "rejected", "stale"), 0)

    def push(self, body: bytes, now_nanos: int) -> tuple[int, dict]:
        """HTTP status and what became of the batch: 400 if nothing was accepted, 200 on a part."""
        with self.lock:
            return self._push(body, now_nanos)

    def _push(self, body: bytes, now_nanos: int) -> tuple[int, dict]:
        self.counters["batches"] += 1
        try:
            node, entries = decode_batch(body)
        except SnapshotError as e:
            self.counters["rejected"] += 1
            return 400, {"accepted": 0, "errors": [str(e)]}
        parts: dict[str, dict[str, bytes]] = {}
        errors, accepted, doubled = [], 0, set()
        for e in entries:
            parts.setdefault(e.query, {})
            if e.component in parts[e.query]:
                errors.append(f"{e.query}: {e.component} is there twice")
                doubled.add(e.query)
            parts[e.query][e.component] = e.data
        for name, given in parts.items():
            if name in doubled:  # which of the two is meant can't be told
                continue
            try:
                self._admit(node, name, given, now_nanos)
                accepted += 1
            except (SnapshotError, Incompatible) as e:
                errors.append(f"{name}: {e}")
        self.counters["accepted"] += accepted
        self.counters["rejected"] += len(errors)
        return (200 if accepted else 400), {"accepted": accepted, "errors": errors}

    def _admit(self, node: str, name: str, given: dict[str, bytes], now: int) -> None:
        if name not in self.plans:
            raise SnapshotError("unknown query")
        start, end, sketches = check_state(given, self.plans[name].query, self.plans[name], self.seed)
        old = self.states.get((name, node))
        if old is not None and end < old["end"]:
            old["received"] = now  # too old to count, but the node lives
            self.counters["stale"] += 1
            return
        if old is None and len({n for _, n in self.states} | {node}) > self.max_nodes:
            raise SnapshotError("too many nodes")
        size = sum(map(len, given.values()))
        if sum(s["size"] for k, s in self.states.items() if k != (name, node)) + size > self.budget:
            raise SnapshotError("over the memory budget")
        self.states[name, node] = {"start": start, "end": end, "received": now, "size": size, "parts": given, "updates": sketches[0].updates}

    def rows(self) -> list[tuple]:
        """What :func:`merge` takes, a row a component."""
        with self.lock:
            states = [(key, self.states[key]) for key in sorted(self.states)]
        return [(node, name, c, s["start"], s["end"], s["updates"], b, s["received"]) for (name, node), s in states for c, b in sorted(s["parts"].items())]

    def answer(self, spark: SparkSession, now_nanos: int, stale_nanos: int = STALE_NANOS) -> tuple[DataFrame, list[dict]]:
        """Result rows of the queries whose nodes agree, and how far the nodes of each query do.

        An entry names its query, the window chosen, how many nodes have it, how many are known, and whether
        these are all; queries that no live node has sent are absent.
        """
        given = spark.createDataFrame(self.rows(), ROWS)
        votes = [r.asDict() for r in chosen(newest(fresh(given, now_nanos, stale_nanos))).orderBy("query").collect()]
        out = spark.createDataFrame([], RESULT)
        for r in votes:
            p = self.plans[r["query"]]
            if r["complete"]:
                out = out.unionByName(estimates(merge(given, p.query, now_nanos, stale_nanos, self.seed, p), p.query, p.describe()))
        return out, votes

    def nodes(self) -> list[str]:
        with self.lock:
            return sorted({n for _, n in self.states})


RESULT = "query_name string, window_start_nanos bigint, window_end_nanos bigint, group array<struct<name:string,value:string>>, estimate double, lower_bound double, upper_bound double, confidence double, algorithm string, sketch_bytes bigint, update_count bigint"
ROWS = "node string, query string, component string, window_start_nanos bigint, window_end_nanos bigint, update_count bigint, bytes binary, received_nanos bigint"
