"""DuckDB SQL that says what a query's exact plan computes."""

from __future__ import annotations

from .dsl import Filter, Query
from .planner import plan


def _text(name: str, column: str) -> str:
    if name == "protocol":
        return "CASE protocol WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 58 THEN 'icmpv6' ELSE CAST(protocol AS VARCHAR) END"
    return f"CAST({column} AS VARCHAR)"


def _where(f: Filter) -> str:
    tests = [f"protocol = {f.protocol}"] if f.protocol is not None else []
    tests += [f"{c} IN ({', '.join(map(str, v))})" for c, v in (("dst_port", f.dst_ports), ("src_port", f.src_ports), ("interface_index", f.interfaces)) if v]
    return " AND ".join(tests) or "true"


def windows_sql(query: Query, flows: str, ordered: bool = True, clock: str = "matched") -> str:
    """CTEs ``ev`` (matching events with pane and back), ``b`` (p0, p1) and ``win`` (an event in each of its windows)."""
    size, slide, where = query.window.size, query.window.slide, _where(query.filter)
    drive = "true" if clock == "all" else where
    back = "pane" if ordered else "max(pane) OVER (ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING)"
    first = "min(pane)" if ordered else "arg_min(pane, arrival_seq)"
    return f"""WITH flows AS ({flows}),
clocked AS (SELECT *, ts_nanos - ts_nanos % {slide} AS pane FROM flows WHERE {drive}),
b AS (SELECT {first} AS p0, max(pane) AS p1 FROM clocked),
ev AS (SELECT * FROM (SELECT *, {back} AS back FROM clocked) WHERE {where}),
win AS (
  SELECT *, greatest(window_end_nanos - {size}, p0) AS window_start_nanos FROM (
    SELECT ev.*, p0, unnest(range(greatest(pane, back) + {slide}, least(pane + {size}, p1 + {slide}) + 1, {slide})) AS window_end_nanos
    FROM ev CROSS JOIN b WHERE pane >= greatest(p0, back - {size - slide}))
)"""


def oracle(query: Query, flows: str, ordered: bool = True, clock: str = "matched") -> str:
    m, bound = query.measure, plan(query).series_bound
    keys = [f.label for f in query.group_by]
    texts = ", ".join(f"{_text(f.name, f.column)} AS {f.label}" for f in query.group_by)
    select = ", ".join(["window_start_nanos", "window_end_nanos", *keys])
    groups = f"window_start_nanos, window_end_nanos{', ' + texts if texts else ''}"
    by = "GROUP BY ALL"
    if m.kind in ("count", "sum", "heavy_hitters", "distinct_count"):
        what = "count(*)" if m.kind == "count" else f"count(DISTINCT {_text(m.field.name, m.field.column)})" if m.kind == "distinct_count" else f"sum({m.field.column})"
        body = f"r AS (SELECT {groups}, CAST({what} AS DOUBLE) AS estimate FROM win {by})"
    elif m.kind == "entropy":
        body = f"""h AS (SELECT window_start_nanos, window_end_nanos, {_text(m.field.name, m.field.column)} AS item, count(*) AS n FROM win {by}),
r AS (SELECT window_start_nanos, window_end_nanos, greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS estimate FROM h {by})"""
    else:
        body = f"""h AS (SELECT window_start_nanos, window_end_nanos, {m.field.column} AS v, count(*) AS n FROM win {by}),
c AS (SELECT *, sum(n) OVER (PARTITION BY window_end_nanos ORDER BY v) AS upto, sum(n) OVER (PARTITION BY window_end_nanos) AS total FROM h),
r AS (SELECT window_start_nanos, window_end_nanos, CAST(min(v) AS DOUBLE) AS estimate FROM c WHERE upto >= greatest(1, ceil(CAST({m.q} AS DOUBLE) * total)) {by})"""
    tests = [f"estimate > {query.gt}"] if query.gt is not None else []
    tests += [f"estimate < {query.lt}"] if query.lt is not None else []
    key = "concat_ws(chr(31), " + ", ".join(keys) + ")" if keys else "1"
    limit = bound if keys else 1
    return f"""{windows_sql(query, flows, ordered, clock)},
u AS (SELECT window_end_nanos, count(*) AS update_count FROM win {by}),
{body},
k AS (SELECT *, row_number() OVER (PARTITION BY window_end_nanos ORDER BY estimate DESC, {key}) AS rn FROM r)
SELECT {select}, {"round(estimate, 6) AS estimate" if m.kind == "entropy" else "estimate"}, update_count
FROM k JOIN u USING (window_end_nanos) WHERE rn <= {limit} AND ({" OR ".join(tests) or "true"})"""


def late_oracle(query: Query, flows: str, clock: str = "matched") -> str:
    return f"""{windows_sql(query, flows, False, clock)}
SELECT count(*) AS late_events FROM ev CROSS JOIN b WHERE pane < greatest(p0, back - {query.window.size - query.window.slide})"""
