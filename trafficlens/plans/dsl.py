"""Query documents: strict YAML to :class:`Query`."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import yaml

from ..functions.fields import FIELDS, Field, protocol_number

NANOS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
MEMORY = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}
MEASURES = ("count", "sum", "heavy_hitters", "distinct_count", "entropy", "quantile")
U64 = (1 << 64) - 1


class QueryError(ValueError):
    """A query document that isn't valid."""


@dataclass(frozen=True)
class Window:
    size: int
    slide: int

    @property
    def panes(self) -> int:
        return max(1, self.size // self.slide)


@dataclass(frozen=True)
class Filter:
    protocol: int | None = None
    dst_ports: tuple[int, ...] = ()
    src_ports: tuple[int, ...] = ()
    interfaces: tuple[int, ...] = ()


@dataclass(frozen=True)
class Measure:
    kind: str
    field: Field | None = None
    limit: int = 100
    q: float = 0.5


@dataclass(frozen=True)
class Query:
    name: str
    window: Window
    measure: Measure
    filter: Filter = field(default_factory=Filter)
    group_by: tuple[Field, ...] = ()
    epsilon: float = 0.001
    delta: float = 0.01
    gt: float | None = None
    lt: float | None = None
    prometheus: bool = True
    max_series: int = 1000
    max_memory: int = 128 << 20


def _scaled(text: object, units: dict[str, int], what: str) -> int:
    match = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text) if isinstance(text, str) else None
    if not match or match[2] not in units:
        raise QueryError(f"{what} {text!r} must be a whole number and one of {', '.join(units)}")
    value = int(match[1]) * units[match[2]]
    if value > U64:
        raise QueryError(f"{what} {text!r} is too large")
    return value


def parse_duration(text: object) -> int:
    """Nanoseconds."""
    return _scaled(text, NANOS, "duration")


def parse_memory(text: object) -> int:
    """Bytes."""
    return _scaled(text, MEMORY, "memory")


def humanize(nanos: int) -> str:
    """Hours, minutes from two on, seconds, milliseconds or nanoseconds, whichever is whole."""
    for unit, least in (("h", NANOS["h"]), ("m", 2 * NANOS["m"]), ("s", 0), ("ms", 0)):
        if nanos % NANOS[unit] == 0 and nanos >= least:
            return f"{nanos // NANOS[unit]}{unit}"
    return f"{nanos}ns"


def _take(doc: object, where: str, **known: tuple[str, ...]) -> dict:
    """The values of a mapping by their first name; other keys and double names are errors."""
    if not isinstance(doc, dict):
        raise QueryError(f"{where} must be a mapping")
    out = {}
    for name, also in known.items():
        given = [k for k in also if k in doc]
        if len(given) > 1:
            raise QueryError(f"{where}: {' and '.join(given)} are the same key")
        if given:
            out[name] = doc[given[0]]
    extra = set(doc) - {k for also in known.values() for k in also}
    if extra:
        raise QueryError(f"{where}: unknown key {sorted(map(str, extra))[0]}")
    return out


def _number(value: object, where: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise QueryError(f"{where} must be a number")
    return float(value)


def _whole(value: object, where: str, most: int, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise QueryError(f"{where} must be a whole number from {least} to {most}")
    return value


def _wholes(value: object, where: str, most: int) -> tuple[int, ...]:
    return tuple(_whole(x, where, most) for x in (value if isinstance(value, list) else [value]))


def _field(name: object) -> Field:
    if name not in FIELDS:
        raise QueryError(f"unknown field {name!r}")
    return FIELDS[name]


def _filter(doc: object) -> Filter:
    got = _take(doc, "match", protocol=("protocol",), dst=("dst.port",), src=("src.port",), interfaces=("interfaces",))
    try:
        protocol = protocol_number(got["protocol"]) if got.get("protocol") is not None else None
    except ValueError as e:
        raise QueryError(str(e)) from e
    return Filter(protocol, _wholes(got.get("dst", []), "dst.port", 65535), _wholes(got.get("src", []), "src.port", 65535), _wholes(got.get("interfaces", []), "interfaces", (1 << 32) - 1))


def _measure(doc: object) -> tuple[Measure, dict]:
    got = _take(doc, "measure", type=("type",), field=("field",), value=("value",), limit=("limit",), q=("q",), error=("error",))
    kind = got.get("type")
    if kind not in MEASURES:
        raise QueryError(f"unknown measure {kind!r}")
    name = got.get("value", got.get("field")) if kind == "sum" else got.get("value") if kind == "heavy_hitters" else got.get("field")
    of = None
    if kind != "count":
        if name is None:
            raise QueryError(f"{kind} needs a field")
        of = _field(name)
        if kind in ("sum", "heavy_hitters", "quantile") and not of.numeric:
            raise QueryError(f"{kind} needs bytes or packets, not {name}")
    limit = _whole(got.get("limit", 100), "limit", U64, 1 if kind == "heavy_hitters" else 0)
    q = _number(got.get("q", 0.5), "q")
    return Measure(kind, of, limit, q), _take(got.get("error") or {}, "error", epsilon=("epsilon",), delta=("delta",))


def parse_query(text: str) -> Query:
    """A query from its YAML; anything unknown or out of range is an error."""
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise QueryError(f"not YAML: {e}") from e
    got = _take(
        doc, "query", name=("name",), window=("window",), match=("match", "where"), group=("groupBy", "group_by"), measure=("measure",),
        alert=("alertIf", "alert_if"), export=("export",), resources=("resources",),
    )
    name = got.get("name")
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z0-9_-]{1,256}", name):
        raise QueryError("name must be 1 to 256 of A-Z, a-z, 0-9, _ and -")
    window = _take(got.get("window"), "window", size=("size",), slide=("slide",))
    size = parse_duration(window.get("size"))
    slide = parse_duration(window["slide"]) if window.get("slide") is not None else size
    if not size or not slide or slide > size or size % slide:
        raise QueryError("window.size must be a multiple of window.slide, both above 0")
    names = got.get("group") or []
    if not isinstance(names, list) or len(set(map(str, names))) != len(names):
        raise QueryError("groupBy must be a list of different fields")
    group = tuple(_field(n) for n in names)
    measure, error = _measure(got.get("measure"))
    if measure.kind == "heavy_hitters" and not group:
        raise QueryError("heavy_hitters needs groupBy")
    if measure.kind == "distinct_count" and measure.field in group:
        raise QueryError("distinct_count's field can't be in groupBy")
    epsilon = _number(error.get("epsilon", 0.0163 if measure.kind == "distinct_count" else 0.001), "epsilon")
    delta = _number(error.get("delta", 0.01), "delta")
    if not 0 < epsilon < 1 or not 0 < delta < 1:
        raise QueryError("epsilon and delta must lie between 0 and 1")
    alert = _take(got.get("alert") or {}, "alertIf", gt=("gt",), lt=("lt",))
    export = _take(got.get("export") or {}, "export", prometheus=("prometheus",), series=("maxSeries", "max_series"))
    resources = _take(got.get("resources") or {}, "resources", memory=("maxMemory", "max_memory"))
    bound = {k: _number(v, f"alertIf.{k}") for k, v in alert.items() if v is not None}
    return Query(
        name, Window(size, slide), measure, _filter(got.get("match") or {}), group, epsilon, delta, bound.get("gt"), bound.get("lt"),
        bool(export.get("prometheus", True)), _whole(export.get("series", 1000), "maxSeries", U64, 1), parse_memory(resources["memory"]) if resources.get("memory") is not None else 128 << 20,
    )


def load_queries(paths: list[str]) -> list[Query]:
    """Queries of several files; two of one name are an error."""
    out: dict[str, Query] = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            query = parse_query(f.read())
        if query.name in out:
            raise QueryError(f"two queries are named {query.name}")
        out[query.name] = query
    return list(out.values())
