"""The addressable fields of a flow event, and small scalar functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SEPARATOR = "\x1f"
#: IANA protocol numbers with names; a fixed table.
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp", 58: "icmpv6"}


@dataclass(frozen=True)
class Field:
    """``name`` in queries, the event's column, its widest text, and its OTLP attribute."""

    name: str
    column: str
    width: int
    attribute: str

    @property
    def label(self) -> str:
        return self.name.replace(".", "_")

    @property
    def numeric(self) -> bool:
        return self.name in ("bytes", "packets")

    def text(self) -> Column:
        """The canonical text of the field, which keys are made of."""
        c = F.col(self.column)
        return protocol_name(c) if self.name == "protocol" else c.cast("string")


def _field(name: str, column: str, width: int, attribute: str | None = None) -> Field:
    return Field(name, column, width, attribute or f"trafficlens.group.{name.replace('.', '_')}")


FIELDS = {
    f.name: f
    for f in (
        _field("src.ip", "src_ip", 39, "source.address"),
        _field("dst.ip", "dst_ip", 39, "destination.address"),
        _field("src.port", "src_port", 5, "source.port"),
        _field("dst.port", "dst_port", 5, "destination.port"),
        _field("protocol", "protocol", 6, "network.protocol.name"),
        _field("bytes", "bytes", 10),
        _field("packets", "packets", 10),
        _field("direction", "direction", 7),
        _field("tcp.flags", "tcp_flags", 3),
        _field("interface.index", "interface_index", 10),
        _field("node.id", "node_id", 20),
    )
}


def protocol_name(number: Column) -> Column:
    out = number.cast("string")
    for n, name in PROTOCOLS.items():
        out = F.when(number == n, F.lit(name)).otherwise(out)
    return out


def protocol_number(value: object) -> int:
    """A name, in any case, or a number from 0 to 255."""
    if isinstance(value, str):
        for n, name in PROTOCOLS.items():
            if value.lower() == name:
                return n
        if not value.isascii() or not value.isdigit():
            raise ValueError(f"unknown protocol {value!r}")
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= 255:
        raise ValueError(f"protocol must be a name or 0-255, not {value!r}")
    return value


def group_key(fields: list[Field]) -> Column:
    """Canonical texts joined by the unit separator; empty without fields."""
    return F.concat_ws(KEY_SEPARATOR, *(f.text() for f in fields)) if fields else F.lit("")


def pane_of(ts_nanos: Column, slide: int) -> Column:
    """The epoch-aligned start of the pane; pmod keeps pre-epoch times on the grid."""
    return ts_nanos - F.pmod(ts_nanos, F.lit(slide))
