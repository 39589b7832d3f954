"""Packet capture files as flow events, and the 56-byte records of a kernel ring buffer.

Classic pcap, either byte order, microseconds or nanoseconds; Ethernet with up to two VLAN
tags, raw IP and Linux cooked captures; IPv4 and IPv6 with TCP, UDP or anything else.
A file isn't splittable, so files are the unit of work.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import FLOW_EVENT, complete

#: Fixed values of the formats.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
ETHERNET, RAW_IP, LINUX_SLL = 1, 101, 113
VLAN_TAGS, IPV4, IPV6 = (0x8100, 0x88A8), 0x0800, 0x86DD
EXTENSIONS, FRAGMENT = (0, 43, 51, 60), 44
MOST_CAPTURED = 256 * 1024
COLUMNS = ["ts_nanos", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "tcp_flags"]


class CaptureError(ValueError):
    """A file that is no capture, or a broken one."""


def parse_packet(link: int, data: bytes, wire: int | None = None) -> dict | None:
    """The event of a packet, or None if it isn't IP or doesn't hold together.  ``wire``: its length before cutting."""
    wire = len(data) if wire is None else wire
    at = 0
    if link == ETHERNET:
        at, tags = 14, 0
        while at <= len(data) and (kind := data[at - 2 : at]) and len(kind) == 2 and int.from_bytes(kind) in VLAN_TAGS and tags < 2:
            at, tags = at + 4, tags + 1
        kind = int.from_bytes(data[at - 2 : at]) if len(data) >= at else -1
    elif link == LINUX_SLL:
        at, kind = 16, int.from_bytes(data[14:16]) if len(data) >= 16 else -1
    elif link == RAW_IP:
        kind = {4: IPV4, 6: IPV6}.get(data[0] >> 4, -1) if data else -1
    else:
        return None
    if kind == IPV4:
        return _ipv4(data[at:], wire - at)
    return _ipv6(data[at:], wire - at) if kind == IPV6 else None


def _ipv4(ip: bytes, wire: int) -> dict | None:
    if len(ip) < 20 or ip[0] >> 4 != 4:
        return None
    head, total = (ip[0] & 15) * 4, int.from_bytes(ip[2:4])
    if head < 20 or not head <= total <= wire or len(ip) < head:
        return None
    first = int.from_bytes(ip[6:8]) & 0x1FFF == 0
    return _event(ip[12:16], ip[16:20], ip[9], total, ip[head:total], total - head, first)


def _ipv6(ip: bytes, wire: int) -> dict | None:
    if len(ip) < 40 or ip[0] >> 4 != 6:
        return None
    size, kind, at, first = int.from_bytes(ip[4:6]), ip[6], 40, True
    if not size or 40 + size > wire:
        return None
    for _ in range(6):
        if kind not in EXTENSIONS and kind != FRAGMENT:
            break
        if len(ip) < at + 8 or at + 8 > 40 + size:
            return None
        if kind == FRAGMENT:
            first = first and int.from_bytes(ip[at + 2 : at + 4]) >> 3 == 0
            step = 8
        else:
            step = (ip[at + 1] + 2) * 4 if kind == 51 else (ip[at + 1] + 1) * 8
        kind, at = ip[at], at + step
        if at > 40 + size:
            return None
        if not first:
            break
    if first and (kind in EXTENSIONS or kind == FRAGMENT):
        return None
    return _event(ip[8:24], ip[24:40], kind, 40 + size, ip[at : 40 + size], 40 + size - at, first)


def _event(src: bytes, dst: bytes, protocol: int, total: int, body: bytes, room: int, first: bool) -> dict | None:
    ports, flags = (0, 0), 0
    if first and protocol == 6:
        if len(body) < 14 or room < 20 or not 20 <= (body[12] >> 4) * 4 <= room:
            return None
        ports, flags = struct.unpack(">HH", body[:4]), body[13]
    elif first and protocol == 17:
        if len(body) < 8 or not 8 <= int.from_bytes(body[4:6]) <= room:
            return None
        ports = struct.unpack(">HH", body[:4])
    text = lambda b: str(ipaddress.ip_address(b))
    return {"src_ip": text(src), "dst_ip": text(dst), "src_port": ports[0], "dst_port": ports[1], "protocol": protocol, "bytes": total, "tcp_flags": flags}


def read_capture(data: bytes) -> Iterator[dict]:
    """Events of a capture in file order.  A cut record header ends it; a cut body is an error."""
    if data[:4] == PCAPNG:
        raise CaptureError("pcapng is not supported")
    if data[:4] not in MAGICS or len(data) < 24:
        raise CaptureError("not a pcap file")
    order, unit = MAGICS[data[:4]]
    link, at = struct.unpack(f"{order}I", data[20:24])[0], 24
    while at + 16 <= len(data):
        seconds, part, kept, wire = struct.unpack(f"{order}IIII", data[at : at + 16])
        at += 16
        if kept > MOST_CAPTURED or wire < kept or at + kept > len(data):
            raise CaptureError("a packet is cut short")
        if part * unit >= 1_000_000_000:
            raise CaptureError("a packet's time is out of range")
        event = parse_packet(link, data[at : at + kept], wire)
        at += kept
        if event:
            yield {"ts_nanos": seconds * 1_000_000_000 + part * unit, **event}


FILE_SHIFT = 40  # an event's arrival_seq is its file's rank above its place in the file


def first_time(head: bytes) -> int:
    """The time of a capture's first packet, read off its first 40 bytes; of an empty capture 0."""
    if head[:4] not in MAGICS or len(head) < 40:
        return 0
    order, unit = MAGICS[head[:4]]
    seconds, part = struct.unpack(f"{order}II", head[24:32])
    return seconds * 1_000_000_000 + part * unit


def events_of_files(files: DataFrame) -> DataFrame:
    """Flow events of a ``binaryFile`` table.

    Files arrive in the order of their first packets, then of their paths; ``arrival_seq``
    is the place in that order and in the file.
    """

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "first": [first_time(bytes(h)) for h in pdf["head"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for base, data in zip(pdf["base"], pdf.content, strict=True):
                held = []
                for i, e in enumerate(read_capture(bytes(data)), int(base)):
                    held.append((*(e[c] for c in COLUMNS), i))
                    if len(held) >= 50_000:
                        yield pd.DataFrame(held, columns=[*COLUMNS, "arrival_seq"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=[*COLUMNS, "arrival_seq"])

    schema = "ts_nanos bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, bytes bigint, tcp_flags int, arrival_seq bigint"
    times = files.select("path", F.substring("content", 1, 40).alias("head")).mapInPandas(heads, "path string, first bigint")
    # One row a file is ordered here, not the events.
    ranks = times.select("path", F.shiftleft((F.row_number().over(W.orderBy("first", "path")) - 1).cast("bigint"), FILE_SHIFT).alias("base"))
    return complete(files.join(ranks, "path").select("base", "content").mapInPandas(run, schema))


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    return events_of_files(spark.read.format("binaryFile").load(path))


class PcapDataSource(DataSource):
    """``spark.read.format("pcap").load(path)``; a comma parts several local files."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return FLOW_EVENT

    def reader(self, schema):
        return _PcapReader(self.options["path"].split(","))


class _PcapReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self):
        def first(path: str) -> tuple[int, str]:
            with open(path.removeprefix("file://"), "rb") as f:
                return first_time(f.read(40)), path

        return [InputPartition((i << FILE_SHIFT, p)) for i, (_, p) in enumerate(sorted(map(first, self.paths)))]

    def read(self, partition):
        base, path = partition.value
        with open(path.removeprefix("file://"), "rb") as f:
            for i, e in enumerate(read_capture(f.read()), base):
                yield (e["ts_nanos"], e["src_ip"], e["dst_ip"], e["src_port"], e["dst_port"], e["protocol"], e["bytes"], 1, "unknown", e["tcp_flags"], 0, 0, None, None, None, i)


#: The ring record: version, direction, protocol, flags, ports, interface, L3 bytes, monotonic time, addresses. 56 bytes.
RING = struct.Struct("<BBBBHHIIQ16s16s")


def parse_ring_record(data: bytes, unix_minus_monotonic: int) -> dict:
    """An event of a kernel record; addresses of version 4 are in the last four of their sixteen bytes."""
    if len(data) != RING.size:
        raise CaptureError(f"a record has {RING.size} bytes")
    version, direction, protocol, flags, sport, dport, interface, size, mono, src, dst = RING.unpack(data)
    if version not in (4, 6) or direction > 2:
        raise CaptureError("IP version or direction out of range")
    text = lambda b: str(ipaddress.ip_address(b[12:] if version == 4 else b))
    return {
        "ts_nanos": mono + unix_minus_monotonic, "src_ip": text(src), "dst_ip": text(dst), "src_port": sport, "dst_port": dport, "protocol": protocol,
        "bytes": size, "packets": 1, "direction": ("unknown", "ingress", "egress")[direction], "tcp_flags": flags, "interface_index": interface,
    }


def write_capture(events: Iterator[dict], payload: int = 64) -> bytes:
    """A nanosecond Ethernet capture of events; packets are cut after ``payload`` bytes of their body, headers are whole."""
    out = [b"\x4d\x3c\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 1 << 18, ETHERNET)]
    for e in events:
        src, dst = ipaddress.ip_address(e["src_ip"]).packed, ipaddress.ip_address(e["dst_ip"]).packed
        v4, protocol = len(src) == 4, e["protocol"]
        l4 = {6: 20, 17: 8}.get(protocol, 0)
        total = max(e["bytes"], (20 if v4 else 40) + l4 + (0 if v4 or l4 else 1))
        body = total - (20 if v4 else 40)
        if v4:
            ip = struct.pack(">BBHHHBBH", 0x45, 0, total, 0, 0, 64, protocol, 0) + src + dst
        else:
            ip = struct.pack(">IHBB", 6 << 28, body, protocol, 64) + src + dst
        ports = struct.pack(">HH", e.get("src_port", 0), e.get("dst_port", 0))
        head = ports + struct.pack(">IIBBHHH", 0, 0, 0x50, e.get("tcp_flags", 0), 0, 0, 0) if protocol == 6 else ports + struct.pack(">HH", body, 0) if protocol == 17 else b""
        frame = b"\x02" * 12 + struct.pack(">H", IPV4 if v4 else IPV6) + ip + head
        wire = 14 + total
        frame += bytes(min(payload, wire - len(frame)))
        out.append(struct.pack("<IIII", *divmod(e["ts_nanos"], 1_000_000_000), len(frame), wire) + frame)
    return b"".join(out)


def quarantine(events: DataFrame, now_nanos: int, within: int = 300_000_000_000) -> tuple[DataFrame, DataFrame]:
    """Events whose time is within five minutes of now, and the others."""
    ok = f"abs(ts_nanos - {now_nanos}) <= {within}"
    return events.where(ok), events.where(f"not ({ok})")
