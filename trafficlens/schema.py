"""Event and result schemas, and adapters from tables to flow events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_long, _int, _text = T.LongType(), T.IntegerType(), T.StringType()
FLOW_EVENT = T.StructType(
    [
        T.StructField("ts_nanos", _long, False),
        T.StructField("src_ip", _text),
        T.StructField("dst_ip", _text),
        T.StructField("src_port", _int),
        T.StructField("dst_port", _int),
        T.StructField("protocol", _int),
        T.StructField("bytes", _long),
        T.StructField("packets", _long),
        T.StructField("direction", _text),
        T.StructField("tcp_flags", _int),
        T.StructField("interface_index", _long),
        T.StructField("node_id", _long),
        T.StructField("namespace_id", _long),
        T.StructField("pod_id", _long),
        T.StructField("service_id", _long),
        T.StructField("arrival_seq", _long),
    ]
)
ESTIMATE = T.StructType(
    [
        T.StructField("query_name", _text),
        T.StructField("window_start_nanos", _long),
        T.StructField("window_end_nanos", _long),
        T.StructField("group", T.ArrayType(T.StructType([T.StructField("name", _text), T.StructField("value", _text)]))),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("lower_bound", T.DoubleType()),
        T.StructField("upper_bound", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("algorithm", _text),
        T.StructField("sketch_bytes", _long),
        T.StructField("update_count", _long),
    ]
)
DEFAULTS = {"packets": 1, "direction": "unknown", "tcp_flags": 0, "interface_index": 0, "node_id": 0, "src_port": 0, "dst_port": 0, "protocol": 0, "bytes": 0}


def complete(events: DataFrame) -> DataFrame:
    """``events`` with all columns of the schema: what is absent gets its default or null."""
    out = []
    for f in FLOW_EVENT.fields:
        if f.name in events.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "arrival_seq":
            out.append(F.col("ts_nanos").cast("bigint").alias("arrival_seq"))
        else:
            out.append(F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name))
    return events.select(*out)


def from_events(events: DataFrame) -> DataFrame:
    """Flow events from the ``events`` table; see :data:`EVENTS_SQL` for the same in DuckDB."""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.expr("array(6, 17, 1, 58, 47)[cast(pmod(length(event_type), 5) as int)]")
    return complete(
        events.select(
            (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_nanos"),
            F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
            F.concat(F.lit("10.1.0."), k.cast("string")).alias("dst_ip"),
            F.lit(40000).alias("src_port"),
            k.alias("dst_port"),
            kinds.alias("protocol"),
            F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
            F.lit(1).alias("packets"),
            (F.col("user_id") % 4).alias("interface_index"),
            F.col("event_id").alias("arrival_seq"),
        )
    )


EVENTS_SQL = """
SELECT epoch_us(ts) * 1000 AS ts_nanos,
       '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
       '10.1.0.' || CAST(json_extract(props, '$.k') AS INT) AS dst_ip,
       40000 AS src_port, CAST(json_extract(props, '$.k') AS INT) AS dst_port,
       [6, 17, 1, 58, 47][length(event_type) % 5 + 1] AS protocol,
       CAST(round(value * 100) AS BIGINT) AS bytes, 1 AS packets, 'unknown' AS direction, 0 AS tcp_flags,
       user_id % 4 AS interface_index, 0 AS node_id, event_id AS arrival_seq
FROM events
"""


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Flow events from ``lineitem``: suppliers send parts by the price of their bytes."""
    return complete(
        lineitem.select(
            (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_nanos"),
            F.concat(F.lit("10.2."), F.expr("l_suppkey div 256").cast("string"), F.lit("."), (F.col("l_suppkey") % 256).cast("string")).alias("src_ip"),
            F.concat(F.lit("10.3."), F.expr("l_partkey div 256").cast("string"), F.lit("."), (F.col("l_partkey") % 256).cast("string")).alias("dst_ip"),
            F.lit(40000).alias("src_port"),
            F.lit(443).alias("dst_port"),
            F.when(F.col("l_linestatus") == "O", 6).otherwise(17).alias("protocol"),
            F.round("l_extendedprice").cast("bigint").alias("bytes"),
            F.col("l_quantity").cast("bigint").alias("packets"),
            F.col("l_linenumber").alias("interface_index"),
        )
    )


LINEITEM_SQL = """
SELECT epoch_us(l_shipdate) * 1000 AS ts_nanos,
       '10.2.' || (l_suppkey // 256) || '.' || (l_suppkey % 256) AS src_ip,
       '10.3.' || (l_partkey // 256) || '.' || (l_partkey % 256) AS dst_ip,
       40000 AS src_port, 443 AS dst_port, CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS protocol,
       CAST(round(l_extendedprice) AS BIGINT) AS bytes, CAST(l_quantity AS BIGINT) AS packets, 'unknown' AS direction, 0 AS tcp_flags,
       l_linenumber AS interface_index, 0 AS node_id, epoch_us(l_shipdate) * 1000 AS arrival_seq
FROM lineitem
"""
