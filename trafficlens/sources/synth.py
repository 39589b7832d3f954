"""Synthetic traces: background, a few heavy pairs and scanners, from hashes of the row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import complete

BASE_SECONDS = 1_700_000_000


def synth(spark: SparkSession, packets: int, seconds: int = 120, seed: int = 7, scanners: int = 2, talkers: int = 3) -> DataFrame:
    """``packets`` events over ``seconds``: a tenth scans, a fifth is heavy, the rest background.  Any row can be made alone."""
    n = lambda k, below: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(below))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    one_of = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (n(k, len(v)) + 1).cast("int"))
    roll = n(0, 100)
    pick = lambda scan, heavy, rest: F.when(roll < 10, scan).when(roll < 30, heavy).otherwise(rest)
    udp = n(9, 4) == 0
    rows = spark.range(packets).select(
        (F.lit(BASE_SECONDS * 1_000_000_000) + F.floor(F.col("id") * (seconds * 1_000_000_000 / max(packets, 1)))).cast("bigint").alias("ts_nanos"),
        pick(text("10.66.0.", n(1, scanners) + 1), text("10.1.1.", n(1, talkers) + 10), text("10.9.", n(1, 32), ".", n(2, 250) + 1)).alias("src_ip"),
        pick(text("10.", n(3, 100) + 100, ".", n(4, 250), ".", n(5, 250) + 1), text("10.2.2.", n(1, talkers) + 10), text("10.8.", n(3, 8), ".", n(4, 250) + 1)).alias("dst_ip"),
        (n(6, 28_000) + 32_768).cast("int").alias("src_port"),
        pick(one_of(7, 22, 80, 443, 5432, 6379), F.lit(443), F.when(udp, 53).otherwise(one_of(8, 80, 443))).alias("dst_port"),
        pick(F.lit(6), F.lit(6), F.when(udp, 17).otherwise(6)).alias("protocol"),
        pick(F.lit(60), n(10, 200) + 1200, F.when(udp, 80).otherwise(n(10, 800) + 200)).cast("bigint").alias("bytes"),
        pick(F.lit(2), F.lit(16), F.lit(16)).alias("tcp_flags"),
        F.col("id").alias("arrival_seq"),
    )
    return complete(rows)
