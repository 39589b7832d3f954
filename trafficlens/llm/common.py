"""Shared helpers: scratch tables in the shared folder and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a row group of scratch tables: a task that writes or reads one holds that much of its heap, not Parquet's 128 MB.
ROW_GROUP = 8 << 20
#: Bytes of a batch that goes to Python or comes back, about: Spark's 10,000 rows are 35 MB of texts, held several times over by the executor and its worker.
BATCH = 4 << 20
#: Rows that Spark's Parquet reader decodes at once: its 4096 are 20 MB of texts and more, in arrays that double, for each task.
READ_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session (a test) may name none: a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="trafficlens-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.  Row groups are small."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches of rows for Python are cut at :data:`BATCH` bytes, its Parquet reader decodes
    :data:`READ_ROWS` at once and its row groups end at :data:`ROW_GROUP`, unless it has bounds of its own.

    A row longer than that is a batch alone.  Spark reads the settings when a plan runs, so they are not put back: what the
    caller of a stage writes from it has small row groups too, and the next stage's tasks read them in little memory.
    """
    bounds = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS, "parquet.block.size": ROW_GROUP}
    for key, most in bounds.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def screen_words(marks: DataFrame, column: str, count: int, most_bits: int) -> tuple[int, DataFrame]:
    """The bits of a table and its (word, bits) rows, ``most_bits / 64`` at most: bit ``mark % bits`` is set for each mark."""
    bits = min(most_bits, 1 << max(10, (256 * count).bit_length()))
    at = marks.select(F.col(column).bitwiseAND(bits - 1).alias("bit"))
    return bits, at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))


def without(docs: DataFrame, lost: DataFrame, id_col: str, most_bits: int = 1 << 26) -> DataFrame:
    """``docs`` but for rows whose id is in ``lost`` (id).

    Whole rows aren't shuffled to meet the ids: a bit table of bounded size (2**20 rows) is sent to
    all, and only rows that it can't tell from lost ones go through the join.
    """
    marks = lost.select(F.xxhash64(F.col("id").cast("bigint")).alias("mark"))
    bits, words = screen_words(marks, "mark", lost.count(), most_bits)
    mark = F.xxhash64(F.col(id_col).cast("bigint")).bitwiseAND(bits - 1)
    marked = docs.withColumn("_bit", mark).withColumn("_word", F.shiftright("_bit", 6))
    marked = marked.join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), "_word", "left")
    hit = F.coalesce(F.expr("(shiftright(_bits, int(_bit & 63)) & 1) = 1"), F.lit(False))
    unsure = marked.where(hit).join(lost.select(F.col("id").alias("_lost")), F.col(id_col).cast("bigint") == F.col("_lost"), "left_anti")
    return marked.where(~hit).select(docs.columns).unionByName(unsure.select(docs.columns))


def drop_own(df: DataFrame, names: list[str]) -> DataFrame:
    """Without columns named like those an operator adds: the operator's own replace them."""
    lowered = {n.lower() for n in names}
    return df.select([c for c in df.columns if c.lower() not in lowered])


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null gives empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def extend_schema(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.string())), 0), dtype=np.int64)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` bytes together; a longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def with_columns(batch: pa.RecordBatch, **added: pa.Array) -> pa.RecordBatch:
    names = [*batch.schema.names, *added]
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=names)


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    columns = list(batch.columns)
    columns[i] = values
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow; its worker gives back free memory at the end, so that idle workers hold little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return lean(run)
