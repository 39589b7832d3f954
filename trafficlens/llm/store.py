"""Binary files in the shared folder, opened by executors' Python through its URI."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import SparkSession


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme == "file" else uri if not parts.scheme else None


@contextmanager
def create(uri: str) -> Iterator[BinaryIO]:
    """A new file that appears under its name when it is whole: a task that fails or runs twice leaves no torn file."""
    path = _local(uri)
    system, name = (None, path) if path else fs.FileSystem.from_uri(uri)
    part = f"{name}.{uuid.uuid4().hex}.part"
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            yield f
        os.replace(part, name)
    else:
        system.create_dir(os.path.dirname(name), recursive=True)
        with system.open_output_stream(part) as f:
            yield f
        system.move(part, name)


@contextmanager
def open_read(uri: str) -> Iterator[BinaryIO]:
    path = _local(uri)
    if path:
        with open(path, "rb") as f:
            yield f
    else:
        system, name = fs.FileSystem.from_uri(uri)
        with system.open_input_file(name) as f:
            yield f


def listing(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files of a folder, by name; read through Hadoop."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted((f.getPath().toString().replace("file:/", "file:///", 1) if f.getPath().toString().startswith("file:/") and not f.getPath().toString().startswith("file://") else f.getPath().toString(), f.getLen()) for f in system.listStatus(path) if f.getPath().getName().endswith(suffix))
