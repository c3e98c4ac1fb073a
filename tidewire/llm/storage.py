"""The folder that driver and executors share, and files written in it.

The folder is the one a cluster names in ``spark.checkpoint.dir``.  Only where
that setting is empty and the master is local (tests, a laptop) is a private
folder made; on a cluster its absence is an error.
Local and mounted folders (no scheme, or ``file:``) are memory-mapped; a file
of any other scheme is copied through ``pyarrow.fs`` to an unnamed file of the
machine that reads it, once for each Python worker, and mapped there.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidewire.session import bounded_batches  # noqa: F401  its users import it from here

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that all machines of this session see."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tidewire-shared-"))
    return _own_folder[0]


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one run of an operator."""
    return f"{shared_folder(spark)}/tidewire-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, uri: str) -> DataFrame:
    """``df`` stored as Parquet at ``uri`` and read back: cuts the lineage."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def removed(spark: SparkSession, *uris: str) -> None:
    """Delete folders whose tables nothing reads any more."""
    for uri in uris:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def put_file(uri: str, chunks) -> None:
    """Write byte chunks under ``uri``; a reader sees all of it or nothing.

    Every attempt writes its own temporary name and moves it into place, so a
    repeated or speculative task leaves the same whole file.
    """
    path = _local(uri)
    attempt = f"{uri}.{uuid.uuid4().hex}.part"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = _local(attempt)
        with open(part, "wb") as out:
            for chunk in chunks:
                out.write(chunk)
        os.replace(part, path)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(attempt)
    with system.open_output_stream(inner) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(inner, fs.FileSystem.from_uri(uri)[1])


def get_bytes(uri: str) -> bytes:
    """All bytes of a small file."""
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    with system.open_input_file(inner) as f:
        return f.read()


@lru_cache(4096)
def _copied(uri: str) -> np.ndarray:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(inner) as source:
        while chunk := source.read(1 << 22):
            copy.write(chunk)
        copy.flush()
        return np.memmap(copy, dtype=np.uint8, mode="r") if copy.tell() else np.zeros(0, np.uint8)


def mapped(uri: str, dtype) -> np.ndarray:
    """A flat array file, memory-mapped."""
    path = _local(uri)
    if path is None:
        return _copied(uri).view(dtype)
    if os.path.getsize(path) == 0:
        return np.zeros(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r")
