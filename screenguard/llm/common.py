"""Shared folders, worker import paths and Arrow helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and give checkpoint() a shared folder.

    ``spark.checkpoint.dir`` wins. Where it is unset, a local master gets a folder of its own,
    and a cluster one in the warehouse, which all executors share. Arrow batches get a limit of
    bytes in place of Spark's much larger one: whole texts are long.
    """
    if spark.conf.get(BATCH, "67108864b") == "67108864b":  # Spark's default
        spark.conf.set(BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    env = context.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, env.get("PYTHONPATH", "")) if x)
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            shared = tempfile.mkdtemp(prefix="screenguard-")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/screenguard-checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and is smaller than a checkpoint.

    The table goes when the driver ends, or with discard().
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.stored_at = path
    atexit.register(discard, out)
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of stored(), once nothing reads it any more."""
    try:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the JVM may be gone
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def release() -> None:
    """Give memory that a task has freed back to the system: workers stay for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def reclaim(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are no longer in use: it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sliced(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``chars`` bytes of the text column, at least one row each."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0), dtype=np.int64)
        end, at = np.cumsum(size), 0
        while at < b.num_rows:
            before = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, before + chars, side="right")))
            yield b.slice(at, to - at)
            at = to
