"""Intermediate tables in the folder that the driver and all executors share.

A table that several later steps read is written once as Parquet under
``spark.checkpoint.dir`` and read back: the lineage ends there, and an executor
that is lost later costs a re-read, not a recomputation. Only where that
setting is absent (tests on one machine) a temporary folder stands in for it.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one set here where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidentia-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(mark: int = 0) -> None:
    """Delete the tables staged since ``mark`` (see ``mark()``)."""
    while len(_written) > mark:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        if jvm is None:
            continue
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    return len(_written)


def release() -> None:
    """Give memory that a fit or a worker's earlier tasks have freed back to the system, where Arrow and the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


@atexit.register
def _leave() -> None:
    try:
        drop()
    except Exception:  # the session ended first; the cluster cleans its folder
        pass
