"""Tables between the rounds of an iterative operator, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where none is named, on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and read it back; then the staged table that it ``replaces`` is deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if old := getattr(replaces, "staged_at", None):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return out
