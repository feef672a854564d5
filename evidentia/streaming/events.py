"""Event streams: windowed counts, deduplication and sessions, as Structured Streaming queries.

Each function takes a streaming DataFrame of events (event_id, ts, user_id,
event_type, value) and returns one; ``run_once`` runs a query over what is
there and returns its output as a table. These have no counterpart in the
evidence domain; the deduplication is the streaming form of "first of a key".
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators.staging import shared_folder

DELAY = "2 hours"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # watermarks need an instant; results go back to the table's local timestamps
    # a pattern, as a plain path to a single file is no valid stream source
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum of values per window and type, updated until the watermark passes."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", DELAY).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    return events.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_of_key(events: DataFrame) -> DataFrame:
    """The first event of each id that arrives within the watermark's delay."""
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run over all available input; with ``keys``, the last state of every key."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces what it wrote
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out/batch=*")
    if keys:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))).where("_n = 1").drop("_n")
    return out.drop("_batch", "batch")


def batched(f: Callable, mode: str = "update", keys: list[str] | None = None) -> Callable:
    return lambda spark, sf: run_once(f(read_events(spark, sf)), mode, keys)
