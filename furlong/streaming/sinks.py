"""Draining a stream into a table that a restart goes on with."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Drained:
    """What a run has written in all, and how many rows this run has dropped because they came behind the watermark."""

    rows: DataFrame
    late: int


def read_stream(spark: SparkSession, folder: str, schema, files_at_once: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or a single file, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    # a stream reads folders; a table that is one file is picked out of its folder by name
    at, name = os.path.split(folder.rstrip("/"))
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{at}/{name}*")


def drain(stream: DataFrame, path: str, checkpoint: str) -> Drained:
    """Process what the source has and stop. The file sink's log makes each batch appear once, also if it is tried again; a
    later run with the same checkpoint goes on with the same state."""
    spark = stream.sparkSession
    former = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", former)
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    return Drained(spark.read.schema(stream.schema).parquet(path), late)
