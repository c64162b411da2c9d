"""Windows over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.session import new_path
from furlong.streaming.sinks import drain, read_stream


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by tumbling day and type, from a stream that reads what is there and stops. A day is written once, when the
    watermark has passed it by a day, so what is stored is one row for each day and type; days that are still open are counted
    from the table itself."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = [F.count("*").alias("n"), F.sum("value").alias("total")]
    events = read_stream(spark, f"{sf_dir}/events.parquet", table.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(*counts).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    done = drain(closed, new_path(spark, "windows"), new_path(spark, "state")).rows
    end = done.agg(F.max("start")).first()[0]
    rest = table.withColumn("start", F.date_trunc("day", F.col("ts").cast("timestamp")))
    rest = rest if end is None else rest.where(F.col("start") > F.lit(end))
    every = done.unionByName(rest.groupBy("start", "event_type").agg(*counts))
    return every.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
