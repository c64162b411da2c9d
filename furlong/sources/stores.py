"""Partitioned tables that can be written twice: a version is seen whole or not at all.

A write puts its rows into a folder of its own version, dealt by the partition columns, and then adds a row for each of its
partitions to the manifest. Readers take the newest version of each partition from the manifest alone. So a write that is
killed changes nothing, one that is run again replaces its own folder, and a version replaces exactly the partitions it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furlong.sources.texts import exists


def _folder(path: str, version: str) -> str:
    if not version or not all(c.isalnum() or c in "_-" for c in version):
        raise ValueError(f"a version is named by letters, digits, - and _: {version!r}")
    return f"{path}/data/{version}"


def write(df: DataFrame, path: str, version: str, partitions: list[str]) -> None:
    """Make df the newest version of the partitions that it has. A version's name is used once; a second write of the same
    name, as after a failure, replaces the first and changes nothing else. Rows need values in the partition columns."""
    spark = df.sparkSession
    folder = _folder(path, version)
    if df.where(" or ".join(f"{p} is null" for p in partitions)).limit(1).count():
        raise ValueError("rows without a partition")
    df.repartition(*partitions).write.mode("overwrite").partitionBy(*partitions).parquet(folder)
    done = manifest(spark, path, df.schema, partitions)
    if done.where(F.col("version") == version).limit(1).count():
        return
    last = done.agg(F.max("number")).first()[0]
    rows = spark.read.schema(df.schema).parquet(folder).groupBy(*partitions).count()
    rows.select(F.lit(version).alias("version"), F.lit((last or 0) + 1).cast("long").alias("number"), *partitions, F.col("count").alias("n_rows")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, schema: StructType, partitions: list[str]) -> DataFrame:
    """version, number, the partition columns and n_rows of all writes."""
    kinds = ", ".join(f"{p} {schema[p].dataType.simpleString()}" for p in partitions)
    shape = f"version string, number long, {kinds}, n_rows long"
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, schema: StructType, partitions: list[str]) -> DataFrame:
    """The rows of the newest version of every partition; versions that have none are not opened."""
    newest = manifest(spark, path, schema, partitions).groupBy(*partitions).agg(F.max_by("version", "number").alias("version"))
    found = spark.createDataFrame([], schema)
    # versions that hold the newest of any partition; old ones drop out as they are replaced
    for r in newest.select("version").distinct().orderBy("version").collect():
        own = newest.where(F.col("version") == r["version"]).drop("version")
        part = spark.read.schema(schema).parquet(_folder(path, r["version"]))
        found = found.unionByName(part.join(own, partitions, "left_semi"))
    return found


def summary(spark: SparkSession, path: str, schema: StructType, partitions: list[str]) -> DataFrame:
    """Rows, files and bytes of the newest version of every partition."""
    newest = manifest(spark, path, schema, partitions).groupBy(*partitions).agg(F.max_by("version", "number").alias("version"), F.max_by("n_rows", "number").alias("n_rows"))
    found = None
    for r in newest.select("version").distinct().orderBy("version").collect():
        files = spark.read.schema(schema).parquet(_folder(path, r["version"])).select(*partitions, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
        own = files.distinct().groupBy(*partitions).agg(F.count("*").alias("files"), F.sum("b").alias("bytes")).withColumn("version", F.lit(r["version"]))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return newest.withColumns({"files": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")})
    return newest.join(found, [*partitions, "version"])
