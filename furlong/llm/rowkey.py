"""Keys and numbers of documents' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from furlong.session import materialize

#: After all other ids.
LAST = (1 << 63) - 1


def row_key() -> Column:
    """A number >= 0 by doc_id and text: rows that agree in both, and no others but for collisions of 63 bits, share it."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"), 1)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with pos, the row's number in its key by the given order, and total, the key's rows.

    Rows are dealt into ranges of (key, order), so that a key of any size is spread; only one row for each range and key is
    summed up.
    """
    by = ["key", *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    ranged = materialize(df.sparkSession, ranged, name)
    spans = ranged.groupBy("part", "key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("part", "key", (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    return ranged.join(spans, ["part", "key"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def with_order(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number in the order of doc_id, whatever its type; equal ids share one, null ids have LAST.

    Whole numbers are their own order. Other ids are numbered by ranges, which costs a join by doc_id.
    """
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    ids = docs.where("doc_id is not null").select(F.lit("").alias("key"), F.col("doc_id").alias(f"{name}_id")).distinct()
    order = numbered(ids, "id-order", f"{name}_id").select(f"{name}_id", F.col("pos").alias(name))
    joined = docs.join(order, F.col("doc_id") == F.col(f"{name}_id"), "left").drop(f"{name}_id")
    return joined.withColumn(name, F.coalesce(name, F.lit(LAST)))
