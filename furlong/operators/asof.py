"""As-of and interval operators: what was known at a time on the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_bias(races: DataFrame, cutoff_min: int, delay_min: int) -> DataFrame:
    """Count and shrunk mean of ``bias`` over the races of the same day and surface that started early enough before."""
    lag = (cutoff_min + delay_min) * 60
    w = Window.partitionBy("date", "surface").orderBy("start_s").rangeBetween(Window.unboundedPreceding, -lag)
    n = F.count("bias").over(w)
    return races.withColumns({"n_before": n, "bias_before": F.coalesce(F.sum("bias").over(w), F.lit(0.0)) / (n + 1)})


def latest_before(facts: DataFrame, key: str, at: str, other: DataFrame, other_at: str, value: str) -> DataFrame:
    """For each fact the last value of ``other`` with the same key at its time or earlier, by one union and a window."""
    left = facts.withColumns({"_t": F.col(at), "_v": F.lit(None).cast(other.schema[value].dataType), "_fact": F.lit(1)})
    right = other.select(F.col(key), F.col(other_at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_fact"))
    w = Window.partitionBy(key).orderBy("_t", "_fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return left.unionByName(right, allowMissingColumns=True).withColumn(f"last_{value}", F.last("_v", ignorenulls=True).over(w)).where("_fact = 1").drop("_t", "_v", "_fact")
