"""Versions of records: folds, deduplication and keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_versions(df: DataFrame, keys: list[str], priority: dict[str, int], order: tuple[str, ...] = ("made", "seq")) -> DataFrame:
    """Per key, in order: "0" deletes what is held, any other known state replaces what is held if its priority is not less."""
    rank = F.create_map(*(x for k, v in priority.items() for x in (F.lit(k), F.lit(v))))
    w = Window.partitionBy(*keys).orderBy(*order)
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = df.where((F.col("state") == "0") | F.col("state").isin(*priority)).withColumn("_gone", F.max((F.col("state") == "0").cast("int")).over(rest))
    live = known.where("_gone = 0").withColumn("_p", rank[F.col("state")])
    best = Window.partitionBy(*keys).orderBy(F.desc("_p"), *(F.desc(c) for c in order))
    return live.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_gone", "_p", "_k")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in the order, and how many there were. Kept by a combining aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"), F.count("*").alias("n_versions"))
    return top.select(*keys, "_s.*", "n_versions")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: list[Column] | None = None, protected: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key; the named columns come from ``new`` where it has the key. change: new, updated, same or missing.

    Of several new rows of a key the last by ``order`` holds (without an order the greatest by the named columns), and
    n_given says how many there were, null where none was. Protected columns keep what the old row has, unless that is null.
    """
    given = latest(new.select(*keys, *columns, *([F.struct(*order).alias("_order")] if order else [])), keys, [F.col("_order")] if order else [F.col(c) for c in columns])
    right = given.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in columns), F.col("n_versions").alias("n_given"))
    both = old.withColumn("_in_old", F.lit(True)).join(right, keys, "full")
    kept = {c: F.coalesce(c, f"_n_{c}") if c in protected else F.col(f"_n_{c}") for c in columns}
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(kept[c])
    change = F.when(F.col("_in_old").isNull(), "new").when(F.col("n_given").isNull(), "missing").when(same, "same").otherwise("updated")
    values = {c: F.when(F.col("n_given").isNull(), F.col(c)).otherwise(kept[c]) for c in columns}
    return both.withColumn("change", change).withColumns(values).drop("_in_old", *(f"_n_{c}" for c in columns))
