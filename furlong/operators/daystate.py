"""Totals of entities that are kept from day to day, so that the features of a day cost that day and not the history.

The store has one row for each entity as of its last day: sums, and its last rows. It is dealt into buckets by entity; a day
reads the buckets of its own entities, writes the rows of those that it changed as a new layer, and then a mark. A reader takes
the latest row of each entity from the base and the marked layers; ``compact`` writes a new base. A day that is tried again,
or whose mark is missing, gives the same features and replaces its layer.

Defined results: rows without an entity have no past and are not stored. A day must come after all stored ones, or be the last
of them. An empty day changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_LAYER = -1


@dataclass(frozen=True)
class Spec:
    """keys: what an entity is. sums: totals over its rows. last: name, number and value of the last rows that are kept."""

    keys: tuple[str, ...]
    sums: dict[str, Column]
    last: tuple[str, int, Column] | None = None
    order: tuple[str, ...] = ("race_id", "post_no")
    buckets: int = 32


def _known(spec: Spec) -> Column:
    known = F.lit(True)
    for k in spec.keys:
        known = known & F.col(k).isNotNull()
    return known


def _bucket(spec: Spec) -> Column:
    return F.pmod(F.xxhash64(*spec.keys), F.lit(spec.buckets)).cast("int")


def _added(rows: DataFrame, spec: Spec) -> DataFrame:
    """An entity's totals over rows: keys, sums, its last rows and the last day."""
    valued = rows.where(_known(spec)).withColumns({f"_v_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in spec.sums.items()})
    found = [F.sum(f"_v_{n}").alias(n) for n in spec.sums]
    if spec.last:
        name, k, value = spec.last
        recent = F.row_number().over(Window.partitionBy(*spec.keys).orderBy(F.desc("day"), *(F.desc(c) for c in spec.order))) <= k
        valued = valued.withColumn("_now", F.when(recent, F.struct("day", *spec.order, value.alias("v"))))
        # at most k of them
        found.append(F.transform(F.reverse(F.array_sort(F.collect_list("_now"))), lambda x: x["v"]).alias(name))
    return valued.groupBy(*spec.keys).agg(*found, F.max("day").alias("through"))


def _marks(spark: SparkSession, path: str) -> list[int]:
    """The base's number and the days since, in the order they were marked."""
    marks = spark.read.schema("n long, layer long").parquet(f"{path}/marks").collect()  # a row for each day since the start
    return [r["layer"] for r in sorted(marks)]


def _mark(spark: SparkSession, path: str, layer: int, n: int) -> None:
    spark.createDataFrame([(n, layer)], "n long, layer long").coalesce(1).write.mode("append").parquet(f"{path}/marks")


def start(history: DataFrame, spec: Spec, path: str) -> None:
    """Build the store from all rows of earlier days."""
    _added(history, spec).withColumn("bucket", _bucket(spec)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/0")
    _mark(history.sparkSession, path, BASE_LAYER, 0)


def _layers(spark: SparkSession, path: str, before: int | None) -> tuple[int, list[int]]:
    """The number of the newest base and the days that came after it, those before a day alone."""
    marks = _marks(spark, path)
    base = max(i for i, m in enumerate(marks) if m == BASE_LAYER)
    days = [d for d in dict.fromkeys(marks[base + 1 :]) if before is None or d < before]
    return sum(m == BASE_LAYER for m in marks) - 1, days


def state(spark: SparkSession, spec: Spec, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The store's rows as of all marked days, or of those before a day; only the given buckets are read."""
    base, days = _layers(spark, path, before)
    found = None
    for layer in (f"base/{base}", *(f"days/{d}" for d in days)):
        part = spark.read.parquet(f"{path}/{layer}")
        part = part if buckets is None else part.where(F.col("bucket").isin(buckets))
        found = part if found is None else found.unionByName(part)
    if not days:
        return found
    rest = [c for c in found.columns if c not in spec.keys and c != "bucket"]
    newest = found.groupBy(*spec.keys, "bucket").agg(F.max_by(F.struct(*rest), "through").alias("s"))
    return newest.select(*spec.keys, "bucket", "s.*")


def advance(rows: DataFrame, spec: Spec, path: str) -> DataFrame:
    """The rows of one day with the totals as of the day before; the day's own results go into the store."""
    spark = rows.sparkSession
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return _joined(rows, state(spark, spec, path), spec)
    marks = _marks(spark, path)
    done = max((m for m in marks if m != BASE_LAYER), default=None)
    if first != last or (done is not None and first < done):
        raise ValueError(f"days come one by one and in order: {first} to {last} after {done}")
    own = rows.where(_known(spec))
    # no more numbers than there are buckets
    touched = sorted(r[0] for r in own.select(_bucket(spec)).distinct().collect())
    before = state(spark, spec, path, first, touched)
    before_rows = before.where(F.col("through") < first)
    new, old = _added(own, spec), before_rows.select(*spec.keys, *(F.col(c).alias(f"_o_{c}") for c in [*spec.sums, *([spec.last[0]] if spec.last else [])]))
    merged = new.join(old, list(spec.keys), "left")
    sums = [(F.col(n) + F.coalesce(f"_o_{n}", F.lit(0.0))).alias(n) for n in spec.sums]
    kept = []
    if spec.last:
        name, k, _ = spec.last
        former = F.coalesce(f"_o_{name}", F.array().cast(merged.schema[name].dataType))
        kept = [F.slice(F.concat(name, former), 1, k).alias(name)]
    layer = merged.select(*spec.keys, *sums, *kept, "through").withColumn("bucket", _bucket(spec))
    layer.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/days/{first}")
    if done != first:
        _mark(spark, path, first, len(marks))
    return _joined(rows, before_rows, spec)


def _joined(rows: DataFrame, before: DataFrame, spec: Spec) -> DataFrame:
    out = rows.join(before.drop("bucket", "through"), list(spec.keys), "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in spec.sums})
    return out


def compact(spark: SparkSession, spec: Spec, path: str) -> None:
    """Write the newest rows of all entities as a new base; older layers are no longer read."""
    marks = _marks(spark, path)
    number = sum(m == BASE_LAYER for m in marks)
    state(spark, spec, path).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/{number}")
    _mark(spark, path, BASE_LAYER, len(marks))
