"""Reports: coverage, trends, agreement, drift of odds, rates by group, and sets of labelled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.stats import quantiles, wilson


def null_shares(runners: DataFrame, races: DataFrame, year: str, runner_columns: list[str], race_columns: list[str]) -> DataFrame:
    """For each year the runners, races, and the share of missing values of the named columns of both; years of one alone stay."""
    share = lambda c: F.avg(F.col(c).isNull().cast("int"))
    a = runners.groupBy(year).agg(F.count("*").alias("runners"), *(share(c).alias(f"no_{c}") for c in runner_columns))
    b = races.groupBy(year).agg(F.count("*").alias("races"), *(share(c).alias(f"no_{c}") for c in race_columns))
    return a.join(b, year, "full")


def segment_labels(grade: Column, graded: list[str], top: str) -> Column:
    """The segments that a race counts in: all, graded or flat, and the top grade by itself."""
    is_graded = F.coalesce(grade.isin(*graded), F.lit(False))
    return F.filter(F.array(F.lit("all"), F.when(is_graded, "graded").otherwise("flat"), F.when(grade == top, "top")), lambda x: x.isNotNull())


def trend(df: DataFrame, year: str, labels: Column, value: str, target: float, segments: list[str]) -> DataFrame:
    """A row for each year; for each segment n, median and share that reaches the target, side by side."""
    long = df.select(year, value, F.explode(labels).alias("segment"))
    middle = quantiles(long, [year, "segment"], value, [0.5]).select(year, "segment", F.col("q")[0].alias("median"))
    counts = long.groupBy(year, "segment").agg(F.count(value).alias("n"), F.avg((F.col(value) >= target).cast("int")).alias("share"))
    both = counts.join(middle, [year, "segment"])
    wide = both.groupBy(year).pivot("segment", segments).agg(F.first("n").alias("n"), F.first("median").alias("median"), F.first("share").alias("share"))
    return wide


def agreement(df: DataFrame, by: str, a: str, b: str, near: float) -> DataFrame:
    """For each value of ``by``, and in all (null): rows with both values, share that differs by less than ``near``, mean and
    mean absolute difference."""
    gap = F.col(a) - F.col(b)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(by).isNotNull())
    return both.rollup(by).agg(F.count("*").alias("n"), F.avg((F.abs(gap) < near).cast("int")).alias("same"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(gap)).alias("mean_abs_gap"))


def five_numbers(df: DataFrame, by: str, value: str, total: str = "all") -> DataFrame:
    """Least, quartiles and largest value of each group and of all."""
    long = df.where(F.col(by).isNotNull()).select(value, F.explode(F.array(F.col(by).cast("string"), F.lit(total))).alias(by))
    return quantiles(long, [by], value, [0, 0.25, 0.5, 0.75, 1])


def rates(df: DataFrame, by: list[str], hit: Column, stake: Column, paid: Column, predicted: Column | None = None) -> DataFrame:
    """n, hits, rate with Wilson bounds, stake, paid, return, and how far the rate is above the predicted one."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"), F.sum(stake).alias("stake"), F.sum(paid).alias("paid"), F.avg(predicted if predicted is not None else F.lit(None).cast("double")).alias("predicted"))
    low, high = wilson(F.col("hits"), F.col("n"))
    rate = F.col("hits") / F.col("n")
    return g.withColumns({"rate": rate, "low": low, "high": high, "roi": F.try_divide("paid", "stake"), "above": rate - F.col("predicted")})


def drift_pairs(early: DataFrame, final: DataFrame, keys: list[str], target: float, stake: str) -> DataFrame:
    """Early and final odds of the same combination: ratio, its logarithm, and whether the stake still reaches the target."""
    both = early.select(*keys, stake, F.col("odds").alias("early")).join(final.select(*keys, F.col("odds").alias("final")), keys)
    good = both.where("early > 0 and final > 0")
    ratio = F.col("final") / F.col("early")
    return good.withColumns({"ratio": ratio, "log_ratio": F.log(ratio), "reaches": F.col("final") * F.col(stake) >= target - 1e-6})


def drift_table(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of the ratio, mean and deviation of its logarithm, share that still reaches the target, rows and races."""
    spread = quantiles(pairs, by, "ratio", [0.25, 0.5, 0.75])
    rest = pairs.groupBy(*by).agg(F.avg("log_ratio").alias("mean_log"), F.stddev_samp("log_ratio").alias("std_log"), F.avg(F.col("reaches").cast("int")).alias("reach_share"), F.count_distinct("race_id").alias("races"))
    return spread.join(rest, by)


def drift_compare(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], pooled: str) -> DataFrame:
    """Two drift tables of the same combinations side by side, by group and, with ``pooled`` as "all", over its values."""
    both = a.select(*keys, *by, F.col("log_ratio").alias("a")).join(b.select(*keys, F.col("log_ratio").alias("b")), keys)
    long = both.withColumn(pooled, F.explode(F.array(F.col(pooled).cast("string"), F.lit("all"))))
    return long.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs("a")).alias("early_move"), F.avg(F.abs("b")).alias("late_move"), F.avg((F.abs("b") < F.abs("a")).cast("int")).alias("calmer"))


def snapshot_drift(snapshots: DataFrame, final: DataFrame, keys: list[str]) -> DataFrame:
    """For each race and minutes to the start: combinations, mean absolute log ratio to the final odds, shares within 10 and 25 %."""
    both = snapshots.join(final.select(*keys, F.col("odds").alias("final")), keys).where("odds > 0 and final > 0")
    move = F.abs(F.log(F.col("odds") / F.col("final")))
    within = lambda x: F.avg((F.abs(F.col("odds") / F.col("final") - 1) <= x).cast("int"))
    return both.groupBy("race_id", "minutes").agg(F.count("*").alias("n"), F.avg(move).alias("move"), within(0.10).alias("within10"), within(0.25).alias("within25"))


def due(races: DataFrame, done: DataFrame, minutes: str, low: int, high: int) -> DataFrame:
    """Races whose minutes to the start lie between the two, both included, and that have not been taken yet."""
    return races.where(F.col(minutes).between(low, high)).join(done.select("race_id").distinct(), "race_id", "left_anti")


def importance(df: DataFrame, gain: str) -> DataFrame:
    """feature, sum of its gain, share of all, and rank; equal sums share a rank."""
    from pyspark.sql import Window

    total = df.groupBy("feature").agg(F.sum(gain).alias("gain"))
    # one row for each feature of a model
    w = Window.orderBy(F.desc("gain"))
    return total.withColumns({"rank": F.rank().over(w).cast("long"), "share": F.col("gain") / F.sum("gain").over(Window.partitionBy())})


def equal_parts(df: DataFrame, value: str, q: int, name: str) -> DataFrame:
    """Number 1 to q of the part that the row is in, by the value's exact quantiles (right-closed)."""
    edges = quantiles(df, [], value, [k / q for k in range(1, q)], "_e").select("_e")
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter("_e", lambda x: F.col(value) > x)) + 1).cast("long")).drop("_e")
