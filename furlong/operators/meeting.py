"""What a meeting's earlier days and races tell, places against expectation, and prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators import past


def race_bias(df: DataFrame, position: str, value: str, min_count: int = 30) -> DataFrame:
    """One row for each race: mean post and mean position of all less those of the first three, and the deviation of the
    mean of ``value`` from earlier days' races at the same venue, distance and surface."""
    top = F.col("finish_rank") <= 3
    less = lambda c: F.avg(c) - F.avg(F.when(top, F.col(c)))
    first = lambda c: F.min_by(c, "post_no")
    races = df.groupBy("race_id").agg(less("post_no").alias("post_bias"), less(position).alias("position_bias"), F.avg(value).alias("_v"), *(first(c).alias(c) for c in ("day", "venue", "distance", "surface")))
    return past.standardized(races, ["venue", "distance", "surface"], F.col("_v"), "closing", min_count).drop("_v")


def meeting_bias(races: DataFrame, keys: list[str], bias: str, shrink: float = 2.0) -> DataFrame:
    """Bias of the same meeting up to the day before, drawn towards 0: sum / (n + shrink), and on how many races it stands."""
    out = past.past_totals(races, keys, {"_s": F.col(bias), "_n": F.col(bias).isNotNull().cast("int")}, "day")
    return out.withColumns({"meeting_bias": F.col("_s") / (F.col("_n") + shrink), "meeting_races": F.col("_n").cast("long")}).drop("_s", "_n")


def bias_terms(df: DataFrame, bias: Column, style: Column) -> DataFrame:
    """A bias on the own post (0 inside to 1 outside) and style; without one both are 0."""
    w = Window.partitionBy("race_id")
    post = F.try_divide(F.col("post_no") - 1, F.max("post_no").over(w) - 1)
    return df.withColumns({"bias_post": F.coalesce(bias * post, F.lit(0.0)), "bias_style": F.coalesce(bias * style, F.lit(0.0))})


def place_residual(df: DataFrame, expected: str, shrink: float = 2.0) -> DataFrame:
    """How much more often than expected a horse came second or third on earlier days: sum / (n + shrink)."""
    gap = F.col("finish_rank").isin(2, 3).cast("double") - F.col(expected)
    out = past.past_totals(df, ["horse_id"], {"_s": gap, "_n": past.one()}, "day")
    return out.withColumn("place_residual", F.col("_s") / (F.col("_n") + shrink)).drop("_s", "_n")


def scored(df: DataFrame, score: str) -> DataFrame:
    """A model's scores as probabilities of a race, and their ranks."""
    w = Window.partitionBy("race_id")
    return df.withColumns({"probability": F.try_divide(F.col(score), F.sum(score).over(w)), "predicted_rank": F.row_number().over(w.orderBy(F.desc_nulls_last(F.round(score, 12)), "post_no")).cast("long")})


def race_lines(df: DataFrame, rank: str, top: int) -> DataFrame:
    """One line for each race: the posts of the first ``top`` by rank, joined by dots."""
    chosen = df.where(F.col(rank) <= top).groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), "post_no"))).alias("x"))  # at most ``top`` of them
    return chosen.select("race_id", F.array_join(F.transform("x", lambda x: x["post_no"].cast("string")), "・").alias("line"))


def one_day_features(history: DataFrame, targets: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Mean of the value over all days of the history before each target's day. Targets see no other target, even one of an
    earlier day: only the history is summed up, and each target takes the last state before its day."""
    days = history.groupBy(*keys, "day").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = days.select(*keys, F.col("day").alias("_t"), F.lit(0).alias("_target"), F.struct(F.sum("_s").over(w).alias("s"), F.sum("_n").over(w).alias("n")).alias("_state"))
    rows = targets.withColumns({"_t": F.col("day"), "_target": F.lit(-1), "_state": F.lit(None).cast(states.schema["_state"].dataType)})
    both = rows.unionByName(states, allowMissingColumns=True)
    # a target of a day stands before that day's state
    before = F.last("_state", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_target").rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("_before", before).where("_target = -1")
    return found.withColumn(name, F.try_divide(F.col("_before")["s"], F.col("_before")["n"])).drop("_t", "_target", "_state", "_before")
