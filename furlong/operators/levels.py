"""The class a horse has raced in, how it did there, and its times against others under the same conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators import past

START = Window.unboundedPreceding


def past_extreme(df: DataFrame, keys: list[str], value: Column, name: str, largest: bool = True, as_of: str = "row") -> DataFrame:
    """Largest or least value before this row, or before this day."""
    best = F.max if largest else F.min
    valued = df.withColumn("_v", value)
    days = valued.groupBy(*keys, "day").agg(best("_v").alias("_day"))
    before = days.select(*keys, "day", best("_day").over(Window.partitionBy(*keys).orderBy("day").rowsBetween(START, -1)).alias(name))
    out = valued.join(before, [*keys, "day"], "left")
    if as_of == "row":
        today = best("_v").over(Window.partitionBy(*keys, "day").orderBy("race_id", "post_no").rowsBetween(START, -1))
        out = out.withColumn(name, (F.greatest if largest else F.least)(F.col(name), today))
    return out.drop("_v")


def own_extreme(df: DataFrame, value: Column, name: str, many: list) -> DataFrame:
    """Largest value of a horse before this row; null for an unknown horse. many: horses by the table of days (``past.own_past``)."""
    before = F.max(value).over(Window.partitionBy("horse_id").orderBy("day", "race_id", "post_no").rowsBetween(START, -1))
    return past.by_size(df, "horse_id", many, lambda x: x.withColumn(name, F.when(F.col("horse_id").isNotNull(), before)), lambda x: past_extreme(x, ["horse_id"], value, name))


def slope(values: Column, least: int = 3) -> Column:
    """Least-squares slope by start of an array of last values, the latest first; null below ``least`` known ones."""
    points = F.filter(F.transform(values, lambda v, j: F.struct((-j).cast("double").alias("x"), v.alias("y"))), lambda p: p["y"].isNotNull())
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))
    n, sx, sy = F.size(points), total(lambda p: p["x"]), total(lambda p: p["y"])
    sxy, sxx = total(lambda p: p["x"] * p["y"]), total(lambda p: p["x"] * p["x"])
    return F.when(n >= least, F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))


def level_features(df: DataFrame, level: str, relative_rank: str) -> DataFrame:
    """Last and mean level, the highest so far and the gaps to it, slope of the last five relative ranks, and the last
    three of them against all."""
    value = F.struct(F.col(level).cast("double").alias("l"), F.col(relative_rank).alias("r"))
    r = F.col(relative_rank)
    many = past.many_rows(df, "horse_id")
    out = past.own_past(df, ["horse_id"], {"_n": r.isNotNull().cast("int"), "_s": r}, ("_last", 5, value), many=many)
    out = own_extreme(out, F.col(level), "level_highest", many)
    levels, ranks = F.transform("_last", lambda x: x["l"]), F.transform("_last", lambda x: x["r"])
    return out.withColumns({
        "level_previous": F.get(levels, F.lit(0)).cast("long"),
        "level_last5": past.mean_of(levels),
        "level_change": (F.col(level) - F.get(levels, F.lit(0))).cast("long"),
        "level_below": (F.col(level) - F.col("level_highest")).cast("long"),
        "rank_slope": slope(ranks),
        "rank_recent": past.mean_of(F.slice(ranks, 1, 3)) - F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")),
    }).drop("_n", "_s", "_last")


def time_index(df: DataFrame, keys: list[str], seconds: Column, min_count: int = 30, limit: float = 5.0) -> DataFrame:
    """A horse's earlier times against all of earlier days under the same conditions: the last, mean of five, best."""
    z = past.standardized(df, keys, -seconds, "_z", min_count).withColumn("_z", F.when(F.col("_z").isNotNull(), F.least(F.greatest("_z", F.lit(-limit)), F.lit(limit))))
    many = past.many_rows(df, "horse_id")
    out = past.own_past(z, ["horse_id"], {}, ("_last", 5, F.col("_z")), many=many)
    out = own_extreme(out, F.col("_z"), "time_best", many)
    return out.withColumns({"time_previous": F.get("_last", F.lit(0)), "time_last5": past.mean_of(F.col("_last"))}).drop("_z", "_last")
