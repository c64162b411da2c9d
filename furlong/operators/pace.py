"""Pace: sectional times from laps, paces against earlier races under the same conditions, and the pace to expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators import past


def laps_of(running: Column) -> Column:
    """Laps from running times: each less the one before it."""
    before = F.concat(F.array(F.lit(0.0)), F.slice(running, 1, F.greatest(F.size(running) - 1, F.lit(0))))
    return F.zip_with(running, before, lambda a, b: a - b)


def sectionals(df: DataFrame, laps: str) -> DataFrame:
    """n_laps (above 0), first3, last3 (of the laps as counted), total, pace (first3 - last3); the sums need three laps."""
    filled = F.transform(laps, lambda x: F.when(x > 0, x.cast("double")).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size(F.filter(laps, lambda x: x > 0))
    out = df.withColumns({"n_laps": F.coalesce(n, F.lit(0)).cast("long"), "_f": filled})
    enough = F.col("n_laps") >= 3
    out = out.withColumns({
        "first3": F.when(enough, total(F.slice("_f", 1, 3))),
        "last3": F.when(enough, total(F.slice("_f", F.greatest(F.col("n_laps") - 2, F.lit(1)).cast("int"), F.lit(3)))),
        "total": F.when(F.col("n_laps") > 0, total(F.col("_f"))),
    })
    return out.withColumn("pace", F.col("first3") - F.col("last3")).drop("_f")


def race_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each race: the named values of its first runner, so that no runner sees another of the same race."""
    return df.groupBy("race_id").agg(F.min_by(F.struct(*columns), "post_no").alias("_s")).select("race_id", "_s.*")


def by_condition(df: DataFrame, value: str, name: str, sign: float = 1.0, min_count: int = 30) -> DataFrame:
    """Deviation of a race's value from the races of earlier days on the same surface and band of 400 m, in standard
    deviations; every race counts once."""
    races = race_frame(df.withColumn("_band", F.floor(F.col("distance") / 400)), ["day", "surface", "_band", value])
    z = past.standardized(races, ["surface", "_band"], F.col(value) * sign, name, min_count)
    return df.join(z.select("race_id", name), "race_id", "left")


def pace_features(df: DataFrame, z: str, fast: float = 0.0) -> DataFrame:
    """A horse's earlier paces: the last, the mean, the mean when placed, show rates in fast and slow races and their gap."""
    v, shown = F.col(z), (F.col("finish_rank") <= 3).cast("int")
    # a race at the mean of its kind is no fast one, whatever the last bit says
    is_fast, is_slow = F.round(v - fast, 9) > 0, F.round(v - fast, 9) <= 0
    sums = {"_n": v.isNotNull().cast("int"), "_s": v, "_pn": F.when(shown == 1, v.isNotNull().cast("int")), "_ps": F.when(shown == 1, v)}
    sums |= {"_fn": is_fast.cast("int"), "_fs": F.when(is_fast, shown), "_ln": is_slow.cast("int"), "_ls": F.when(is_slow, shown)}
    out = past.own_past(df, ["horse_id"], sums, ("_last", 1, v))
    rate = lambda s, n, least: F.when(F.col(n) >= least, F.col(s) / F.col(n))
    out = out.withColumns({"pace_previous": F.get("_last", F.lit(0)), "pace_mean": rate("_s", "_n", 1), "pace_placed": rate("_ps", "_pn", 1), "fast_show": rate("_fs", "_fn", 2), "slow_show": rate("_ls", "_ln", 2)})
    return out.withColumn("fast_less_slow", F.col("fast_show") - F.col("slow_show")).drop(*sums, "_last")


def expected_pace(df: DataFrame, pressure: str, z: str, min_count: int = 50) -> DataFrame:
    """Mean pace of the races of earlier days with as much pressure, in bins of a twentieth."""
    races = race_frame(df.withColumn("_bin", F.round(F.coalesce(F.col(pressure), F.lit(-1.0)) * 20)), ["day", "_bin", z])
    known = past.past_mean(races, ["_bin"], F.col(z), "expected_pace", min_count, "day")
    return df.join(known.select("race_id", "expected_pace"), "race_id", "left")
