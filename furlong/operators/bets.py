"""Bets: strategies on the model's order, expected value, back-tests, and intervals for their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from furlong.operators.stats import quantiles, wilson


def race() -> WindowSpec:
    return Window.partitionBy("race_id")


def model_rank(df: DataFrame, p: str) -> DataFrame:
    return df.withColumn("model_rank", F.row_number().over(race().orderBy(F.desc(p), "post_no")).cast("long"))


def race_table(df: DataFrame) -> DataFrame:
    """A row for each race of three runners or more: field, grade, payout and the model's rank of the first three."""
    at = lambda k: F.min(F.when(F.col("finish_rank") == k, F.col("model_rank")))
    return df.groupBy("race_id").agg(F.count("*").alias("field"), F.first("grade").alias("grade"), F.first("payout").alias("payout"), at(1).alias("r1"), at(2).alias("r2"), at(3).alias("r3")).where("field >= 3")


def simulate(races: DataFrame, n1: int, n2: int, n3: int, by: list[str], target: float) -> DataFrame:
    """Nested top-n1/n2/n3 bets of 100 a point: hits, hits that reach the target, stake, rates with Wilson bounds, return."""
    a, b, c = (F.least(F.lit(k), F.col("field")) for k in (n1, n2, n3))
    hit = ((F.col("r1") <= n1) & (F.col("r2") <= n2) & (F.col("r3") <= n3)).cast("int")
    rows = races.withColumns({"_hit": hit, "_points": a * (b - 1) * (c - 2)}).withColumn("_paid", F.when(F.col("_hit") == 1, F.col("payout")).otherwise(0.0))
    g = rows.groupBy(*by).agg(F.count("*").alias("races"), F.sum("_hit").alias("hits"), F.sum((F.col("_paid") >= target).cast("int")).alias("hot"), (F.sum("_points") * 100).alias("stake"), F.sum(F.col("_paid").cast("decimal(18,6)")).cast("double").alias("paid"))  # exact, in any order of adding
    low, high = wilson(F.col("hits"), F.col("races"))
    return g.withColumns({"hit_rate": F.col("hits") / F.col("races"), "low": low, "high": high, "roi": F.col("paid") / F.col("stake")})


def expected_value(df: DataFrame, p: str, least: float, per_race: int) -> DataFrame:
    """Runners whose p * odds reaches ``least``, the best of each race; of equal ones the lower post. Values are rounded where
    they are compared: by the market's own shares all of a race are equal but for the last bit."""
    ev = df.withColumn("ev", F.col(p) * F.col("win_odds")).where(F.round("ev", 10) >= least)
    return ev.withColumn("pick", F.row_number().over(race().orderBy(F.desc(F.round("ev", 10)), "post_no")).cast("long")).where(F.col("pick") <= per_race)


def kelly(p: Column, odds: Column, cap: float) -> Column:
    b = odds - 1
    return F.coalesce(F.least(F.greatest(F.try_divide(p * b - (1 - p), b), F.lit(0.0)), F.lit(cap)), F.lit(0.0))


def stake_to_reach(odds: Column, target: float) -> Column:
    """The least stake, in units of 100, whose payout reaches the target."""
    return (F.ceil(F.round(target / odds / 100, 6)) * 100).cast("long")


def band(value: Column, edges: list[float]) -> Column:
    """Number of the left-closed band."""
    out = F.lit(0)
    for k, e in enumerate(edges):
        out = F.when(value >= e, k + 1).otherwise(out)
    return out.cast("long")


def difficulty(df: DataFrame, p: str) -> DataFrame:
    """Entropy, normalised entropy, sample deviation, largest share, lead, top-three sum and Gini index of a race."""
    s = df.withColumn("_k", F.row_number().over(race().orderBy(F.desc(p), "post_no")))
    n = F.count("*")
    top = lambda k: F.sum(F.when(F.col("_k") == k, F.col(p)).otherwise(0.0))
    entropy = -F.sum(F.col(p) * F.log(p))
    # ascending place of the k-th largest of n is n + 1 - k
    weighted = (n + 1) * F.sum(p) - F.sum(F.col("_k") * F.col(p))
    return s.groupBy("race_id").agg(n.alias("field"), entropy.alias("entropy"), F.when(n > 1, entropy / F.log(n)).alias("evenness"), F.stddev_samp(p).alias("spread"), F.max(p).alias("top"), (top(1) - top(2)).alias("lead"), (top(1) + top(2) + top(3)).alias("top3"), (2 * weighted / n - (n + 1) / n).alias("gini"))


def strata(df: DataFrame, metric: str, q: int) -> DataFrame:
    """Numbers of the quantile strata (right-closed edges)."""
    edges = quantiles(df, [], metric, [k / q for k in range(1, q)], "e").select(F.array_distinct("e").alias("e"))
    # one row
    return df.join(F.broadcast(edges)).withColumn("stratum", F.size(F.filter("e", lambda x: F.col(metric) > x)).cast("long")).drop("e")
