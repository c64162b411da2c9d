"""Hypotheses that are fixed before the folds are seen: does a segment do better, is a plan the best, does a condition help, and
which plan may replace the present one.

Races are rows with a fold, ``hit`` (0 or 1: a bet that reached its target) and what the hypothesis asks about. Every answer is
given for each fold and over all of them, so that an effect of one fold is seen as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.betting import condition
from furlong.operators.stats import paired_proportions, two_proportions, wilson


def rates(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, n, hits, rate and the Wilson bounds."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.withColumns({"rate": F.col("hits") / F.col("n"), "low": low, "high": high})


def segment_by_fold(races: DataFrame, fold: str, inside: Column, hit: Column) -> DataFrame:
    """fold, n_in, hits_in, n_out, hits_out, rate_in, rate_out and better: whether the segment has the higher rate; a side
    without races has the rate 0 in this comparison. Races that are neither inside nor outside are left out."""
    side = lambda c, s: F.sum(F.when(inside == s, c).otherwise(0))
    h = hit.cast("long")
    one = F.lit(1).cast("long")
    g = races.where(inside.isNotNull()).groupBy(fold).agg(side(one, True).alias("n_in"), side(h, True).alias("hits_in"), side(one, False).alias("n_out"), side(h, False).alias("hits_out"))
    g = g.withColumns({"rate_in": F.try_divide("hits_in", "n_in"), "rate_out": F.try_divide("hits_out", "n_out")})
    return g.withColumn("better", F.coalesce("rate_in", F.lit(0.0)) > F.coalesce("rate_out", F.lit(0.0)))


def segment_test(by_fold: DataFrame) -> DataFrame:
    """Over all folds of ``segment_by_fold``: in how many the segment was better, the pooled counts and their test."""
    g = by_fold.agg(F.count("*").alias("folds"), F.sum(F.col("better").cast("long")).alias("better"), *(F.sum(c).alias(c) for c in ("n_in", "hits_in", "n_out", "hits_out")))
    return g.withColumns(two_proportions(F.col("hits_in"), F.col("n_in"), F.col("hits_out"), F.col("n_out")))


def plans_by_fold(races: DataFrame, fold: str, plans: dict[str, Column]) -> DataFrame:
    """fold, plan, number (its place in the order given), n, hits, rate, low, high of every plan on the same races."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("number"), F.lit(name).alias("plan"), c.cast("long").alias("hit")) for k, (name, c) in enumerate(plans.items()))))
    return rates(races.select(fold, each.alias("x")).select(fold, "x.*"), [fold, "plan", "number"], F.col("hit"))


def best_plans(by_fold: DataFrame, fold: str) -> DataFrame:
    """fold, by_rate and by_low: the plan with the highest rate and the one with the highest lower bound; of equal ones the
    first in the order given."""
    best = lambda c: F.max_by("plan", F.struct(F.round(c, 12), -F.col("number")))
    return by_fold.groupBy(fold).agg(best("rate").alias("by_rate"), best("low").alias("by_low"))


def conditions_by_fold(races: DataFrame, fold: str, conditions: dict[str, list[tuple[str, bool, float]]], hit: Column) -> DataFrame:
    """condition, fold, n, hits, rate, low, high; the condition "all" keeps every race. Cuts are taken in each fold."""
    found = rates(races, [fold], hit).withColumn("condition", F.lit("all"))
    for name, rules in conditions.items():
        found = found.unionByName(rates(condition(races, rules, fold), [fold], hit).withColumn("condition", F.lit(name)))
    return found.select("condition", fold, "n", "hits", "rate", "low", "high")


def conditions_test(by_fold: DataFrame, fold: str) -> DataFrame:
    """condition, folds, low_better, rate_better (in how many folds it beats all races), mean_n, and consistent: whether its
    lower bound was better in every fold."""
    every = by_fold.where("condition = 'all'").select(fold, F.col("low").alias("_low"), F.col("rate").alias("_rate"))
    both = by_fold.where("condition <> 'all'").join(every, fold)
    better = lambda a, b: F.sum((F.col(a) > F.col(b)).cast("long"))
    g = both.groupBy("condition").agg(F.count("*").alias("folds"), better("low", "_low").alias("low_better"), better("rate", "_rate").alias("rate_better"), F.avg("n").alias("mean_n"))
    return g.withColumn("consistent", F.col("low_better") == F.col("folds"))


def replacement(rows: DataFrame, base: str) -> DataFrame:
    """rows: race_id, plan, hit. Each plan against the base on the races that both have: n, only_plan, only_base, difference,
    low, high, p_value, passes (the difference's lower bound is above 0), and chosen: of the plans that pass the one with the
    highest rate over its own races (then the first by name); the base is chosen if none passes."""
    one = rows.groupBy("race_id", "plan").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    own = one.groupBy("plan").agg(F.avg("hit").alias("own_rate"))
    other = one.where(F.col("plan") == base).select("race_id", F.col("hit").alias("_base"))
    both = one.where(F.col("plan") != base).join(other, "race_id")
    count = lambda c: F.sum(c.cast("long"))
    x, y = F.col("hit") == 1, F.col("_base") == 1
    g = both.groupBy("plan").agg(count(x & y).alias("both"), count(x & ~y).alias("only_plan"), count(~x & y).alias("only_base"), F.count("*").alias("n"))
    g = g.withColumns(paired_proportions(F.col("both"), F.col("only_plan"), F.col("only_base"), F.col("n"))).withColumn("passes", F.col("low") > 0)
    everyone = g.join(own, "plan")
    # one row a plan, and plans are a design of a few
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("passes").desc(), F.col("own_rate").desc(), "plan")
    return everyone.withColumn("chosen", F.when((F.row_number().over(w) == 1) & F.col("passes"), True).otherwise(False)).drop("both")
