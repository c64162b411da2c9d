"""Searching rules that choose races: every pair of metrics with every pair of shares, in one pass.

A rule keeps the share of races with the largest, or the least, values of a metric. The second rule of a pair takes its share
of what the first has left. Races are sent once for each first rule that keeps them and once for each second metric, so the
work is a fixed multiple of the races, and exact quantiles are taken for all rules together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.stats import quantiles, wilson
from furlong.session import materialize


def _kept(df: DataFrame, by: list[str], shares: list[float], name: str) -> DataFrame:
    """df (with v, the metric turned so that larger is kept) once for each share that keeps the row, with the share as name."""
    edges = quantiles(df, by, "v", [1 - s for s in shares], "_q").select(*by, "_q")
    each = F.explode(F.filter(F.transform("_q", lambda q, i: F.struct(F.element_at(F.array(*(F.lit(float(s)) for s in shares)), i + 1).alias("share"), q.alias("q"))), lambda x: F.col("v") >= x["q"]))
    return df.join(edges, by).withColumn("_x", each).withColumn(name, F.col("_x")["share"]).drop("_q", "_x")


def two_rules(races: DataFrame, metrics: dict[str, bool], shares: list[float], hit: Column, points: Column, target: float, least_races: int = 50) -> DataFrame:
    """first, share1, second, share2, races, hits, hot, paid, stake, low, high of every pair of metrics (in the order given)
    whose races are ``least_races`` or more; low and high bound the rate of hits that reach the target. metrics: whether the
    larger values are kept. races: race_id, payout and the metrics; a race without a value passes no rule on it."""
    names = list(metrics)
    turned = [F.struct(F.lit(i).alias("m"), (F.col(c) if metrics[c] else -F.col(c)).cast("double").alias("v")) for i, c in enumerate(names)]
    paid = F.when(hit, F.col("payout").cast("double")).otherwise(0.0)
    base = races.select("race_id", hit.cast("long").alias("hit"), paid.alias("paid"), points.cast("long").alias("points"), F.array(*turned).alias("all"))
    # each rule's quantiles and the table of pairs read the races: they are made once
    base = materialize(races.sparkSession, base, "rule-races")
    one = base.withColumn("x", F.explode("all")).select("race_id", "hit", "paid", "points", "all", F.col("x.m").alias("m1"), F.col("x.v").alias("v")).where("v is not null")
    one = _kept(one, ["m1"], shares, "share1").drop("v")
    two = one.withColumn("x", F.explode(F.filter("all", lambda x: x["m"] > F.col("m1")))).select("race_id", "hit", "paid", "points", "m1", "share1", F.col("x.m").alias("m2"), F.col("x.v").alias("v")).where("v is not null")
    two = _kept(two, ["m1", "share1", "m2"], shares, "share2")
    found = two.groupBy("m1", "share1", "m2", "share2").agg(F.count("*").alias("races"), F.sum("hit").alias("hits"), F.sum((F.col("paid") >= target).cast("long")).alias("hot"), F.sum("paid").alias("paid"), (F.sum("points") * 100).alias("stake"))
    low, high = wilson(F.col("hot"), F.col("races"))
    named = lambda m: F.element_at(F.array(*(F.lit(n) for n in names)), F.col(m) + 1)
    return found.where(F.col("races") >= least_races).select(named("m1").alias("first"), "share1", named("m2").alias("second"), "share2", "races", "hits", "hot", "paid", "stake", low.alias("low"), high.alias("high"))
