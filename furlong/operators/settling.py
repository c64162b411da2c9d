"""Settling what was predicted: a grid of probabilities and plans on the same races, and boxes against results as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.stats import wilson

UNIT = 100


def evaluate_grid(df: DataFrame, sources: list[str], plans: dict[str, tuple[int, int, int]], target: float, by: list[str] | None = None) -> DataFrame:
    """by, source, plan, races, hits, hot, stake, paid, rate of hot races with its bounds, and return, of every source of
    probabilities with every plan of nested first n1, n2 and n3 runners. Runners are sent once for each source, races once for
    each plan. A source's races are those that have it for all runners; places go by the probability, then by post."""
    by = by or []
    each = df.select("race_id", "post_no", "finish_rank", "payout", *by, F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).alias("p")) for s in sources))).alias("x")).select("race_id", "post_no", "finish_rank", "payout", *by, "x.*")
    w = Window.partitionBy("race_id", "source")
    each = each.withColumns({"_k": F.row_number().over(w.orderBy(F.desc(F.round("p", 12)), "post_no")), "_known": F.min(F.col("p").isNotNull().cast("int")).over(w)}).where("_known = 1")
    at = lambda k: F.min(F.when(F.col("finish_rank") == k, F.col("_k")))
    races = each.groupBy("race_id", "source", *by).agg(F.count("*").alias("field"), F.first("payout").alias("payout"), at(1).alias("r1"), at(2).alias("r2"), at(3).alias("r3")).where("field >= 3")
    choice = F.explode(F.array(*(F.struct(F.lit(name).alias("plan"), *(F.lit(v).alias(f"n{i}") for i, v in enumerate(n, 1))) for name, n in plans.items())))
    rows = races.withColumn("x", choice).select(*races.columns, "x.*")
    hit = F.coalesce((F.col("r1") <= F.col("n1")) & (F.col("r2") <= F.col("n2")) & (F.col("r3") <= F.col("n3")), F.lit(False))
    size = lambda c: F.least(c, "field")
    rows = rows.withColumns({"_hit": hit, "_paid": F.when(hit, F.col("payout")).otherwise(0.0), "_points": size("n1") * (size("n2") - 1) * (size("n3") - 2)})
    g = rows.groupBy(*by, "source", "plan").agg(F.count("*").alias("races"), F.sum(F.col("_hit").cast("long")).alias("hits"), F.sum((F.col("_paid") >= target).cast("long")).alias("hot"), (F.sum("_points") * UNIT).cast("long").alias("stake"), F.sum("_paid").alias("paid"))
    low, high = wilson(F.col("hot"), F.col("races"))
    return g.withColumns({"rate": F.col("hot") / F.col("races"), "low": low, "high": high, "roi": F.try_divide("paid", "stake")})


def reconcile(predicted: DataFrame, results: DataFrame, payouts: DataFrame, races: DataFrame, size: int = 6, refunded: tuple[str, ...] = ("1", "3"), hot: float = 50_000.0, key: str = "post_no") -> DataFrame:
    """A row for each predicted race: state ("cancelled", "pending", "no payout", "checked"), runners of the box that ran,
    refunded and missing ones, stake, hit, paid, hot, balance.

    predicted: race_id, key, model_rank. results: race_id, key, post_no, state (of the runner). payouts: race_id, combos (an
    array of a, b, c, pay; several in a dead heat). races: race_id, cancelled. A refunded or missing runner is not bet on; the
    box pays every combination whose three posts are all in it. Money columns are null unless the race is checked.
    """
    box = predicted.where(F.col("model_rank") <= size).join(results.select("race_id", key, F.col(key).isNotNull().alias("_ran"), *([F.col("post_no")] if key != "post_no" else []), "state"), ["race_id", key], "left")
    back = F.coalesce(F.col("state").isin(*refunded), F.lit(False))
    ran = F.coalesce("_ran", F.lit(False)) & ~back
    count = lambda c: F.sum(c.cast("long"))
    # a box has at most ``size`` posts
    own = box.groupBy("race_id").agg(count(ran).alias("runners"), count(back).alias("refunded"), count(F.col("_ran").isNull()).alias("missing"), F.collect_set(F.when(ran, F.col("post_no").cast("long"))).alias("_box"))
    have = results.select("race_id").distinct().withColumn("_result", F.lit(True))
    g = own.join(have, "race_id", "left").join(payouts, "race_id", "left").join(races.select("race_id", "cancelled"), "race_id", "left")
    inside = lambda x: F.forall(F.array(x["a"], x["b"], x["c"]), lambda post: F.array_contains("_box", post.cast("long")))
    paid = F.aggregate(F.filter("combos", inside), F.lit(0.0), lambda t, x: t + x["pay"].cast("double"))
    state = F.when(F.col("cancelled"), "cancelled").when(F.col("_result").isNull(), "pending").when(F.coalesce(F.size("combos"), F.lit(0)) <= 0, "no payout").otherwise("checked")
    n = F.col("runners")
    checked = F.col("state") == "checked"
    g = g.withColumns({"state": state, "stake": F.when(n >= 3, n * (n - 1) * (n - 2) * UNIT).otherwise(0), "paid": paid})
    g = g.withColumns({"stake": F.when(checked, F.col("stake")), "paid": F.when(checked, F.col("paid"))})
    return g.select("race_id", "state", "runners", "refunded", "missing", "stake", (F.col("paid") > 0).alias("hit"), "paid", (F.col("paid") >= hot).alias("hot"), (F.col("paid") - F.col("stake")).alias("balance"))
