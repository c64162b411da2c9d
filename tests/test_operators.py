"""Edge cases of the analytics operators: nulls, ties, empty tables, leaks."""

import numpy as np
from pyspark.sql import functions as F

from furlong.operators import asof, bets, betting, features, market, past, records

RUNS = "race_id long, post_no long, horse_id long, day long, value double"


def test_past_never_sees_its_own_value(spark):
    rows = [(1, 1, 7, 10, 1.0), (1, 2, 8, 10, 5.0), (2, 1, 7, 11, 2.0), (3, 1, 7, 11, 4.0), (4, 1, None, 12, 9.0)]
    for as_of, want in (("row", [0.0, 0.0, 1.0, 3.0, 0.0]), ("race", [0.0, 0.0, 1.0, 3.0, 0.0]), ("day", [0.0, 0.0, 1.0, 1.0, 0.0])):
        got = past.past_sum(spark.createDataFrame(rows, RUNS), ["horse_id"], "value", "x", as_of).orderBy("race_id", "post_no")
        assert [r.x for r in got.collect()] == want
        changed = [r if r[0] != 3 else (*r[:4], 1e9) for r in rows]
        again = past.past_sum(spark.createDataFrame(changed, RUNS), ["horse_id"], "value", "x", as_of).orderBy("race_id", "post_no")
        assert [r.x for r in again.collect()] == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], RUNS)
    assert past.past_std(empty, ["horse_id"], F.col("value"), "x").count() == 0
    assert past.standardized(empty, ["horse_id"], F.col("value"), "x").count() == 0
    assert market.auc(empty.withColumn("y", F.lit(1)), "value", "y").first()["auc"] is None


def test_fold_deletes_and_replaces(spark):
    rows = [(1, "2", 1, 1), (1, "0", 2, 2), (1, "1", 3, 3), (2, "3", 1, 1), (2, "1", 2, 2), (3, "0", 1, 1), (4, "x", 1, 1)]
    df = spark.createDataFrame(rows, "k long, state string, made long, seq long")
    got = records.fold_versions(df, ["k"], {"1": 1, "2": 2, "3": 3}).orderBy("k").collect()
    assert [(r.k, r.state) for r in got] == [(1, "1"), (2, "3")]


def test_upsert_with_nulls(spark):
    old = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, v double")
    new = spark.createDataFrame([(2, None), (3, 4.0), (4, 5.0)], "k long, v double")
    got = {r.k: (r.v, r.change) for r in records.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {1: (1.0, "missing"), 2: (None, "same"), 3: (4.0, "updated"), 4: (5.0, "new")}


def test_tensor_adds_up(spark):
    df = spark.createDataFrame([(1, i, 0.25) for i in range(1, 5)] + [(2, 1, 1.0)], "race_id long, post_no long, p double")
    got = market.finish_tensor(df, "p", 0.8, 0.6).groupBy("race_id").agg(F.sum("prob").alias("s"), F.count("*").alias("n")).collect()
    assert [(r.race_id, round(r.s, 9), r.n) for r in got] == [(1, 1.0, 24)]


def test_asof_takes_the_last_known(spark):
    facts = spark.createDataFrame([(1, 5), (1, 1), (None, 3)], "k long, at long")
    other = spark.createDataFrame([(1, 2, 10.0), (1, 5, None), (1, 6, 30.0)], "k long, t long, v double")
    got = {(r.k, r.at): r.last_v for r in asof.latest_before(facts, "k", "at", other, "t", "v").collect()}
    assert got == {(1, 5): 10.0, (1, 1): None, (None, 3): None}


def test_stakes_and_bands(spark):
    r = spark.range(1).select(bets.stake_to_reach(F.lit(10.0), 50_000).alias("s"), bets.kelly(F.lit(0.5), F.lit(1.0), 0.2).alias("k"), bets.band(F.lit(3.0), [2, 3, 5]).alias("b")).first()
    assert (r.s, r.k, r.b) == (5000, 0.0, 2)


def test_deviation_of_large_values(spark):
    rows = [(1, d, d * 10 + i, i, 1e8 + (d + i) % 3) for d in range(20) for i in range(3)] + [(2, d, 900 + d, 1, float(d % 2)) for d in range(5)]
    df = spark.createDataFrame(rows, "k long, day long, race_id long, post_no long, v double")
    for as_of in ("day", "row", "race"):
        got = past.past_std(df, ["k"], F.col("v"), "s", 2, as_of).collect()
        for r in got:
            before = {"day": lambda x, r=r: x[1] < r["day"], "row": lambda x, r=r: (x[1], x[2], x[3]) < (r["day"], r["race_id"], r["post_no"]), "race": lambda x, r=r: (x[1], x[2]) < (r["day"], r["race_id"])}[as_of]
            values = [x[4] for x in rows if x[0] == r["k"] and before(x)]
            want = float(np.std(values)) if len(values) >= 2 else None
            assert (r["s"] is None and want is None) or abs(r["s"] - want) < 1e-7, (as_of, r, want)


def test_classes_outside_of_the_known_ones(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 3, 0), (2, 2, 1, 1, 2, 11), (3, 3, 1, 1, 1, 10), (4, 4, 1, 1, 1, None), (5, 5, 1, 1, 1, 1)], "race_id long, day long, post_no long, horse_id long, finish_rank long, level long")
    got = {r["race_id"]: (r["class_starts"], r["class_rank"]) for r in features.class_features(df).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (1, 2.0), 4: (None, None), 5: (2, 1.5)}


def test_upsert_takes_one_row_for_a_key(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7)], "k long, v string, w long")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "b", 9), (4, "n", 0)], "k long, v string, w long")
    got = {r["k"]: (r["v"], r["w"], r["change"], r["n_given"]) for r in records.upsert(old, new, ["k"], ["v", "w"], [F.col("w")], ("w",)).collect()}
    assert got == {1: ("y", 5, "updated", 2), 2: ("b", 9, "updated", 1), 3: ("c", 7, "missing", None), 4: ("n", 0, "new", 1)}


def test_last_rows_stay_in_the_table_of_days(spark):
    """The mean of the last rows is made before the days meet the rows, so no array of them is dealt out."""
    df = spark.createDataFrame([(r, 1, r // 2, 1 + r % 2, float(r)) for r in range(40)], "race_id long, post_no long, day long, horse_id long, v double")
    found = past.past_window_mean(df, ["horse_id"], F.col("v"), "x", 3, "day")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("aggregate(")
    for r in found.collect():
        earlier = [v for v in range(r["race_id"] % 2, 40, 2) if v // 2 < r["day"]][-3:]
        assert r["x"] == (sum(earlier) / len(earlier) if earlier else None)


def test_ordered_finishes_by_race(spark):
    """Pairs, trios and the likeliest triples made of a race's row are those of its rows of triples, which are not sorted."""
    rng = np.random.default_rng(8)
    rows = [(race, i + 1, float(v), i + 1) for race, n in enumerate((4, 7, 12, 2)) for i, v in enumerate(rng.dirichlet(np.full(n, 1.5)) + 1e-3)]
    df = spark.createDataFrame(rows, "race_id long, post_no long, p double, finish_rank long")
    races, tensor = market.strengths(df), market.finish_tensor(df)
    close = lambda x: {tuple(r)[:-1]: round(r[-1], 9) for r in x.collect()}
    for kind in ("exacta", "quinella"):
        assert close(market.pairs(races, kind)) == close(market.combinations(tensor, kind))
    assert close(market.trios(races)) == close(market.combinations(tensor, "trio"))
    hot = betting.hot_likeliest(market.triples(races), 5, 20_000).select("race_id", "place", "i", "j", "k", "estimated")
    assert close(hot) == close(betting.hot_top(tensor, 5, 20_000).select("race_id", "place", "i", "j", "k", "estimated")) and hot.count() == 15
    assert "Sort " not in hot._jdf.queryExecution().executedPlan().toString()
    won = market.ordered(market.winners(df, a=1, b=2, c=3)).where("race_id = 2 and i = a and j = b and k = c").collect()
    assert [(r["i"], r["j"], r["k"]) for r in won] == [(1, 2, 3)]


def test_equal_values_go_by_post(spark):
    """By the market's shares all runners of a race have one value, whatever its last bit says."""
    odds = [3.1, 1.7, 2.9, 5.3, 4.1, 1.3, 2.3]
    df = spark.createDataFrame([(r, k + 1, odds[(k + r) % 7]) for r in range(40) for k in range(7)], "race_id long, post_no long, win_odds double")
    got = bets.expected_value(market.market_probability(df), "p", 0.1, 2).collect()
    assert len(got) == 80 and all(r["pick"] == r["post_no"] for r in got)


def test_paid_sum_is_exact(spark):
    """The sum of payouts does not depend on the order of adding."""
    df = spark.createDataFrame([(k, 5, 0.1 if k % 2 else 1e10, 1, 1, 1) for k in range(2000)], "race_id long, field long, payout double, r1 long, r2 long, r3 long").coalesce(1)
    assert bets.simulate(df.withColumn("g", F.lit(1)), 2, 3, 4, ["g"], 1.0).first()["paid"] == 10_000_000_000_100.0


def test_success_meets_bets_by_race(spark):
    """A race's bets are one row, so its triples are not sorted for a join; equal bets add up."""
    df = spark.createDataFrame([(r, k + 1, (k + 1) / 10) for r in (1, 2) for k in range(4)], "race_id long, post_no long, p double")
    bet = spark.createDataFrame([(1, "exacta", 1, 2, None, 60.0), (1, "trifecta", 1, 2, 3, 50.0), (1, "trifecta", 4, 3, 2, 50.0), (1, "trifecta", 4, 3, 2, 50.0)], "race_id long, kind string, a long, b long, c long, pay double")
    tensor = market.finish_tensor(df)
    found = betting.success(tensor, bet, 100)
    want = tensor.where("race_id = 1 and ((i = 1 and j = 2 and k = 3) or (i = 4 and j = 3 and k = 2))").agg(F.sum("prob")).first()[0]
    assert {r["race_id"]: round(r["success"], 12) for r in found.collect()} == {1: round(want, 12), 2: 0.0}
    assert "Sort " not in found._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
