"""Hypotheses, the grid and boxes on small cases, against slow versions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from furlong.operators import hypotheses, settling


def test_segments_without_races_on_a_side(spark):
    df = spark.createDataFrame([(1, True, 1), (1, True, 0), (2, False, 1), (3, None, 1), (4, True, 0), (4, False, 0)], "fold long, g boolean, h long")
    got = {r["fold"]: (r["n_in"], r["n_out"], r["rate_in"], r["rate_out"], r["better"]) for r in hypotheses.segment_by_fold(df, "fold", F.col("g"), F.col("h")).collect()}
    assert got == {1: (2, 0, 0.5, None, True), 2: (0, 1, None, 1.0, False), 4: (1, 1, 0.0, 0.0, False)}
    test = hypotheses.segment_test(hypotheses.segment_by_fold(df, "fold", F.col("g"), F.col("h"))).first()
    assert (test["folds"], test["better"], test["n_in"], test["hits_in"], test["n_out"], test["hits_out"]) == (3, 1, 3, 1, 2, 1)


def test_best_plans_break_ties_by_order(spark):
    df = spark.createDataFrame([(0, 1, 1, 0), (0, 0, 0, 0), (1, 0, 1, 1)], "fold long, a long, b long, c long")
    by = hypotheses.plans_by_fold(df, "fold", {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")})
    assert sorted(map(tuple, hypotheses.best_plans(by, "fold").collect())) == [(0, "a", "a"), (1, "b", "b")]


def test_a_plan_replaces_the_base_only_where_its_bound_is_above_nought(spark):
    rng = np.random.default_rng(1)
    rows = []
    for race in range(300):
        base, lucky = rng.random() < 0.3, rng.random() < 0.32
        rows += [(race, "base", int(base)), (race, "same", int(lucky)), (race, "good", int(base or rng.random() < 0.3)), (race, "better", int(base or rng.random() < 0.5))]
    rows += [(9999, "good", 1)]
    got = {r["plan"]: r for r in hypotheses.replacement(spark.createDataFrame(rows, "race_id long, plan string, hit long"), "base").collect()}
    assert set(got) == {"same", "good", "better"} and all(r["n"] == 300 for r in got.values())
    assert [got[p]["passes"] for p in ("same", "good", "better")] == [False, True, True] and [p for p in got if got[p]["chosen"]] == ["better"]
    only = hypotheses.replacement(spark.createDataFrame([r for r in rows if r[1] in ("base", "same")], "race_id long, plan string, hit long"), "base").collect()
    assert [r["chosen"] for r in only] == [False]


def test_grid_against_a_slow_one(spark):
    rng = np.random.default_rng(2)
    rows = []
    for race in range(60):
        n = int(rng.integers(2, 9))
        order = rng.permutation(n) + 1
        for i in range(n):
            rows.append((race, i + 1, int(order[i]), float(1000 * (race % 9)), round(float(rng.random()), 2), None if race % 5 == 0 and i == 0 else round(float(rng.random()), 2)))
    df = spark.createDataFrame(rows, "race_id long, post_no long, finish_rank long, payout double, a double, b double")
    plans = {"box": (4, 4, 4), "thin": (1, 2, 3)}
    got = {(r["source"], r["plan"]): (r["races"], r["hits"], r["hot"], r["stake"], r["paid"]) for r in settling.evaluate_grid(df, ["a", "b"], plans, 4000).collect()}
    want = {}
    for (s, col), (name, (x, y, z)) in itertools.product((("a", 4), ("b", 5)), plans.items()):
        told = [0, 0, 0, 0, 0.0]
        for race in range(60):
            field = [r for r in rows if r[0] == race]
            if len(field) < 3 or any(r[col] is None for r in field):
                continue
            ranked = sorted(field, key=lambda r: (-r[col], r[1]))
            place = {r[2]: k + 1 for k, r in enumerate(ranked)}
            hit = place[1] <= x and place[2] <= y and place[3] <= z
            n = len(field)
            told[0] += 1
            told[1] += hit
            told[2] += hit and field[0][3] >= 4000
            told[3] += 100 * min(x, n) * (min(y, n) - 1) * (min(z, n) - 2)
            told[4] += field[0][3] if hit else 0
        want[s, name] = tuple(told)
    assert got == want


def test_boxes_wait_refund_and_tie(spark):
    predicted = spark.createDataFrame([(r, p, p) for r in (1, 2, 3, 4, 5, 6) for p in range(1, 8)], "race_id long, post_no long, model_rank long")
    # race 1 dead heat; 2 no results yet; 3 cancelled; 4 without payouts; 5 one refunded, one gone; 6 too few left
    gone = {5: {4}, 6: {1, 2}}
    results = spark.createDataFrame([(r, p, "1" if (r, p) in ((5, 1), (6, 3)) else "0") for r in (1, 4, 5, 6) for p in range(1, 8) if p not in gone.get(r, ())], "race_id long, post_no long, state string")
    combo = "race_id long, combos array<struct<a:long,b:long,c:long,pay:double>>"
    payouts = spark.createDataFrame([(1, [(1, 2, 3, 40000.0), (2, 1, 3, 30000.0), (1, 2, 7, 5.0)]), (5, [(1, 2, 3, 9000.0)]), (6, [(4, 3, 2, 1.0)]), (4, [])], combo)
    races = spark.createDataFrame([(r, r == 3) for r in range(1, 7)], "race_id long, cancelled boolean")
    got = {r["race_id"]: tuple(r)[1:] for r in settling.reconcile(predicted, results, payouts, races, 4).collect()}
    assert got[1] == ("checked", 4, 0, 0, 2400, True, 70000.0, True, 67600.0)
    assert got[2][:4] == ("pending", 0, 0, 4) and got[2][4:] == (None,) * 5 and got[3][0] == "cancelled" and got[4][0] == "no payout"
    assert got[5] == ("checked", 2, 1, 1, 0, False, 0.0, False, 0.0)
    assert got[6] == ("checked", 1, 1, 2, 0, False, 0.0, False, 0.0)
