"""Small kernels and fits against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.functions import codes
from furlong.operators import betting, datasets, logit, market, stats, style


def moved(stakes, odds, target):
    """The rule one unit at a time: who lacks least is served first, by who would still pay the most with the unit it gives."""
    need = [math.ceil(round(target / (o * 100), 6)) * 100 if o else None for o in odds]
    out = list(stakes)
    for _, i in sorted((need[i] - out[i], i) for i, o in enumerate(odds) if o and o * out[i] < target - 1e-6):
        while out[i] < need[i]:
            able = [(-(odds[j] * out[j] - target), j) for j, o in enumerate(odds) if o and j != i and out[j] - 100 >= max(100, need[j])]
            if not able:
                return out
            out[min(able)[1]] -= 100
            out[i] += 100
    return out


def test_rebalance_moves_units(spark):
    rng = np.random.default_rng(1)
    races = []
    for _ in range(200):
        n = int(rng.integers(1, 9))
        odds = [None if rng.random() < 0.1 else round(float(x), 1) for x in rng.uniform(1.5, 60, n)]
        races.append(((100 * rng.integers(1, 30, n)).tolist(), odds))
    rows = [(r, b, s, o) for r, (stakes, odds) in enumerate(races) for b, (s, o) in enumerate(zip(stakes, odds, strict=True))]
    got = {}
    for r in betting.rebalance(spark.createDataFrame(rows, "race_id long, bet long, stake long, odds double"), 10_000).collect():
        got.setdefault(r["race_id"], {})[r["bet"]] = r["new_stake"]
    assert sum(a != b for s, o in races for a, b in zip(s, moved(s, o, 10_000), strict=True)) > 50
    assert {r: [v[k] for k in sorted(v)] for r, v in got.items()} == {r: moved(s, o, 10_000) for r, (s, o) in enumerate(races)}


def test_covering_takes_the_best_step():
    options = [(0, frozenset("ab"), 200), (1, frozenset("bc"), 100), (2, frozenset("d"), 100), (3, frozenset("abcd"), 900)]
    weight = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    assert betting.covering(options, weight, 400, 5) == [1, 0, 2]
    assert betting.covering(options, weight, 200, 5) == [1, 2] and betting.covering(options, weight, 400, 1) == [1]


def test_logit_recovers_its_coefficients(spark):
    rng = np.random.default_rng(2)
    rows = []
    for r in range(1500):
        x = rng.normal(size=(6, 2))
        z = x @ [1.2, -0.7] + rng.gumbel(size=6)
        rows += [(r, i, int(z[i] == z.max()) or 2, float(x[i, 0]), float(x[i, 1]), 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "race_id long, post_no long, finish_rank long, a double, b double, none double")
    fit = logit.fit(df, ["a", "b", "none"])
    assert np.allclose(fit.beta[:2], [1.2, -0.7], atol=0.15) and abs(fit.beta[2]) < 1e-9
    p = logit.probability(df, ["a", "b"], fit.beta[:2], "p").groupBy("race_id").agg(F.sum("p").alias("s")).agg(F.max(F.abs(F.col("s") - 1)).alias("e")).first().e
    assert p < 1e-9
    assert logit.fit(df.limit(0), ["a"]).beta.tolist() == [0.0]


def test_passing_orders(spark):
    texts = {"(*13,6)4,10-2,9": {13: 1, 6: 1, 4: 3, 10: 4, 2: 5, 9: 6}, "1,(2,3": {1: 1, 2: 2, 3: 2}, "(1,2(3,4)5": {3: 1, 4: 1, 5: 3}, "7,7,8": {7: 1, 8: 3}, "": {}, None: {}, "abc": {}}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r.k: {x.post_no: x.rank for x in r.o} for r in df.select("k", style.passing_order(F.col("t")).alias("o")).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 1.96, 3.5, 6.0, 9.0])
def test_normal_tail(spark, z):
    got = spark.range(1).select(stats.normal_tail(F.lit(z)).alias("p")).first().p
    assert abs(got - math.erfc(z / math.sqrt(2))) < 1e-9


def test_sign_test(spark):
    for b, c in itertools.product((0, 1, 4, 9), (0, 3, 30)):
        got = spark.range(1).select(stats.sign_test(F.lit(b), F.lit(c)).alias("p")).first().p
        m, k = b + c, min(b, c)
        assert abs(got - (1.0 if m == 0 else min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m))) < 1e-9


def test_quantiles_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 3 if k % 7 else None, float(x)) for k, x in enumerate(rng.integers(0, 12, 400))] + [(1, None), (9, 5.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r.g: (r.n, list(r.q)) for r in stats.quantiles(df, ["g"], "v", [0, 0.1, 0.5, 0.9, 1]).collect()}
    for g in {r[0] for r in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, [0, 0.1, 0.5, 0.9, 1]))
    assert stats.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_payout_column():
    names = ["race_id", "trio_odds", "trio", "trio_payout", "exacta"]
    assert datasets.payout_column(names, "trio") == "trio_payout" and datasets.payout_column(names[:3], "trio") == "trio_odds"
    assert datasets.payout_column(names, "exacta") == "exacta" and datasets.payout_column(names, "win") is None


def test_guard_and_empty_codes(spark):
    df = spark.createDataFrame([(1, None)], "k long, t string")
    with pytest.raises(ValueError):
        datasets.require_none(df, F.col("k") == 1, "k")
    assert datasets.require_none(df, F.col("k") == 2, "k") is df
    fields = [codes.to_number, codes.race_time, codes.time_difference, codes.start_minutes, codes.track_surface, codes.track_turn, codes.track_course, codes.condition_level, codes.normalized_id]
    assert all(x is None for x in df.select(*(f(F.col("t")).alias(f.__name__) for f in fields)).first())


def test_auc_with_ties(spark):
    rng = np.random.default_rng(4)
    s, y = rng.integers(0, 20, 500) / 20, rng.integers(0, 2, 500)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y long")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(market.auc(df, "s", "y").first()["auc"] - want) < 1e-12


def test_corner_ranks_stages(spark):
    """Tokens are made once for a text, not again for each token inside of the lambdas."""
    df = spark.createDataFrame([(1, "(*13,6)4,10-2", None), (2, "", "3,3,(1,2")], "race_id long, c1 string, c2 string")
    ranks = style.corner_ranks(df, "race_id", ["c1", "c2"])
    got = {(r["race_id"], r["corner"], r["post_no"]): r["rank"] for r in ranks.collect()}
    assert got == {(1, 1, 13): 1, (1, 1, 6): 1, (1, 1, 4): 3, (1, 1, 10): 4, (1, 1, 2): 5, (2, 2, 3): 1, (2, 2, 1): 3, (2, 2, 2): 3}
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
