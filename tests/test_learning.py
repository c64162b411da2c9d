"""Kept state, walk-forward fits, stage fits, formation cards and the search for rules, against slow versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.operators import daystate, features, formation, market, past, rules, stagefits, training
from furlong.sources.views import runs

SF = "/root/testdata/sf0.001"


def spec(buckets=16):
    return daystate.Spec(("horse_id",), {"n": F.lit(1), "rank": F.col("finish_rank")}, ("recent", 3, F.col("finish_rank").cast("double")), buckets=buckets)


def rebuilt(df):
    out = past.past_totals(df, ["horse_id"], {"n": F.lit(1), "rank": F.col("finish_rank")}, "day", last=("recent", 3, F.col("finish_rank").cast("double")))
    return out.select("race_id", "post_no", "n", "rank", F.coalesce("recent", F.array().cast("array<double>")).alias("recent"))


def found(df):
    return sorted((r["race_id"], r["post_no"], r["n"], r["rank"], tuple(r["recent"] or ())) for r in df.collect())


def test_day_state_equals_a_rebuild(spark, tmp_path):
    r = runs(spark, SF).select("race_id", "post_no", F.when(F.col("horse_id") % 17 > 0, F.col("horse_id")).alias("horse_id"), "day", "finish_rank").cache()
    days = sorted(x["day"] for x in r.select("day").distinct().collect())[-8:]
    path = str(tmp_path / "state")
    daystate.start(r.where(F.col("day") < days[0]), spec(), path)
    want = rebuilt(r)
    for k, day in enumerate(days):
        rows = r.where(F.col("day") == day)
        got = found(daystate.advance(rows, spec(), path))
        assert got == found(want.join(rows.select("race_id", "post_no"), ["race_id", "post_no"]))
        # a day that is tried again gives the same and leaves the same state
        if k in (2, 7):
            assert found(daystate.advance(rows, spec(), path)) == got
        if k == 4:
            daystate.compact(spark, spec(), path)
    whole = {x["horse_id"]: (x["n"], x["rank"]) for x in daystate.state(spark, spec(), path).collect()}
    assert whole == {x["horse_id"]: (x["n"], x["s"]) for x in r.where("horse_id is not null").groupBy("horse_id").agg(F.count("*").alias("n"), F.sum("finish_rank").alias("s")).collect()}
    with pytest.raises(ValueError):
        daystate.advance(r.where(F.col("day") == days[3]), spec(), path)
    with pytest.raises(ValueError):
        daystate.advance(r.where(F.col("day").isin(days[6:])), spec(), path)
    assert daystate.advance(r.where("false"), spec(), path).count() == 0


def test_a_day_reads_the_buckets_of_its_entities(spark, tmp_path):
    rows = [(h * 100 + d, 1, h, d, 1) for d in range(5) for h in range(200)]
    df = spark.createDataFrame(rows, "race_id long, post_no long, horse_id long, day long, finish_rank long")
    path = str(tmp_path / "state")
    daystate.start(df, spec(), path)
    day = spark.createDataFrame([(1, 1, 7, 9, 1), (1, 2, 8, 9, 2)], df.schema)
    out = daystate.advance(day, spec(), path)
    assert [(r["n"], r["rank"]) for r in out.collect()] == [(5.0, 5.0)] * 2
    # the scan of the store has the two horses' buckets as a filter on its folders
    buckets = sorted({r[0] for r in day.select(F.pmod(F.xxhash64("horse_id"), F.lit(16))).collect()})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and f"({','.join(map(str, buckets))})" in plan.replace(" ", "")
    read = daystate.state(spark, spec(), path, 9, buckets)
    assert read.select(F.input_file_name()).distinct().count() == len(buckets) and read.count() < 60 < df.count()


def planted(spark, days=40, races=12):
    rng = np.random.default_rng(5)
    rows = []
    for race in range(days * races):
        for post in range(8):
            x = rng.normal(size=3)
            win = rng.random() < 1 / (1 + np.exp(-(1.5 * x[0] - x[1] - 1.5)))
            rows.append((race, post, race // races, float(x[0]), float(x[1]) if rng.random() > 0.05 else None, float(x[2]), int(win)))
    return spark.createDataFrame(rows, "race_id long, post_no long, day long, a double, b double, noise double, won long")


def test_walk_forward_training(spark, tmp_path):
    df, root = planted(spark).cache(), str(tmp_path / "models")
    folds = [training.Fold("one", 19, 20, 29), training.Fold("two", 29, 30, 39), training.Fold("none", 50, 60, 70)]
    settings = training.Settings(("a", "b", "noise"), "won", rounds=12, depth=3)
    first = training.out_of_fold(df, folds, settings, root)
    aucs = {r["fold"]: r["auc"] for r in training.fold_auc(first.rows, "won").collect()}
    assert set(aucs) == {"one", "two"} and min(aucs.values()) > 0.78 and not first.read_from_cache
    assert first.rows.count() == df.where("day >= 20").count()
    sums = [r["s"] for r in first.rows.groupBy("race_id").agg(F.sum("prob").alias("s")).collect()]
    assert np.allclose(sums, 1)
    share = {r["column"]: r["share"] for r in first.importance.where("fold = 'two'").collect()}
    assert share["a"] > share["noise"] and share["b"] > share["noise"]
    # the second run reads, another setting or other data do not
    again = training.out_of_fold(df.repartition(5), folds, settings, root)
    assert again.read_from_cache and sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, first.rows.collect()))
    other = training.Settings(("a", "b"), "won", rounds=2, depth=2)
    assert training.cache_key(df, folds, other) != training.cache_key(df, folds, settings) != training.cache_key(df.where("race_id <> 3"), folds, settings)
    model = training.latest_model(spark, root)
    scored = training.score(df.where("day >= 30"), model, settings).join(first.rows.where("fold = 'two'").select("race_id", "post_no", F.col("score").alias("s")), ["race_id", "post_no"])
    assert scored.count() == df.where("day >= 30").count() and scored.where("abs(score - s) > 1e-12").count() == 0
    with pytest.raises(ValueError):
        training.out_of_fold(df, [training.Fold("leak", 20, 20, 29)], settings, root)


def drawn(spark, seed, folds=4, races=400, change=None):
    """Races whose first place follows p, the second p ** 0.7 * exp(0.8 x), the third p ** 0.4 * exp(-0.5 x)."""
    rng, apart = np.random.default_rng(seed), np.random.default_rng(99)
    rows = []
    for race in range(folds * races):
        n = int(rng.integers(6, 12))
        p = rng.dirichlet(np.full(n, 1.5))
        x = rng.normal(size=n)
        left, order = list(range(n)), []
        for power, lean in ((1, 0), (0.7, 0.8), (0.4, -0.5)):
            w = np.array([p[i] ** power * np.exp(lean * x[i]) for i in left])
            order.append(left.pop(int(rng.choice(len(left), p=w / w.sum()))))
        if change is not None and race % folds >= change:
            order = list(apart.permutation(n)[:3])
        for i in range(n):
            rows.append((race, i, race % folds, order.index(i) + 1 if i in order else None, float(p[i]), float(x[i]) if rng.random() > 0.01 else None))
    return spark.createDataFrame(rows, "race_id long, post_no long, fold long, finish_rank long, p double, x double")


def test_stage_fits_find_what_was_planted_and_do_not_look_ahead(spark):
    df = drawn(spark, 1).cache()
    fits = {r["fold"]: r for r in stagefits.fold_stages(df, "p", "x").collect()}
    assert sorted(fits) == [1, 2, 3] and [fits[f]["races"] for f in (1, 2, 3)] == [400, 800, 1200]
    for name, want in (("gamma", 0.7), ("phi", 0.8), ("delta", 0.4), ("psi", -0.5)):
        assert abs(fits[3][name] - want) < 0.12, (name, fits[3][name])
    grid = {r["fold"]: r for r in stagefits.fold_discounts(df, "p", [0.1, 0.3, 0.5, 0.7, 0.9]).collect()}
    assert sorted(grid) == [1, 2, 3] and grid[3]["races"] == 1200 and grid[3]["gamma"] in (0.5, 0.7) and grid[3]["delta"] in (0.3, 0.5)
    # other results from fold 2 on change the fit of fold 3 alone
    other = {r["fold"]: r for r in stagefits.fold_stages(drawn(spark, 1, change=2), "p", "x").collect()}
    assert all(abs(other[1][c] - fits[1][c]) < 1e-9 for c in ("gamma", "phi", "delta", "psi"))
    assert abs(other[3]["phi"] - fits[3]["phi"]) > 0.05
    alone = {r["fold"]: r for r in stagefits.fold_stages(df, "p").collect()}
    assert alone[3]["phi"] is None and 0.4 < alone[3]["gamma"] < 0.8
    assert stagefits.fold_stages(df.where("fold = 0"), "p").count() == 0


def slow_cards(p, prob, max_cards, points, target, size):
    posts = sorted(p, key=lambda i: (-round(p[i], 12), i))[:size]
    n = len(posts)
    cells = {(a, b, c): prob.get((posts[a - 1], posts[b - 1], posts[c - 1])) for a, b, c in itertools.product(range(1, n + 1), repeat=3) if len({a, b, c}) == 3}
    covered, out = set(), []
    for card in range(1, max_cards + 1):
        best = None
        for a, b, c in itertools.product(range(1, min(3, n) + 1), range(1, min(6, n) + 1), range(1, n + 1)):
            box = [x for x in cells if x[0] <= a and x[1] <= b and x[2] <= c]
            if not box or len(box) > points:
                continue
            gain = sum(cells[x] for x in box if x not in covered and 72.5 / cells[x] >= target)
            key = (round(gain / len(box), 15), -a, -b, -c)
            if gain > 0 and (best is None or key > best[0]):
                best = (key, len(box), gain, set(box))
        if best is None:
            break
        covered |= best[3]
        points -= best[1]
        out.append((card, *(-v for v in best[0][1:]), best[1], best[2]))
    return out


@pytest.mark.parametrize("target", [3_000, 20_000])
def test_formation_cards(spark, target):
    rng = np.random.default_rng(2)
    rows, of = [], {}
    for race, n in enumerate((3, 5, 6, 7, 8, 8, 2)):
        q = np.round(rng.dirichlet(np.full(n, 1.2)), 6) + 1e-4
        for i, v in enumerate(q):
            rows.append((race, i + 1, float(v)))
        of[race] = {i + 1: float(v) for i, v in enumerate(q)}
    df = spark.createDataFrame(rows, "race_id long, post_no long, p double")
    tensor = market.finish_tensor(df, "p", 0.8, 0.6).cache()
    prob = {}
    for r in tensor.collect():
        prob.setdefault(r["race_id"], {})[r["i"], r["j"], r["k"]] = r["prob"]
    got = {}
    for r in formation.formation_cards(tensor, df, "p", 3, 60, target, 7).orderBy("race_id", "card").collect():
        got.setdefault(r["race_id"], []).append((r["card"], r["a"], r["b"], r["c"], r["points"], r["gain"]))
    want = {race: cards for race in of if (cards := slow_cards(of[race], prob.get(race, {}), 3, 60, target, 7))}
    assert {k: [x[:5] for x in v] for k, v in got.items()} == {k: [x[:5] for x in v] for k, v in want.items()} and len(want) >= 3
    assert all(abs(a[5] - b[5]) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_two_rules(spark):
    rng = np.random.default_rng(3)
    races = [(i, float(rng.integers(20)), float(rng.normal()) if i % 9 else None, float(rng.normal()), float(rng.integers(1000)), int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(races, "race_id long, a double, b double, c double, payout double, h long")
    got = {(r["first"], r["share1"], r["second"], r["share2"]): (r["races"], r["hits"], r["hot"], r["stake"]) for r in rules.two_rules(df, {"a": True, "b": False, "c": True}, [0.75, 0.5], F.col("h") == 1, F.lit(2), 500.0, 60).collect()}
    want, at = {}, {"a": 1, "b": 2, "c": 3}
    def keep(rows, m, s, high):
        known = [r for r in rows if r[at[m]] is not None]
        if not known:
            return []
        values = [r[at[m]] if high else -r[at[m]] for r in known]
        edge = np.quantile(values, 1 - s)
        return [r for r, v in zip(known, values, strict=True) if v >= edge]
    for (m1, h1), (m2, h2) in itertools.combinations({"a": True, "b": False, "c": True}.items(), 2):
        for s1, s2 in itertools.product((0.75, 0.5), repeat=2):
            left = keep(keep(races, m1, s1, h1), m2, s2, h2)
            if len(left) >= 60:
                want[m1, s1, m2, s2] = (len(left), sum(r[5] for r in left), sum(r[5] and r[4] >= 500 for r in left), 200 * len(left))
    assert got == want and len(want) >= 10


def test_predictions_and_history_have_the_same_features(spark):
    from furlong.plans import registry  # noqa: F401
    from furlong.plans.learning import full_frame

    whole = full_frame(spark, SF).cache()
    days = sorted(r["day"] for r in whole.select("day").distinct().collect())
    target = whole.where(F.col("day") == days[-1])
    cols = ["race_id", "post_no", *features.ALL_FEATURES]
    past_path = features.all_features(whole).where(F.col("day") == days[-1]).select(*cols)
    # the results of the day are not known before it, and changing them changes nothing
    wrong = target.withColumns({"finish_rank": F.lit(1).cast("long"), "pos": F.lit(0.9)})
    got = features.prediction_features(whole.where(F.col("day") < days[-1]), wrong).select(*cols)
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(got) == rounded(past_path) and got.count() == target.count() > 0
    none = features.prediction_features(whole.where(F.col("day") < days[-1]), target.limit(0))
    assert none.count() == 0


def test_formation_cards_of_races(spark):
    """Cards by race are those by triple, and neither plan joins or sorts rows of triples."""
    rng = np.random.default_rng(5)
    rows = [(race, i + 1, float(v)) for race, n in enumerate((3, 5, 8, 12, 12, 2)) for i, v in enumerate(rng.dirichlet(np.full(n, 1.2)) + 1e-4)]
    df = spark.createDataFrame(rows, "race_id long, post_no long, p double")
    fast = formation.ordered_cards(market.strengths(df, "p", 0.8, 0.6), 3, 60, 5_000, 7)
    slow = formation.formation_cards(market.finish_tensor(df, "p", 0.8, 0.6), df, "p", 3, 60, 5_000, 7)
    got, want = ({(r["race_id"], r["card"]): r[2:6] + (round(r["gain"], 9),) for r in x.collect()} for x in (fast, slow))
    assert got == want and len(got) >= 5
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Broadcast" not in plan
