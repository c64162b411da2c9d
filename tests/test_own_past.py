"""The past of a horse by one window is that of the table of days, and needs no join."""

import numpy as np
from pyspark.sql import functions as F

from furlong.operators import features, levels, pace, past

SHAPE = "race_id long, post_no long, horse_id long, day long, finish_rank long, distance long, surface string, going string, venue long"


def _rows(spark):
    rng = np.random.default_rng(2)
    rows = [(race, post, None if post == 4 and race % 25 == 0 else int(rng.integers(1, 9)), race // 3, post, int(rng.integers(5, 16)) * 200, "ABC"[race % 3], "F", race % 4) for race in range(150) for post in range(1, 5)]
    return spark.createDataFrame(rows, SHAPE)


def test_one_window_gives_the_same_past(spark):
    df = _rows(spark).where("horse_id is not null")
    sums, last = {"n": past.one(), "w": features.won(), "d": F.col("distance")}, ("l", 3, F.col("distance"))
    rows = lambda x: sorted((r["race_id"], r["post_no"], r["n"], r["w"], r["d"], tuple(r["l"])) for r in x.collect())
    assert rows(past.own_past(df, ["horse_id"], sums, last)) == rows(past.past_totals(df, ["horse_id"], sums, "row", last=last))


def test_unknown_horses_have_no_past(spark):
    got = past.own_past(_rows(spark), ["horse_id"], {"n": past.one()}, ("l", 3, F.col("distance"))).where("horse_id is null").collect()
    assert len(got) == 6 and all(r["n"] == 0.0 and r["l"] == [] for r in got)


def test_features_of_a_horse_need_no_join(spark):
    df = _rows(spark)
    for f in (features.horse_features, features.condition_features):
        assert "Join" not in f(df)._jdf.queryExecution().optimizedPlan().toString()


def test_a_horse_with_a_large_share_is_spread_over_its_days(spark, monkeypatch):
    df = _rows(spark).withColumns({"level": F.col("race_id") % 7, "rel": F.col("finish_rank") / 10, "win_odds": F.lit(2.0), "jockey_id": F.col("venue"), "grade": F.lit("1")})
    shares = {r["horse_id"]: r["count"] for r in df.groupBy("horse_id").count().collect()}
    found = {
        "horse": lambda: features.horse_features(df),
        "condition": lambda: features.condition_features(df),
        "level": lambda: levels.level_features(df, "level", "rel"),
        "time": lambda: levels.time_index(df, ["surface"], F.col("distance") / 16 + F.col("post_no"), 5),
        "pace": lambda: pace.pace_features(df.withColumn("z", F.col("rel") - 0.4), "z"),
        "form": lambda: features.form_table(df),
    }
    told = lambda x: sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r.asDict(True).values()]) for r in x.select("race_id", "post_no", *sorted(set(x.columns) - {"race_id", "post_no"})).collect())
    want = {name: told(f()) for name, f in found.items()}
    # half of the horses have too many rows for a task
    monkeypatch.setattr(past, "TASK_ROWS", sorted(n for h, n in shares.items() if h)[4])
    assert 0 < len(past.many_rows(df, "horse_id")) < 8
    for name, f in found.items():
        x = f()
        assert told(x) == want[name], name
        assert "Join" in x._jdf.queryExecution().optimizedPlan().toString(), name
