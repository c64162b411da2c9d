"""What a task holds, and how often a step is made, as the input grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong import session
from furlong.operators import features, past, ratings, rules
from furlong.plans import registry
from furlong.sources import records
from furlong.sources.views import runs

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_record_is_made_once_for_its_fault(spark):
    raw = spark.createDataFrame([("O1" + "0" * 1000,), ("O1",), ("X9",), (None,)], "t string").groupBy("t").agg(F.max("t").alias("m")).select(F.rpad("m", 1100, "#").cast("binary").alias("raw"), F.length("m").alias("n"))
    short = raw.withColumn("raw", F.when(F.col("n") > 2, F.col("raw")).otherwise(F.substring("raw", 1, 2)))
    bad = records.decode(short).where("bad is not null").groupBy("bad").count()
    assert _plan(bad).count("rpad(") <= 6  # a filter and a column, each of which names the record up to three times
    assert {r["bad"]: r["count"] for r in bad.collect()} == {"too short": 1, "unknown type": 1, "no record": 1}


def test_rules_read_the_races_once(spark, tmp_path):
    path = str(tmp_path / "races")
    spark.range(200).selectExpr("id as race_id", "cast(id % 7 as double) a", "cast(id % 11 as double) b", "cast(id as double) payout").write.parquet(path)
    found = rules.two_rules(spark.read.parquet(path), {"a": True, "b": False}, [0.5], F.col("payout") > 0, F.lit(1), 100.0, 1)
    assert not any("/races/" in f for f in found.inputFiles()) and found.count() == 1


def test_tasks_grow_in_number(spark):
    assert [session.parts(n) for n in (0, 1, session.TASK_ROWS, session.TASK_ROWS + 1, 216 * session.TASK_ROWS)] == [1, 1, 1, 2, 216]


def test_repeated_entries_are_dealt_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    plan = _physical(registry.queries()["repeated_entries"](spark, SF))
    head = plan[: plan.index("Exchange hashpartitioning(horse_id")]
    assert "REPARTITION_BY_NUM" in plan and head.count("HashAggregate") == plan.count("HashAggregate")


def test_past_of_days_by_one_window(spark):
    rng = np.random.default_rng(5)
    rows = [(race, post, int(rng.integers(1, 9)), race // 6, post, int(rng.integers(5, 16)) * 200) for race in range(150) for post in range(1, 5)]
    df = spark.createDataFrame(rows, "race_id long, post_no long, horse_id long, day long, finish_rank long, distance long")
    sums, last = {"n": past.one(), "w": features.won(), "d": F.col("distance")}, ("l", 3, F.col("distance"))
    got = lambda x: sorted((r["race_id"], r["post_no"], r["n"], r["w"], r["d"], tuple(r["l"] or ())) for r in x.collect())
    assert got(past.own_past(df, ["horse_id"], sums, last, as_of="day")) == got(past.past_totals(df, ["horse_id"], sums, "day", last=last))
    empty = past.own_past(df.withColumn("horse_id", F.lit(None).cast("long")), ["horse_id"], sums, last, as_of="day")
    assert {(r["n"], tuple(r["l"])) for r in empty.collect()} == {(0.0, ())}


def test_form_table_joins_the_days_of_jockeys_only(spark):
    df = spark.createDataFrame([], "race_id long, post_no long, horse_id long, jockey_id long, day long, finish_rank long, win_odds double")
    assert _plan(features.form_table(df)).count("Join") <= 1


def test_faded_sums_keep_no_hashed_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 1, int(i % 2), int(i // 3), float(rng.integers(1, 9)) if i % 5 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "race_id long, post_no long, k long, day long, v double")
    found = ratings.decayed(df, ["k"], F.col("v"), "f")
    assert "Aggregate" not in _plan(found)
    for r in found.where("race_id % 97 = 0").collect():
        own = [x[4] for x in rows if x[2] == r["k"] and x[3] < r["day"] and x[4] is not None]
        weights = [ratings.DECAY ** (len(own) - 1 - j) for j in range(len(own))]
        assert r["f_n"] == len(own) and abs(r["f_weight"] - sum(weights)) < 1e-9
        assert abs(r["f_sum"] - sum(a * b for a, b in zip(own, weights, strict=True))) < 1e-8


def test_all_features_deal_the_rows_of_a_horse_once(spark, monkeypatch):
    """What goes to disk are a few exchanges of the rows, not two for each kind of entity."""
    rows = [(race, post, race // 4, (race * 3 + post) % 9, post % 4, post % 2, post, 1000 + post, "A", "F", post % 3, 2.0 + post, 3, post / 5) for race in range(40) for post in range(1, 5)]
    df = spark.createDataFrame(rows, "race_id long, post_no long, day long, horse_id long, jockey_id long, trainer_id long, finish_rank long, distance long, surface string, going string, venue long, win_odds double, level long, pos double")
    found = features.all_features(df, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6
    told = lambda x: sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in x.collect())
    want = told(found)
    assert len(want) == len(rows)
    # horses with too many rows for a task go by their days
    monkeypatch.setattr(past, "TASK_ROWS", 17)
    assert 0 < len(past.many_rows(df, "horse_id")) < 9
    assert told(features.all_features(df, 1)) == want


def test_only_what_a_fit_reads_is_stored(spark, monkeypatch):
    from furlong.plans import learning  # after the registry, which imports it

    stored = []

    def stop(_, df, name):
        stored.append(df)
        raise InterruptedError

    monkeypatch.setattr(learning, "materialize", stop)
    with pytest.raises(InterruptedError):
        learning._oof(spark, SF)
    assert len(stored[0].columns) == 14
    whole = features.form_table(runs(spark, SF)).withColumn("placed", features.placed()).select(*stored[0].columns)
    told = lambda x: sorted(map(str, x.collect()))
    assert told(whole) == told(stored[0])
