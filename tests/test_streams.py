"""Streams against their finished tables: arrival in any order, restarts from the checkpoint, late rows, failed snapshots."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.streaming import intervals, sinks, stages

T0 = datetime.datetime(2024, 1, 1)
SNAP = "race_id long, start timestamp, at timestamp, ref long, value double, ok boolean"


def at(minutes):
    return T0 + datetime.timedelta(minutes=float(minutes))


def shots(seed, races, lo, hi, first_ref):
    """Snapshots between minutes lo and hi, of races that start every 15 minutes; some failed, some after the start."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, minute in enumerate(sorted(rng.uniform(lo, hi, 120))):
        race = int(rng.integers(races))
        start = 60 + 15 * race
        if minute < start + 5:
            rows.append((race, at(start), at(round(minute, 3)), first_ref + k, round(float(rng.normal()), 6), bool(rng.random() > 0.25)))
    return rows


@pytest.mark.parametrize("order", [1, -1])
def test_stages_over_restarts(spark, tmp_path, order):
    batches = [shots(i, 20, 40 * i, 40 * i + 45, 1000 * i) for i in range(8)]
    batches.append([(30, at(100_000), at(900), 9999, 0.0, True)])  # moves the watermark past all starts
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = []
    for b in batches:
        # within a batch rows come forwards or backwards; they overlap the batch before by five minutes
        spark.createDataFrame(b[::order], SNAP).coalesce(1).write.mode("append").parquet(folder)
        rows += b
        stream = sinks.read_stream(spark, folder, SNAP)
        done = stages.run_stages(stream, path, state)
    want = stages.stages_batch(spark.createDataFrame(rows, SNAP).where("race_id < 30"))
    got = sorted(map(tuple, done.rows.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 40
    assert {r[2] for r in got} == {"provisional", "final", "latest"}
    # what is final stays: a late snapshot, however early its time, is dropped and counted
    spark.createDataFrame([(3, at(105), at(90.5), -1, 5.0, True)], SNAP).coalesce(1).write.mode("append").parquet(folder)
    again = stages.run_stages(sinks.read_stream(spark, folder, SNAP), path, state)
    assert again.late == 1 and sorted(map(tuple, again.rows.collect())) == got


def test_stages_leave_out_failures_and_rows_without_a_race(spark, tmp_path):
    rows = [(1, at(100), at(30), 1, 1.0, True), (1, at(100), at(45), 2, 2.0, False), (1, at(100), at(90), 3, 3.0, None), (None, at(100), at(85), 4, 4.0, True), (2, at(100), at(85), 5, 5.0, True), (2, at(100), at(84), 6, 6.0, True), (2, at(100), at(101), 7, 7.0, True), (9, at(500), at(400), 8, 0.0, True)]
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows, SNAP).write.parquet(folder)
    got = sorted((r["race_id"], r["stage"], r["ref"]) for r in stages.run_stages(sinks.read_stream(spark, folder, SNAP), path, state).rows.collect())
    assert got == [(1, "latest", 1), (2, "final", 6), (2, "latest", 6), (2, "provisional", 6)]


def test_results_join_once_and_late_ones_are_counted(spark, tmp_path):
    left, right = "tick long, k long, at timestamp", "k long, right_at timestamp, n long"
    rng = np.random.default_rng(1)
    ticks = [(i, int(rng.integers(4)), at(round(float(m), 3))) for i, m in enumerate(rng.uniform(0, 600, 200))] + [(1000, None, at(10)), (1001, 1, None)]
    results = [(int(rng.integers(4)), at(15 * int(m)), 1) for m in rng.integers(0, 40, 60)]
    folders = [str(tmp_path / n) for n in ("ticks", "results")]

    def run():
        t, r = (sinks.read_stream(spark, f, s) for f, s in zip(folders, (left, right), strict=True))
        return intervals.run_join(intervals.usable_results(t, r, "k", "60 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))

    for lo, hi in ((0, 200), (180, 400), (380, 601)):
        # each run sees the next stretch; the stretches overlap, and results are delivered again with it
        mine = [x for x in ticks if x[2] is None or lo <= (x[2] - T0).total_seconds() / 60 < hi and (hi == 601 or (x[2] - T0).total_seconds() / 60 < hi - 20)]
        mine = [x for x in mine if not any(x[0] == y for y in getattr(run, "seen", []))]
        run.seen = [*getattr(run, "seen", []), *(x[0] for x in mine)]
        spark.createDataFrame(mine, left).coalesce(1).write.mode("append").parquet(folders[0])
        spark.createDataFrame([x for x in results if lo <= (x[1] - T0).total_seconds() / 60 < hi], right).coalesce(1).write.mode("append").parquet(folders[1])
        done = run()
    pairs = {(t, k, a, b) for t, k, a in ticks if a for kk, b, _ in results if k == kk and datetime.timedelta(minutes=40) <= a - b <= datetime.timedelta(hours=12)}
    got = [(r["tick"], r["k"], r["at"], r["right_at"]) for r in done.rows.collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 100
    spark.createDataFrame([(2, at(30), 1)], right).coalesce(1).write.mode("append").parquet(folders[1])
    late = run()
    assert late.late >= 1 and late.rows.count() == len(pairs)


def test_old_odds_are_not_used(spark, tmp_path):
    left, right = "tick long, k long, at timestamp", "k long, odds long, right_at timestamp"
    for name, rows, schema in (("t", [(1, 1, at(60)), (2, 2, at(60)), (3, 1, at(2000))], left), ("o", [(1, 7, at(45)), (1, 8, at(50)), (2, 9, at(44.9)), (2, 10, at(60.1)), (5, 0, at(2000))], right)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    t, o = sinks.read_stream(spark, str(tmp_path / "t"), left), sinks.read_stream(spark, str(tmp_path / "o"), right)
    done = intervals.run_join(intervals.usable_odds(t, o, "k", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["tick"], r["odds"]) for r in done.rows.where(F.col("tick") < 3).collect() if r["odds"] is not None) + [r["tick"] for r in done.rows.where("odds is null").collect()]
    assert got == [(1, 7), (1, 8), 2]
