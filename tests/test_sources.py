"""Record decoder, versioned stores and text tables against slow readers and broken inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.sources import records, stores, texts


def encoded(rng, code):
    """A record by the layout, and what a reader must find in it."""
    x = records.ODDS_LAYOUTS[code]
    combo, odds, rank = x.group
    head = f"{code}{rng.integers(1, 6)}2024{rng.integers(1000, 1300):04d}20240{rng.integers(101, 999)}0501{rng.integers(10, 99)}{rng.integers(1, 13):02d}".ljust(27) + ("01021530" if rng.random() < 0.5 else " " * 8)
    body, want = [], []
    for _ in range(x.count):
        c = int(rng.integers(1, 10**combo.width)) if rng.random() > 0.2 else 0
        o = str(rng.choice(["-" * odds.width, "*" * odds.width, " " * odds.width, "0" * odds.width, f"{rng.integers(1, 10**odds.width):0{odds.width}d}", "1 2".ljust(odds.width)]))
        r = f"{rng.integers(0, 10**rank.width):0{rank.width}d}" if rng.random() > 0.1 else " " * rank.width
        group = list(" " * x.size)
        for f, v in ((combo, f"{c:0{combo.width}d}" if c else " " * combo.width), (odds, o), (rank, r)):
            group[f.at - 1 : f.at - 1 + f.width] = v
        body.append("".join(group))
        if c:
            want.append((c, int(o) if o.isdigit() and int(o) else None, int(r) if r.isdigit() and int(r) else None))
    return (head.ljust(x.at - 1) + "".join(body)).ljust(x.length).encode(), head, want


@pytest.mark.parametrize("codes", [["O1", "O2"], ["O3", "O4"], ["O5", "O6"]])
def test_records_round_trip(spark, codes):
    rng = np.random.default_rng(4)
    made = [encoded(rng, code) for code in codes for _ in range(6)]
    df = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(made)], "i long, raw binary")
    got = {r["i"]: r for r in records.decode(df).collect()}
    for i, (_, head, want) in enumerate(made):
        r = got[i]
        assert (r["bad"], r["record_type"], r["state"], r["date"]) == (None, head[:2], head[2], head[11:19])
        assert r["race"] == head[11:15] + head[19:27] and r["announced"] == head[27:35].strip() and r["made"] == int(head[3:11])
        assert [tuple(g) for g in r["groups"]] == want
    assert records.odds_rows(records.decode(df)).count() == sum(len(w) for _, _, w in made)


def test_broken_records_say_why(spark):
    good = encoded(np.random.default_rng(1), "O1")[0]
    rows = [(1, good), (2, good[:266]), (3, b"XX" + good[2:]), (4, None), (5, b""), (6, b"\xff" * 962), (7, good[:50] + b"\xff\xfe" + good[52:]), (8, good[:3] + b"2024x101" + good[11:])]
    got = {r["i"]: (r["bad"], r["groups"] is not None, r["made"]) for r in records.decode(spark.createDataFrame(rows, "i long, raw binary")).collect()}
    assert [got[i][0] for i in range(1, 9)] == [None, "too short", "unknown type", "no record", "unknown type", "unknown type", None, None]
    assert [got[i][1] for i in range(1, 9)] == [True, False, False, False, False, False, True, True] and got[8][2] == 0
    assert records.decode(spark.createDataFrame([], "i long, raw binary")).count() == 0


SCHEMA = "kind string, day long, v long"


def rows_of(spark, path, by=("kind", "day")):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted(tuple(r) for r in stores.read(spark, path, schema, list(by)).select("kind", "day", "v").collect())


def test_versions_are_seen_whole(spark, tmp_path):
    path, by = str(tmp_path / "store"), ["kind", "day"]
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert rows_of(spark, path) == []
    stores.write(make(("a", 1, 10), ("a", 2, 20), ("b", 1, 30)), path, "v1", by)
    assert rows_of(spark, path) == [("a", 1, 10), ("a", 2, 20), ("b", 1, 30)]
    # a write that is killed has files and no line in the manifest
    make(("a", 1, 99), ("c", 1, 99)).write.partitionBy(*by).parquet(f"{path}/data/v2")
    assert rows_of(spark, path) == [("a", 1, 10), ("a", 2, 20), ("b", 1, 30)]
    # run again it replaces what it left, and only the partitions that it has
    stores.write(make(("a", 1, 11), ("a", 1, 12)), path, "v2", by)
    want = [("a", 1, 11), ("a", 1, 12), ("a", 2, 20), ("b", 1, 30)]
    assert rows_of(spark, path) == want
    stores.write(make(("a", 1, 11), ("a", 1, 12)), path, "v2", by)
    assert rows_of(spark, path) == want
    # an older write that is run again does not come back
    stores.write(make(("a", 1, 10), ("a", 2, 20), ("b", 1, 30)), path, "v1", by)
    assert rows_of(spark, path) == want
    told = {(r["kind"], r["day"]): (r["version"], r["n_rows"], r["files"], r["bytes"] > 0) for r in stores.summary(spark, path, make().schema, by).collect()}
    assert told == {("a", 1): ("v2", 2, 1, True), ("a", 2): ("v1", 1, 1, True), ("b", 1): ("v1", 1, 1, True)}
    for bad in ("", "../x", "a b"):
        with pytest.raises(ValueError):
            stores.write(make(("a", 1, 1)), path, bad, by)
    with pytest.raises(ValueError):
        stores.write(make((None, 1, 1)), path, "v3", by)


def test_text_tables(spark, tmp_path):
    one = tmp_path / "results.csv"
    one.write_bytes("﻿grade, post_no ,race_id,race_date,win_odds,extra,finish_rank\r\n".encode() + '"A, ""x""",1,7,2024-01-02,3.5,q,1.0\r\n B ,2, 7 ,2024-01-02,,q,1.5\r\n,x,8,2024-13-45,abc,q,\r\n,3,,2024-01-02,1,q,2\r\n'.encode())
    got = [tuple(r)[:3] + tuple(r)[3:] for r in texts.results(spark, str(one)).collect()]
    assert json.loads(json.dumps(got, default=str)) == [[7, "2024-01-02", 1, None, 1, 3.5, 'A, "x"'], [7, "2024-01-02", 2, None, None, None, "B"]]
    with pytest.raises(FileNotFoundError):
        texts.results(spark, str(tmp_path / "none.csv"))
    assert texts.results(spark, str(tmp_path / "none.csv"), optional=True).count() == 0
    two = tmp_path / "two.csv"
    two.write_text("race_id,post_no\n1,2\n")
    with pytest.raises(ValueError):
        texts.results(spark, str(two))
    three = tmp_path / "three.csv"
    three.write_text("race_id,post_no,p,made\n1,1,0.5,2024-01-01 10:00:00\n1,1,0.7,2024-01-01 11:00:00\n1,1,0.9,\n2,1,x,bad\n")
    assert sorted((r["race_id"], r["p"]) for r in texts.predictions(spark, str(three)).collect()) == [(1, 0.7), (2, None)]
    assert texts.predictions(spark, str(tmp_path / "no.csv")).count() == 0
    four = tmp_path / "four.csv"
    four.write_text('race_id,post_no,grade,race_date\n1,1,"two\nlines",2024-01-01\n')
    assert [r["grade"] for r in texts.read_csv(spark, str(four), texts.RESULTS, line_breaks=True).select(F.col("grade")).collect()] == ["two\nlines"]
    japanese = tmp_path / "five.csv"
    japanese.write_bytes("race_id,post_no,race_date,grade\n1,1,2024-01-01,重賞\n".encode("shift_jis"))
    with pytest.raises(Exception):  # noqa: B017
        texts.read_csv(spark, str(japanese), texts.RESULTS, encoding="no-such").collect()


def test_a_record_is_made_a_few_times_only(spark):
    """The bytes are an expression here: no step below the rows of odds names it more than a few times."""
    made = spark.range(40).select("id", F.concat(F.lit("O1220240101"), F.rpad(F.upper(F.lpad(F.col("id").cast("string"), 4, "0")), 951, "0")).cast("binary").alias("raw"))
    plan = records.odds_rows(records.decode(made))._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("rpad(") for line in plan.split("\n")) <= 2
