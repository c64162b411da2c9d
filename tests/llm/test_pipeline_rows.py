"""Stages of the pipeline on rows whose doc_id is null or repeated."""

import corpus_pipeline as pipeline
from conftest import EDGE, WORDS, make

from furlong.llm import decontaminate

OTHER = " ".join(f"u{i}" for i in range(60))
THIRD = " ".join(f"t{i}" for i in range(60))


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_one_row_of_each_class_stays(spark):
    near = THIRD.replace("t30", "other")
    more = [(None, WORDS), (None, OTHER), (None, THIRD), (None, near), (20, WORDS.replace("w30", "else")), (20, THIRD + " " + OTHER)]
    docs = make(spark, [*EDGE, *more])
    got = pipeline.keep_one_of_each_class(spark, docs, "")
    assert got.columns == docs.columns
    left = rows_of(got)
    assert [t for i, t in left if i is None and t in (THIRD, near)] in ([THIRD], [near])
    gone = {(7, EDGE[9][1]), (None, WORDS), more[4], more[2], more[3]}
    assert set(left) - {more[2], more[3]} == {*EDGE, *more} - gone - {(None, EDGE[7][1])}
    assert len(left) == len(set(left))


def test_rows_are_cleaned_one_by_one(spark):
    items = spark.createDataFrame([(1, WORDS), (2, OTHER)], "item_id long, text string")
    half = OTHER.split()
    rows = [(None, "a " + WORDS), (None, THIRD), (None, " ".join(half[:32])), (None, " ".join(half[28:])), (1, WORDS), (1, THIRD)]
    got = rows_of(decontaminate.clean(make(spark, rows), items))
    assert got == sorted([rows[1], rows[2], rows[3], rows[5]], key=str)


def test_cuts_keep_what_is_the_texts_own(spark):
    from conftest import PASSAGE

    long = "é" * 40 + " and so on to more than fifty bytes of text"
    rows = [(1, long), (2, "own � mark " + PASSAGE), (3, PASSAGE + "tail � of é"), (4, "x" + long[:30] + "y"), (5, "a" + long), (None, PASSAGE), (6, None), (7, "")]
    docs = make(spark, rows).withColumnRenamed("h", "kept").withColumnRenamed("bucket", "n_removed")
    got = pipeline.cut_repeats(spark, docs, "")
    assert got.columns == docs.columns
    # the document without an id is last and nothing of it is left
    assert rows_of(got) == sorted([rows[0], rows[1], (3, "tail � of é"), (4, "xy"), (5, "a"), rows[6], rows[7]], key=str)
    assert {r.n_chars for r in got.where("doc_id = 3").collect()} == {11}
    assert pipeline.cut_repeats(spark, docs.limit(0), "").count() == 0


def test_stages_take_clashing_columns(spark):
    from furlong.llm import toxicity

    docs = make(spark, EDGE).withColumnRenamed("h", "score").withColumnRenamed("row", "of")
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 1), (5, 0), (6, 0)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    kept = toxicity.reject(spark, docs, labels, F.lit(True), toxicity.Config(steps=5, epochs=1, nets=2))
    assert kept.columns == docs.columns and kept.count() <= len(EDGE)
    items = spark.createDataFrame([(1, WORDS)], "item_id long, text string")
    assert decontaminate.clean(docs, items).columns == docs.columns
    one = pipeline.keep_one_of_each_class(spark, docs, "")
    assert one.columns == docs.columns and pipeline.keep_one_of_each_class(spark, docs.limit(0), "").count() == 0
