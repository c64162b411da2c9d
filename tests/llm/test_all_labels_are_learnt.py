"""All labelled documents are learnt from, whatever their number and length, and thresholds follow all of them."""

from dataclasses import replace

import numpy as np
from conftest import SCHEMA
from pyspark.sql import functions as F

from furlong.llm import toxicity

SMALL = toxicity.Config(buckets=1 << 10, sample_rows=40, nets=2, steps=30, epochs=1)


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 1, "r", "h", "b", "i") for i, t in enumerate(texts)], SCHEMA)


def score_of(spark, model, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    return [r["score"] for r in toxicity.score(rows, model).orderBy("doc_id").collect()]


def test_words_that_the_sample_has_not(spark):
    rng = np.random.default_rng(3)
    plain = lambda: " ".join(f"word{k}" for k in rng.integers(0, 30, 12).tolist())
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "doc_id long, toxic int")
    bare = frame(spark, ["x"] * 2000)
    drawn = {r["doc_id"] for r in toxicity.drawn(bare, labels, F.lit(True), SMALL)[0].select("doc_id").collect()}
    assert 0 < len(drawn) < 200
    texts = [plain() + ("" if i % 4 else " insult" if i in drawn else " slur") for i in range(2000)]
    # many passes, as the rows of a task are few
    model = toxicity.fit(frame(spark, texts), labels, F.lit(True), replace(SMALL, passes=8, batch=8))
    clean, slur = score_of(spark, model, plain(), plain() + " slur")
    assert slur > clean + 0.1


def test_long_texts_are_learnt_from(spark):
    long = "slur " + "word " * 60_000
    texts = [long if i % 5 == 0 else "word other words" for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, texts), labels, F.lit(True), SMALL)
    assert model.constant is None
    clean, slur = score_of(spark, model, "word other words", "word slur other words")
    assert slur > clean


def test_pieces_of_a_text_give_the_same_windows(monkeypatch):
    rng = np.random.default_rng(1)
    config = toxicity.Config()
    x, where, begin = rng.normal(size=(50, 8)), rng.integers(0, 50, 400), np.array([0, 5, 180, 190, 397])
    whole = [toxicity.strongest(x, where, begin, rng.normal(size=(k, 8, 8)), config) for k in (1, 2, 3)]
    rng = np.random.default_rng(1)
    rng.normal(size=(50, 8)), rng.integers(0, 50, 400)
    monkeypatch.setattr(toxicity, "WORDS", 7)
    for k, (top, best) in zip((1, 2, 3), whole, strict=True):
        again = toxicity.strongest(x, where, begin, rng.normal(size=(k, 8, 8)), config)
        assert np.allclose(top, again[0]) and np.array_equal(best, again[1])


def test_a_threshold_is_the_middle_of_its_range():
    config = toxicity.Config(least=2)
    p, y, one = np.array([0.1, 0.2, 0.8, 0.9, 0.95]), np.array([0.0, 0, 1, 1, 1]), np.ones(5)
    assert abs(toxicity.threshold(p, y, one, config) - 0.5) < 1e-12
    # between scores that a grid of hundredths does not tell apart
    p = np.array([0.4001, 0.4002, 0.4003, 0.4004, 0.4005])
    assert 0.4002 < toxicity.threshold(p, y, one, config) < 0.4003
    # each score for many rows
    assert abs(toxicity.threshold(np.array([0.2, 0.8]), np.array([0.0, 1]), np.array([9.0, 3]), config, np.array([9.0, 3])) - 0.5) < 1e-12


def test_a_language_with_few_marks_takes_the_threshold_of_all():
    z, y = np.r_[np.linspace(-4, -2, 40), np.linspace(2, 4, 40)], np.r_[np.zeros(40), np.ones(40)]
    model = toxicity.settled(toxicity.Model(toxicity.Config()), z, y, ["en"] * 78 + ["es"] * 2, np.ones(80))
    assert model.thresholds["es"] == model.threshold != model.config.threshold
