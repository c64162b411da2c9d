"""Toxic words of languages that make up a small part of the sample."""

import numpy as np
import pyarrow as pa
from conftest import SCHEMA
from pyspark.sql import functions as F

from furlong.llm import toxicity


def text(rng, lang, toxic):
    words = [f"{lang}word{i}" for i in rng.integers(0, 400, 30).tolist()]
    if toxic:
        for at in rng.choice(30, 4, replace=False).tolist():
            words[at] = f"{lang}slur"
    return " ".join(words)


def test_words_of_a_small_language_are_seen():
    rng = np.random.default_rng(8)
    rows = [(lang, y, text(rng, lang, y)) for lang, y, n in (("en", 0, 1000), ("en", 1, 100), ("es", 0, 90), ("es", 1, 9)) for _ in range(n)]
    model = toxicity.train([t for _, _, t in rows], np.array([y for _, y, _ in rows], float), [x for x, _, _ in rows], toxicity.Config())
    for lang in ("en", "es"):
        for y in (0, 1):
            buf, offsets = toxicity.tb.text_bytes(pa.array([text(rng, lang, y) for _ in range(50)]))
            scores = model.score(*toxicity.bucket_ids(buf, offsets, model.config))
            assert ((scores >= model.thresholds[lang]) == y).mean() >= 0.9, (lang, y)


def test_the_sample_is_drawn_by_language(spark):
    rows = [(i, f"text {i}", "es" if i % 50 == 0 else "en", "s", 1, "r", "h", "b", "i") for i in range(4000)]
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(4000)], "doc_id long, toxic int")
    texts, y, langs, counts = toxicity.sample(spark.createDataFrame(rows, SCHEMA), labels, F.lit(True), toxicity.Config(sample_rows=200))
    assert langs.count("es") == 80 and 240 < len(texts) < 480
    assert counts == {(0, "en"): 1960, (1, "en"): 1960, (0, "es"): 40, (1, "es"): 40}
