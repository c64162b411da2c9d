"""The networks are trained in a task, with the same result as in the driver."""

import os

import numpy as np
from conftest import SCHEMA
from pyspark.sql import functions as F

from furlong.llm import toxicity

CONFIG = toxicity.Config(steps=5, epochs=1, nets=2)


def test_the_driver_does_not_train(spark, monkeypatch):
    rows = [(i, f"word{i % 7} {'slur' if i % 3 == 0 else 'kind'} word{i % 5}", "en" if i % 4 else None, "s", 1, "r", "h", "b", "i") for i in range(200)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    texts, y, langs, counts = toxicity.sample(docs, labels, F.lit(True), CONFIG)
    want = toxicity.train(texts, y, langs, CONFIG, counts)
    here, train = os.getpid(), toxicity.train

    def elsewhere(*args):
        assert os.getpid() != here
        return train(*args)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    got = toxicity.fit(docs, labels, F.lit(True), CONFIG)
    # the tables are not sent
    assert got.made == []
    assert got.thresholds == want.thresholds and got.scale == want.scale and got.constant is None
    assert all(np.array_equal(a, b) for a, b in zip([*got.tables, got.out], [*want.tables, want.out], strict=True))
