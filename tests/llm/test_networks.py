"""The classifiers' scores against slow forward passes, text by text and window by window."""

import math

import numpy as np
from conftest import EDGE
from pyspark.sql import functions as F

from furlong.llm import langid, registry, toxicity
from furlong.llm import textbytes as tb

SF = "/root/testdata/sf0.001"


def _bucket(word: bytes, config):
    h = tb.span_hashes(tb.prefix_sums(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)]))
    return int(h[0] >> np.uint64(40)) % config.buckets


def test_toxicity_scores(spark, edge):
    import re

    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    config = toxicity.Config(steps=40, epochs=1, nets=2)
    model = toxicity.fit(docs, labels, registry.remainder(4) != 2, config)
    texts = [t or "" for _, t in EDGE] + [r.text or "" for r in docs.select("text").limit(40).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i, t in enumerate(texts):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())
        ids = [_bucket(w, config) for w in re.findall(rb"[0-9a-z\x80-\xff]+", low)] + [config.buckets] * max(config.widths)
        h, k = [], 0
        for width, bias in zip(config.widths, model.bias, strict=True):
            sums = []
            for at in range(len(ids)):
                x = np.zeros(len(bias), np.float64)
                for j in range(width):
                    if at + j < len(ids):
                        x += model.tables[k + j][model.row[ids[at + j]]]
                sums.append(x)
            k += width
            h.append(np.maximum(np.max(sums, axis=0) + bias, 0))
        z = float(np.concatenate(h) @ model.out + model.out_bias)
        want = 1 / (1 + math.exp(-min(30, max(-30, model.scale[0] * z + model.scale[1]))))
        # single precision of the sum, times the slope of the curve
        assert abs(got[i] - want) < 1e-5 + 1e-6 * model.scale[0], (i, model.scale)


def test_language_scores(spark):
    docs = registry.table(spark, SF, "documents")
    config = langid.Config(window=64, epochs=2, sample_rows=30)
    model = langid.fit(docs, registry.remainder(5) != 0, config)
    texts = [t or "" for _, t in EDGE] + [r.text or "" for r in docs.select("text").limit(30).collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        raw = bytes(b + 32 if 65 <= b < 91 else b for b in t.encode())
        total = np.zeros(len(model.langs))
        for a in range(0, len(raw), config.window):
            part = raw[a : a + config.window]
            padded = part.ljust(config.window + max(config.widths), b"\0")
            h, pair, one = [], iter(model.pairs), iter(model.ones)
            for width in config.widths:
                tables = [next(pair) for _ in range(width // 2)]
                odd = next(one) if width % 2 else None
                best = np.full(config.filters, -np.inf)
                for at in range(config.window):
                    x = sum(tables[j][padded[at + 2 * j] << 8 | padded[at + 2 * j + 1]].astype(float) for j in range(width // 2))
                    best = np.maximum(best, x + (odd[padded[at + width - 1]] if odd is not None else 0))
                h.append(best)
            z = np.maximum(np.concatenate(h) + model.bias, 0) @ model.out + model.out_bias
            total += len(part) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        lettered = any(c.isalpha() for c in t)
        p = np.exp(total / max(1, len(raw)) - (total / max(1, len(raw))).max())
        p /= p.sum()
        lang, score = got[i]
        assert (lang == "und") == (not lettered)
        if lettered:
            assert abs(score - p.max()) < 1e-3 and (lang == model.langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)
