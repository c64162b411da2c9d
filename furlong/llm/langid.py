"""Language identification: a byte convolutional network over fixed-length windows.

Every text is cut into windows of ``window`` bytes (the last one padded), filters of several widths run over
the bytes, are max-pooled over the window, and a softmax layer gives language probabilities. The log
probabilities of all windows of a text are averaged, weighted by their bytes. Trained in numpy.

Defined results: a null text or one without a letter gets ``und`` with score 0. Repeated rows are treated
alike, an empty table gives an empty result, further columns are ignored. Without labelled rows every text
gets ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.session import prepare


@dataclass(frozen=True)
class Config:
    """window: bytes of a window. sample_rows: expected bound on the labelled rows fetched for each language,
    of which sample_chars characters (from a place given by a hash) are used to train."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    dim: int = 8
    sample_rows: int = 250
    sample_chars: int = 1500
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass
class Model:
    config: Config
    langs: list[str] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)  # (65536, filters) for each pair of places of a width
    ones: list[np.ndarray] = field(default_factory=list)  # (256, filters) for the last place of an odd width
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """windows: (n, window + pad) bytes."""
        c, size = self.config, self.config.window
        code = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        pooled, pair, one = [], iter(self.pairs), iter(self.ones)
        for width in c.widths:
            x = next(pair)[code[:, :size]]
            for j in range(2, width - 1, 2):
                x += next(pair)[code[:, j : j + size]]
            if width % 2:
                x += next(one)[windows[:, width - 1 : width - 1 + size]]
            pooled.append(x.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(buf: np.ndarray, offsets: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The padded windows of all texts, the text of each window and the bytes it holds."""
    size, pad = config.window, max(config.widths)
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), count)
    index = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + index * size
    held = np.minimum(size, offsets[text + 1] - start)
    padded = np.concatenate([tb.LOWER[buf], np.zeros(size + pad, np.uint8)])
    at = start[:, None] + np.arange(size + pad)[None]
    out = padded[at]
    out[at >= offsets[text + 1][:, None]] = 0
    out[:, size:] = 0
    return out, text, held


def train(texts: list[str], langs: list[str], config: Config) -> Model:
    model = Model(config, sorted(set(langs)))
    if not model.langs:
        return model
    rng = np.random.default_rng(config.seed)
    buf, offsets = tb.text_bytes(pa.array(texts, pa.string()))
    x, text, held = windows_of(buf, offsets, config)
    keep = held >= min(64, config.window)
    x, y = (x[keep], np.searchsorted(model.langs, langs)[text[keep]]) if keep.any() else (x, np.searchsorted(model.langs, langs)[text])
    # short texts must be told as well: the same windows cut short
    cut = x.copy()
    cut[np.arange(cut.shape[1])[None] >= rng.integers(8, config.window, len(cut))[:, None]] = 0
    x, y = np.concatenate([x, cut]), np.concatenate([y, y])
    d, f, w, size = config.dim, config.filters, config.widths, config.window
    n_lang = len(model.langs)
    params = {"emb": rng.normal(0, 0.5, (256, d)), "out": rng.normal(0, 0.2, (f * len(w), n_lang)), "b": np.zeros(n_lang), "c": np.zeros(f * len(w))}
    params["emb"][0] = 0
    params |= {f"k{i}": rng.normal(0, 1 / np.sqrt(d * k), (k, d, f)) for i, k in enumerate(w)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    share = np.bincount(y, minlength=n_lang) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / n_lang)[y]
    step, order = 0, np.arange(len(x))
    for _ in range(config.epochs):
        rng.shuffle(order)
        for at in range(0, len(order), config.batch):
            rows = order[at : at + config.batch]
            v = x[rows]
            h, best = [], []
            for i, k in enumerate(w):
                tables = [params["emb"] @ params[f"k{i}"][j] for j in range(k)]
                z = sum(tables[j][v[:, j : j + size]] for j in range(k))
                best.append(z.argmax(axis=1))
                h.append(np.take_along_axis(z, best[-1][:, None], axis=1)[:, 0])
            a = np.concatenate(h, axis=1) + params["c"]
            r = np.maximum(a, 0)
            z = r @ params["out"] + params["b"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            da = (p @ params["out"].T) * (a > 0)
            grads = {"out": r.T @ p, "b": p.sum(0), "c": da.sum(0), "emb": np.zeros_like(params["emb"])}
            for i, k in enumerate(w):
                part, dk = da[:, i * f : (i + 1) * f], np.zeros_like(params[f"k{i}"])
                for j in range(k):
                    byte = v[np.arange(len(rows))[:, None], best[i] + j]
                    dk[j] = np.einsum("rfd,rf->df", params["emb"][byte], part)
                    np.add.at(grads["emb"], byte, part[:, :, None] * params[f"k{i}"][j].T[None])
                grads[f"k{i}"] = dk
            grads["emb"][0] = 0
            step += 1
            for name, value in params.items():
                m = first[name] = 0.9 * first[name] + 0.1 * grads[name]
                s = second[name] = 0.999 * second[name] + 0.001 * grads[name] ** 2
                value -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    for i, k in enumerate(w):
        tables = [(params["emb"] @ params[f"k{i}"][j]).astype(np.float32) for j in range(k)]
        for j in range(0, k - 1, 2):
            model.pairs.append((tables[j][:, None] + tables[j + 1][None]).reshape(65536, f))
        if k % 2:
            model.ones.append(tables[-1])
    model.bias, model.out, model.out_bias = (params[k].astype(np.float32) for k in ("c", "out", "b"))
    return model


def fit(docs: DataFrame, learn: Column, config: Config = Config()) -> Model:
    """Train on about sample_rows documents of each language; the number of languages is taken to be small."""
    rows = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(1_000_003))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (part < F.lit(int(1_000_003 * min(1.0, config.sample_rows / n)) + 1)))
    at = F.pmod(F.xxhash64("doc_id", F.lit(config.seed + 1)), F.greatest(F.lit(1), F.length("text") - config.sample_chars + 1))
    got = rows.where(chosen).select("doc_id", "lang", F.col("text").substr((at + 1).cast("int"), F.lit(config.sample_chars)).alias("text"))
    got = got.orderBy("doc_id", "lang", "text").limit(2 * config.sample_rows * max(1, len(counts))).toArrow()
    return train(got["text"].to_pylist(), got["lang"].to_pylist(), config)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            arr = tb.column(batch, "text")
            lettered = pc.fill_null(pc.match_substring_regex(arr, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            buf, offsets = tb.text_bytes(arr)
            total = np.zeros((len(arr), max(1, len(m.langs))))
            for a, b in tb.slices(offsets, 1 << 18):
                x, text, held = windows_of(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.config)
                if m.langs and len(x):
                    logs = np.concatenate([m.log_probs(x[i : i + 512]) for i in range(0, len(x), 512)]) * held[:, None]
                    for k in range(len(m.langs)):
                        total[a:b, k] += np.bincount(text, logs[:, k], minlength=b - a)
            mean = total / np.maximum(1, np.diff(offsets))[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            known = lettered & bool(m.langs)
            names = np.array([*m.langs, "und"], object)[np.where(known, best, len(m.langs))]
            yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, p.max(axis=1), 0.0))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tb.lean(run), f"doc_id {kind}, lang_pred string, score double")
