"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are hashed into embedding buckets, filters of several widths run over the embedded words, each filter
is max-pooled over the whole text and a logistic layer gives the score. ``nets`` such networks are trained in numpy on all
labelled documents, each without another part of them; their mean is one network with the filters of all. The first
networks are those of a sample, drawn by class and language and trained in one task; if that is not all there is, every
task goes on from them over its own labelled rows, batch by batch, and the parameters of all tasks are averaged,
``passes`` times. Scale and thresholds come from the scores that the parts left out get, of all labelled documents.
Every document is learnt from and scored over its whole text.

Defined results: a null or empty text is a text without words and gets the score of the bias. Repeated rows
are scored alike. An empty table gives an empty result. Of conflicting labels of one doc_id toxic holds, and of its texts
the least is learnt from. Columns other than the named ones are ignored; ``reject`` keeps all and reserves ``__tx_score``. If the
sample lacks one of the two classes, every score is the (clipped) share of label 1, 0 without labels.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.session import materialize, prepare

LETTERS = tb.byte_table("letters")
#: Words of a training batch, unless a text has more, and windows that are looked at at once.
WORDS = 1 << 17
#: Steps of 1 in the table of scores that scale and thresholds of many rows are made of, and the largest score there.
FINE, FAR = 256, 64
#: Numbers of a network that are averaged as one.
CHUNK = 1 << 15


@dataclass(frozen=True)
class Config:
    """buckets, dim, widths, filters: shape of a network, of which there are ``nets``. sample_rows: expected bound on
    the labelled rows that the first networks are trained on, per class, dealt evenly to the languages as far as they have
    rows. passes: over all labelled rows after that. min_docs: a word bucket gets an embedding if so many documents of a sample
    would hold it, by its shares in both classes of all labelled rows. steps: least batches of a first network, so that small samples are trained as long. initial:
    spread of the first embeddings, small so that words that tell nothing stay near zero. drop: share of words left
    out of each batch. threshold: where all languages together have too few positives (fewer than ``least``), this
    threshold holds."""

    buckets: int = 1 << 16
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    nets: int = 5
    sample_rows: int = 2000
    passes: int = 1
    min_docs: int = 4
    epochs: int = 10
    steps: int = 500
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-3
    initial: float = 0.01
    drop: float = 0.5
    threshold: float = 0.3
    least: int = 8
    seed: int = 7


@dataclass
class Model:
    config: Config
    row: np.ndarray | None = None  # of each word bucket in the tables; words without an embedding share the last one
    made: list[np.ndarray] = field(default_factory=list)  # one (rows, filters) table per width and place
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float | None = None  # of all languages
    constant: float | None = None
    nets: list[tuple[np.ndarray, list[np.ndarray]]] = field(default_factory=list)  # embeddings and kernels, a third of the tables' size

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": []}

    @property
    def tables(self) -> list[np.ndarray]:
        """Made where they are needed and not sent."""
        if not self.made:
            at = [(i, j) for i, k in enumerate(self.config.widths) for j in range(k)]
            self.made = [np.concatenate([(emb @ kernels[i][j]).astype(np.float32) for emb, kernels in self.nets], axis=1) for i, j in at]
        return self.made

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Max-pooled filters per text. ids are padded after each text, and the windows that begin so late in the padding
        that they would reach the next text are left out."""
        ids = self.row[ids]
        late = late_places(np.append(starts[1:], len(ids)), self.config)
        parts, k = [], 0
        for width, bias in zip(self.config.widths, self.bias, strict=True):
            x = self.tables[k][ids]
            for j in range(1, width):
                x[:-j] += self.tables[k + j][ids[j:]]
            k += width
            x[late] = -np.inf
            parts.append(np.maximum.reduceat(x, starts, axis=0) + bias)
        return np.maximum(np.concatenate(parts, axis=1), 0)

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        z = self.pooled(ids, starts) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


def late_places(ends: np.ndarray, config: Config) -> np.ndarray:
    """The last places of each text's padding, but for its first."""
    return (ends[:, None] - np.arange(1, max(config.widths))).reshape(-1)


def bucket_ids(buf: np.ndarray, offsets: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of all texts, each text followed by max(widths) pads, and where each text starts."""
    buf = tb.LOWER[buf]
    starts, ends, before = tb.words(buf, offsets, LETTERS)
    hashed = (tb.span_hashes(tb.prefix_sums(buf), starts, ends) >> np.uint64(40)).astype(np.int64) % config.buckets
    pad = max(config.widths)
    n = len(offsets) - 1
    ids = np.full(len(hashed) + n * pad, config.buckets, np.int64)
    ids[np.arange(len(hashed)) + pad * np.repeat(np.arange(n), np.diff(before))] = hashed
    return ids, before[:-1] + pad * np.arange(n)


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], config: Config, counts: dict[tuple[int, str | None], int] | None = None) -> Model:
    """Fit each network on the texts without its part; scale scores and set thresholds by language on the parts left out.

    counts: labelled rows of each class and language in all data; the sample's are weighted to their shares there.
    """
    model = Model(config)
    labels = np.asarray(labels, np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        model.constant = float(labels[0]) if len(labels) else 0.0
        return model
    rng = np.random.default_rng(config.seed)
    buf, offsets = tb.text_bytes(pa.array(texts, pa.string()))
    # in slices, as hashing needs many times the memory of the text at hand
    parts = [bucket_ids(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], config) for a, b in tb.slices(offsets, 1 << 20)]
    before = np.cumsum([0, *(len(p[0]) for p in parts)])
    ids, starts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + x for p, x in zip(parts, before, strict=False)])
    ends = np.append(starts[1:], len(ids))
    known = known_words(ids, ends - starts, config)
    fold = rng.permutation(len(texts)) % config.nets
    made = [x.model() for x in networks(ids, starts, ends, labels, langs, fold, known, config, rng)]
    z = left_out(made, ids, starts, ends, fold)
    mass = np.ones(len(labels))
    if counts is not None:
        cells, cell = cells_of(labels, langs)
        for (y, lang), i in cells.items():
            mass[cell == i] = counts.get((y, lang), 0) / (cell == i).sum()
        mass /= mass.mean()
    return settled(merged(made, config), z, labels, langs, mass)


def cells_of(labels: np.ndarray, langs: list[str | None]) -> tuple[dict[tuple[int, str | None], int], np.ndarray]:
    """The classes and languages there are, and which each row has."""
    pairs = list(zip(labels.astype(int).tolist(), langs, strict=True))
    cells = {c: i for i, c in enumerate(sorted(set(pairs), key=str))}
    return cells, np.array([cells[c] for c in pairs])


def networks(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, langs: list[str | None], fold: np.ndarray, known: np.ndarray, config: Config, rng: np.random.Generator) -> list[Network]:
    """A network for each fold, fitted on the texts of the others."""
    cell, made = cells_of(labels, langs)[1], []
    for k in range(config.nets):
        fit = fold != k
        if not fit.any() or labels[fit].min() == labels[fit].max():
            fit[:] = True
        made.append(network(ids, starts, ends, labels, cell, fit, known, config, rng))
    return made


def left_out(made: list[Model], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Of each text the score by the network that has not seen its fold."""
    z = np.zeros(len(starts))
    for k, one in enumerate(made):
        own = np.flatnonzero(fold == k)
        for a, b in blocks(len(own)):
            rows = own[a : b + 1]
            at = np.cumsum([0, *(ends - starts)[rows][:-1]])
            z[rows] = one.pooled(np.concatenate([ids[starts[r] : ends[r]] for r in rows]), at) @ one.out + one.out_bias
    return z


def merged(made: list[Model], config: Config) -> Model:
    """The networks' mean as one network."""
    model = Model(config)
    model.row = made[0].row
    model.nets = [x for one in made for x in one.nets]
    model.bias = [np.concatenate([one.bias[i] for one in made]) for i in range(len(config.widths))]
    outs = [np.split(one.out, len(config.widths)) for one in made]
    model.out = np.concatenate([o[i] for i in range(len(config.widths)) for o in outs]) / np.float32(config.nets)
    model.out_bias = float(np.mean([one.out_bias for one in made]))
    return model


def settled(model: Model, z: np.ndarray, labels: np.ndarray, langs: list[str | None], mass: np.ndarray, n: np.ndarray | None = None) -> Model:
    """model with scale and thresholds by the scores of what its networks had not seen. n: rows that each of them stands for."""
    n = np.ones(len(z)) if n is None else n
    model.scale = platt(z, labels, mass * n, n)
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -30, 30)))
    model.threshold = threshold(p, labels, mass * n, model.config, n, model.config.threshold)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        model.thresholds[lang] = threshold(p[own], labels[own], (mass * n)[own], model.config, n[own], model.threshold)
    return model


def known_words(ids: np.ndarray, lengths: np.ndarray, config: Config) -> np.ndarray:
    """Which word buckets get an embedding."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    held = np.unique(doc * (config.buckets + 1) + ids) % (config.buckets + 1)
    known = np.bincount(held, minlength=config.buckets + 1) >= config.min_docs
    known[config.buckets] = False
    return known


class Network:
    """A network in training: its parameters and their moments."""

    def __init__(self, config: Config, known: np.ndarray, rng: np.random.Generator | None = None, numbers: np.ndarray | None = None):
        d, f, w = config.dim, config.filters, config.widths
        self.config, self.known, self.steps = config, known, 0
        self.rows = np.append(np.flatnonzero(known), config.buckets)
        if numbers is None:
            emb = rng.normal(0, config.initial, (config.buckets + 1, d)) * known[:, None]
            kernels = [rng.normal(0, 1 / np.sqrt(d * k), (k, d, f)) for k in w]
            self.params = {"emb": emb, "out": rng.normal(0, 0.3, f * len(w)), "b": np.zeros(1)}
            self.params |= {f"k{i}": x for i, x in enumerate(kernels)} | {f"c{i}": np.zeros(f) for i in range(len(w))}
        else:
            shapes = {"emb": (len(self.rows), d), "out": (f * len(w),), "b": (1,)} | {f"k{i}": (k, d, f) for i, k in enumerate(w)} | {f"c{i}": (f,) for i in range(len(w))}
            at = np.cumsum([0, *(int(np.prod(s)) for s in shapes.values())])
            self.params = {name: numbers[a:b].astype(np.float64).reshape(s) for (name, s), a, b in zip(shapes.items(), at, at[1:], strict=False)}
            emb = np.zeros((config.buckets + 1, d))
            emb[self.rows] = self.params["emb"]
            self.params["emb"] = emb
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))

    def numbers(self) -> np.ndarray:
        """All parameters, those of embeddings for the known words."""
        return np.concatenate([(v[self.rows] if k == "emb" else v).ravel() for k, v in self.params.items()]).astype(np.float32)

    def model(self) -> Model:
        made, w = Model(self.config), self.config.widths
        made.row = np.full(self.config.buckets + 1, len(self.rows) - 1, np.int32)
        made.row[self.rows] = np.arange(len(self.rows))
        made.nets = [(self.params["emb"][self.rows], [self.params[f"k{i}"] for i in range(len(w))])]
        made.bias = [self.params[f"c{i}"].astype(np.float32) for i in range(len(w))]
        made.out, made.out_bias = self.params["out"].astype(np.float32), float(self.params["b"][0])
        return made

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One step down the gradient of a batch."""
        config, known, params = self.config, self.known, self.params
        f, w = config.filters, config.widths
        seq = np.concatenate(texts)
        seq = np.where(rng.random(len(seq)) < config.drop, config.buckets, seq)
        begin = np.cumsum([0, *(len(x) for x in texts[:-1])])
        seen, where = np.unique(seq, return_inverse=True)
        x = params["emb"][seen]
        pooled, best = [], []
        for i in range(len(w)):
            top, at = strongest(x, where, begin, params[f"k{i}"], config)
            best.append(at)
            pooled.append(top + params[f"c{i}"])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        z = h @ params["out"] + params["b"]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight / len(texts)
        grads = {"out": h.T @ g + config.decay * params["out"], "b": np.array([g.sum()])}
        dh = np.outer(g, params["out"]) * (h > 0)
        demb = np.zeros_like(x)
        for i, k in enumerate(w):
            dk = np.zeros_like(params[f"k{i}"])
            part = dh[:, i * f : (i + 1) * f]
            grads[f"c{i}"] = part.sum(0)
            for j in range(k):
                place = where[np.minimum(best[i] + j, len(seq) - 1)]  # (rows, filters)
                dk[j] = np.einsum("rfd,rf->df", x[place], part)
                np.add.at(demb, place, part[:, :, None] * params[f"k{i}"][j].T[None])
            grads[f"k{i}"] = dk + config.decay * params[f"k{i}"]
        demb[~known[seen]] = 0
        self.steps += 1
        for name, v in params.items():
            at_rows = seen if name == "emb" else slice(None)
            grad = demb + config.decay * x if name == "emb" else grads[name]
            if name == "emb":
                grad[~known[seen]] = 0
            m = self.first[name][at_rows] = 0.9 * self.first[name][at_rows] + 0.1 * grad
            s = self.second[name][at_rows] = 0.999 * self.second[name][at_rows] + 0.001 * grad * grad
            v[at_rows] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)


def strongest(x: np.ndarray, where: np.ndarray, begin: np.ndarray, kernel: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Of each text and filter the largest value and the first window that has it; a long text is looked at piece by piece."""
    k, n = len(kernel), len(where)
    by_word = [x @ kernel[j] for j in range(k)]
    late = late_places(np.append(begin[1:], n), config)
    top, best = np.full((len(begin), kernel.shape[2]), -np.inf), np.full((len(begin), kernel.shape[2]), n)
    for a in range(0, n, WORDS):
        b = min(a + WORDS, n)
        y = by_word[0][where[a:b]]
        for j in range(1, k):
            more = by_word[j][where[a + j : b + j]]
            y[: len(more)] += more
        y[late[(late >= a) & (late < b)] - a] = -np.inf
        r = np.searchsorted(begin, a, "right") - 1
        own = slice(r, np.searchsorted(begin, b))
        at = np.maximum(begin[own] - a, 0)
        here = np.maximum.reduceat(y, at, axis=0)
        owner = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(y))))
        hit = np.minimum.reduceat(np.where(y == here[owner], np.arange(a, b)[:, None], n), at, axis=0)
        best[own] = np.where(here > top[own], hit, best[own])
        top[own] = np.maximum(here, top[own])
    return top, best


def batches_of(order: np.ndarray, lengths: np.ndarray, config: Config) -> Iterator[np.ndarray]:
    """The rows in order, ``batch`` of them or as many as have WORDS words, one at least."""
    at, words = 0, 0
    for i, r in enumerate(order):
        if i > at and (i - at == config.batch or words + lengths[r] > WORDS):
            yield order[at:i]
            at, words = i, 0
        words += lengths[r]
    if len(order):
        yield order[at:]


def network(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, cell: np.ndarray, fit: np.ndarray, known: np.ndarray, config: Config, rng: np.random.Generator) -> Network:
    """One network fitted on the texts of ``fit``. Both classes weigh alike, their languages by the roots of their numbers."""
    made = Network(config, known, rng)
    weight = np.maximum(np.bincount(cell, fit), 1)[cell] ** -0.5
    for y in (0, 1):
        weight[labels == y] *= 0.5 * fit.sum() / weight[fit & (labels == y)].sum()
    order = np.flatnonzero(fit)
    for _ in range(max(config.epochs, -(-config.steps * config.batch // len(order)))):
        rng.shuffle(order)
        for rows in batches_of(order, ends - starts, config):
            made.step([ids[starts[r] : ends[r]] for r in rows], labels[rows], weight[rows], rng, config.rate)
    return made


def blocks(n: int, size: int = 256) -> Iterator[tuple[int, int]]:
    return ((a, min(a + size, n) - 1) for a in range(0, n, size))


def platt(z: np.ndarray, y: np.ndarray, mass: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the scores, with smoothed targets."""
    pos, neg = n @ y, n @ (1 - y)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = mass * (p - t), mass * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[h @ (z * z) + 1e-3, h @ z], [h @ z, h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [g @ z + 1e-3 * (a - 1), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(a, 1e-3), b


def threshold(p: np.ndarray, y: np.ndarray, mass: np.ndarray, config: Config, n: np.ndarray | None = None, other: float | None = None) -> float:
    """The middle of the range of thresholds with the best F1 that lies nearest to the default, of all ranges between two scores.
    ``other`` with too few positives, n being the rows that each of p stands for."""
    if (y.sum() if n is None else n @ y) < config.least:
        return config.threshold if other is None else other
    cuts, at = np.unique(p, return_inverse=True)
    all_of, hits_of = np.bincount(at, mass), np.bincount(at, mass * y)
    # a threshold above the score before and up to this one flags this one and all after it
    f1 = 2 * np.cumsum(hits_of[::-1])[::-1] / (np.cumsum(all_of[::-1])[::-1] + hits_of.sum())
    best = f1 >= f1.max() - 1e-9
    low, high = np.append(0.0, cuts[:-1]), cuts
    first, last = best & ~np.append(False, best[:-1]), best & ~np.append(best[1:], False)
    low, high = low[first], high[last]
    k = np.argmin(np.maximum(np.maximum(low - config.threshold, config.threshold - high), 0))
    return float((low[k] + high[k]) / 2)


def quotas(counts: dict[str | None, int], rows: int) -> dict[str | None, float]:
    """How many of ``rows`` each language gets: all that it has, or an even share of what the smaller ones leave."""
    out, left = {}, rows
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        out[lang] = min(n, left / (len(counts) - i))
        left -= out[lang]
    return out


def labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and lang of the documents to learn from, and the doc_id and y of labels."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").where(learn), marks


def chance(seed: int) -> Column:
    """0 to 1 by doc_id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def shares_of(counts: dict[tuple[int, str | None], int], config: Config) -> list[tuple[int, str | None, float]]:
    """Class, language and how much of it the sample takes."""
    out = []
    for y in (0, 1):
        own = {lang: n for (k, lang), n in counts.items() if k == y}
        out += [(y, lang, n / own[lang]) for lang, n in quotas(own, config.sample_rows).items()]
    return out


def drawn(docs: DataFrame, labels: DataFrame, learn: Column, config: Config) -> tuple[DataFrame, dict[tuple[int, str | None], int]]:
    """doc_id, text, lang and y of about sample_rows labelled documents of each class at most, chosen by a hash of doc_id, and how many there are of each class and language."""
    texts, marks = labelled(docs, labels, learn)
    ids = texts.select("doc_id", "lang").join(marks, "doc_id")
    counts = {(r["y"], r["lang"]): r["count"] for r in ids.groupBy("y", "lang").count().collect()}
    of = docs.sparkSession.createDataFrame(shares_of(counts, config), f"k int, of {docs.schema['lang'].dataType.simpleString()}, share double")
    picked = ids.join(F.broadcast(of), (F.col("y") == F.col("k")) & F.col("lang").eqNullSafe(F.col("of"))).where(chance(config.seed) < F.col("share")).select("doc_id", "y")
    # about 2 * sample_rows ids: a bound that does not grow with the data
    one = texts.join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "y")).alias("s"))
    return one.select("doc_id", "s.*"), counts


def sample(docs: DataFrame, labels: DataFrame, learn: Column, config: Config) -> tuple[list[str], np.ndarray, list[str | None], dict[tuple[int, str | None], int]]:
    """Texts, labels and languages of the drawn rows, and the counts."""
    found, counts = drawn(docs, labels, learn, config)
    rows = found.orderBy("doc_id").toArrow()
    return rows["text"].to_pylist(), rows["y"].to_numpy().astype(float), rows["lang"].to_pylist(), counts


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """doc_id, lang, the named further columns, and the score under ``name``, for every row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offsets = tb.text_bytes(tb.column(batch, "text"))
            scores = [np.zeros(0)]
            for a, b in tb.slices(offsets, 1 << 18):
                ids, starts = bucket_ids(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.config)
                scores.append(m.score(ids, starts).astype(np.float64))
            rest = [tb.column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(scores))], [*names, name])

    names = ["doc_id", "lang", *keep]
    kept = docs.select(*names, *(["text"] if "text" not in names else []))
    types = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)
    return kept.mapInArrow(tb.lean(run), f"{types}, `{name}` double")


def thresholds(model: Model) -> Column:
    """The threshold of the row's language."""
    at = F.lit(model.config.threshold if model.threshold is None else model.threshold)
    for lang, x in model.thresholds.items():
        at = F.when(F.col("lang") == lang, F.lit(x)).otherwise(at)
    return at


def fit(docs: DataFrame, labels: DataFrame, learn: Column, config: Config = Config()) -> Model:
    """The model of all labelled documents, trained in tasks: the driver holds no text and none of the training's memory."""
    prepare(docs.sparkSession)
    found, counts = drawn(docs, labels, learn, config)
    if any(share < 1 for *_, share in shares_of(counts, config)) and len({y for y, _ in counts}) == 2:
        return fit_all(docs, labels, learn, config, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pa.Table.from_batches(held)
            model = train(rows["text"].to_pylist(), rows["y"].to_numpy().astype(float), rows["lang"].to_pylist(), config, counts)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = found.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0), [], config, counts)


def stored(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of the rows' texts, and where each text starts and ends."""
    held = [np.frombuffer(x, np.int32) for x in batch["words"].to_pylist()]
    ends = np.cumsum([len(x) for x in held])
    return np.concatenate(held).astype(np.int64), np.append(0, ends[:-1]), ends


def fit_all(docs: DataFrame, labels: DataFrame, learn: Column, config: Config, counts: dict[tuple[int, str | None], int]) -> Model:
    """The networks of a sample, and ``passes`` over all labelled rows, in each of which every task goes on by itself and the mean
    of all tasks is taken. Held at once are a batch of rows and the networks."""
    spark = docs.sparkSession
    texts, marks = labelled(docs, labels, learn)
    one = texts.join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "y")).alias("s")).select("doc_id", "s.*")
    one = one.select("doc_id", "text", "lang", "y", chance(config.seed).alias("at"), F.pmod(F.xxhash64("doc_id", F.lit(config.seed + 1)), F.lit(config.nets)).cast("int").alias("fold"))
    kept = ["doc_id", "lang", "y", "at", "fold"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.text_bytes(tb.column(batch, "text"))
            words = []
            for a, b in tb.slices(offsets, 1 << 20):
                ids, starts = bucket_ids(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], config)
                words += [x.astype(np.int32).tobytes() for x in np.split(ids, starts[1:])]
            yield pa.RecordBatch.from_arrays([*(tb.column(batch, c) for c in kept), pa.array(words, pa.large_binary()).cast(pa.binary())], [*kept, "words"])

    types = ", ".join(f"{c} {one.schema[c].dataType.simpleString()}" for c in kept)
    rows = materialize(spark, one.mapInArrow(tb.lean(hashed), f"{types}, words binary"), "toxicity-words")
    own = {y: sum(n for (k, _), n in counts.items() if k == y) for y in (0, 1)}

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of a sample would hold each word, by this task's rows."""
        total = np.zeros(config.buckets + 1)
        for batch in batches:
            ids, starts, ends = stored(batch)
            y = tb.column(batch, "y").to_numpy()[np.repeat(np.arange(len(starts)), ends - starts)]
            doc = np.repeat(np.arange(len(starts)), ends - starts) * 2 + y
            held = np.unique(doc * (config.buckets + 1) + ids)
            share = np.array([min(1, config.sample_rows / own[k]) for k in (0, 1)])[held // (config.buckets + 1) % 2]
            total += np.bincount(held % (config.buckets + 1), share, config.buckets + 1)
        some = np.flatnonzero(total[: config.buckets])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    known = np.zeros(config.buckets + 1, bool)
    words = rows.select("y", "words").mapInArrow(holders, "word long, n double").groupBy("word").agg(F.sum("n").alias("n"))
    known[[r["word"] for r in words.where(F.col("n") >= config.min_docs - 1e-6).select("word").collect()]] = True

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rng = [b for b in batches if len(b)], np.random.default_rng(config.seed)
        if parts:
            held = pa.Table.from_batches(parts)
            made = networks(*stored(held), held["y"].to_numpy().astype(float), held["lang"].to_pylist(), held["fold"].to_numpy(), known, config, rng)
        else:
            made = [Network(config, known, rng) for _ in range(config.nets)]
        yield pa.RecordBatch.from_arrays([pa.array([x.numbers().tobytes() for x in made], pa.binary())], ["numbers"])

    shares = spark.createDataFrame(shares_of(counts, config), f"k int, of {docs.schema['lang'].dataType.simpleString()}, share double")
    some = rows.join(F.broadcast(shares), (F.col("y") == F.col("k")) & F.col("lang").eqNullSafe(F.col("of"))).where("at < share").select("doc_id", "y", "lang", "fold", "words")
    nets = [np.frombuffer(r["numbers"], np.float32) for r in some.repartition(1).sortWithinPartitions("doc_id").mapInArrow(tb.lean(first), "numbers binary").collect()]
    roots = {y: sum(n**0.5 for (k, _), n in counts.items() if k == y) for y in (0, 1)}
    weight_of = {(y, lang): 0.5 * sum(own.values()) / (roots[y] * n**0.5) for (y, lang), n in counts.items()}

    for k in range(config.passes):
        nets = averaged(rows, nets, known, weight_of, config, k)
    return scaled(rows, nets, known, config)


def averaged(rows: DataFrame, nets: list[np.ndarray], known: np.ndarray, weight_of: dict[tuple[int, str | None], float], config: Config, number: int) -> list[np.ndarray]:
    """The networks after one pass: the mean of what they are after each task's rows."""
    shared = rows.sparkSession.sparkContext.broadcast((nets, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Network(config, shared.value[1], numbers=x) for x in shared.value[0]]
        rng = np.random.default_rng([config.seed, number, TaskContext.get().partitionId()])
        n = 0
        for batch in batches:
            ids, starts, ends = stored(batch)
            y, lang, fold = tb.column(batch, "y").to_pylist(), tb.column(batch, "lang").to_pylist(), tb.column(batch, "fold").to_numpy()
            weight = np.array([weight_of[c] for c in zip(y, lang, strict=True)])
            y, order = np.array(y, float), rng.permutation(len(y))
            for i, one in enumerate(made):
                for at in batches_of(order[fold[order] != i], ends - starts, config):
                    # smaller steps than those of the first networks, as they go on from these
                    one.step([ids[starts[r] : ends[r]] for r in at], y[at], weight[at], rng, config.rate / (2 + 2 * number))
            n += len(y)
        for i, one in enumerate(made if n else []):
            numbers = one.numbers()
            parts = np.split(numbers, np.arange(CHUNK, len(numbers), CHUNK))
            same = [pa.array([v] * len(parts)) for v in (i, n, TaskContext.get().partitionId())]
            yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], ["net", "n", "task", "part", "numbers"])

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        held = np.stack([np.frombuffer(x, np.float32) for x in group["numbers"].to_pylist()])
        found = np.average(held.astype(np.float64), axis=0, weights=group["n"].to_numpy()).astype(np.float32)
        return pa.table({"net": group["net"][:1], "part": group["part"][:1], "numbers": pa.array([found.tobytes()], pa.binary())})

    after = rows.select("y", "lang", "fold", "words").mapInArrow(tb.lean(run), "net long, n long, task long, part long, numbers binary")
    found = after.groupBy("net", "part").applyInArrow(mean, "net long, part long, numbers binary").orderBy("net", "part").collect()
    shared.unpersist()
    return [np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in found if r["net"] == i]) for i in range(config.nets)]


def scaled(rows: DataFrame, nets: list[np.ndarray], known: np.ndarray, config: Config) -> Model:
    """The networks as one, with scale and thresholds by the scores that all labelled rows get from the network that has not seen
    them. The scores are counted in steps of 1 / FINE, so their table has a bounded size."""
    shared = rows.sparkSession.sparkContext.broadcast((nets, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Network(config, shared.value[1], numbers=x).model() for x in shared.value[0]]
        for batch in batches:
            z = left_out(made, *stored(batch), tb.column(batch, "fold").to_numpy())
            step = np.round(np.clip(z, -FAR, FAR) * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([tb.column(batch, "y"), tb.column(batch, "lang"), pa.array(step)], ["y", "lang", "step"])

    kind = rows.schema["lang"].dataType.simpleString()
    found = rows.select("y", "lang", "fold", "words").mapInArrow(tb.lean(run), f"y int, lang {kind}, step long").groupBy("y", "lang", "step").count().orderBy("step", "y", "lang").toArrow()
    made = merged([Network(config, known, numbers=x).model() for x in nets], config)
    shared.unpersist()
    z, n = found["step"].to_numpy() / FINE, found["count"].to_numpy().astype(float)
    return settled(made, z, found["y"].to_numpy().astype(float), found["lang"].to_pylist(), np.ones(len(z)), n)


def reject(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, config: Config = Config()) -> DataFrame:
    """The documents that stay: those whose score is below the threshold of their language."""
    model = fit(docs, labels, learn, config)
    scored = score(docs, model, tuple(c for c in docs.columns if c not in ("doc_id", "lang")), "__tx_score")
    return scored.where(F.col("__tx_score") < thresholds(model)).select(*docs.columns)
