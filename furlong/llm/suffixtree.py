"""LM scoring by a probabilistic suffix tree over the bytes of a text's words.

A text is the bytes of its words in lower case, a space after each word, and one more space at its end, so that the
end is an empty word and the model is a distribution over sequences of words. Contexts of up to ``depth`` symbols,
reaching across words, are counted over all training texts. A context is kept if it makes up at least ``least_share`` of
the training symbols (so at most 1 / least_share contexts of one length) and its next-symbol distribution diverges
from that of its suffix by more than chance, or a longer kept context ends in it. Distributions are smoothed by those
of the suffix (Witten-Bell). Scoring walks back from each symbol to the longest kept suffix, its state. A word's
probability is the mean of the tree's and of the word's own smoothed share (c + 1) / (N + V + 1), which stands for all
words that training never saw.

The probabilities are of the events that the base score counts: each word that training has, the end, and "a word that
training never saw", for which an unseen word stands whatever its bytes. Over these events they add up to 1 at most: the
tree's share of the unseen words other than the one at hand is given to none.

The base score counts words: sum of log10((c + 1) / (N + V + 1)). Frequent words (a share of at least ``head_share``,
hence a bounded number) are looked up in a broadcast table, all others meet their counts in buckets by hash.

Defined results: a null or empty text is its end alone. Repeated rows and null doc_ids are kept; rows for which ``learn``
is null are not learnt from. Without training texts all symbols are alike. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.session import materialize, prepare

SPACED = tb.byte_table("spaced")
_U = np.uint64
END = _U(0x5DEECE66D)


@dataclass(frozen=True)
class Config:
    depth: int = 5
    least_share: float = 1e-5
    head_share: float = 2e-6
    bucket_rows: int = 1_000_000
    block_bytes: int = 1 << 22


def symbols(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each text after ``pad`` spaces, and the n+1 offsets of these padded texts."""
    n, size = len(before) - 1, ends - starts
    doc = np.repeat(np.arange(n), np.diff(before))
    at = np.cumsum(size + 1) - (size + 1) + doc * (pad + 1) + pad
    total = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(total[-1]) + n * (pad + 1), 32, np.uint8)
    shift = np.cumsum(size) - size
    out[np.repeat(at - shift, size) + np.arange(int(size.sum()))] = buf[np.repeat(starts - shift, size) + np.arange(int(size.sum()))]
    return out, total[before] + np.arange(n + 1) * (pad + 1)


def grams(stream: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol with the ``depth`` symbols before it, as one number; the latest symbol is the lowest byte."""
    padded = np.concatenate([np.full(8, 32, np.uint8), stream])
    keys = np.ndarray((len(stream),), ">u8", buffer=padded, offset=1, strides=(1,)).astype(_U) & _U((1 << 8 * (depth + 1)) - 1)
    inside = np.ones(len(stream), bool)
    inside[(offsets[:-1, None] + np.arange(depth)).reshape(-1)] = False
    return keys[inside]


def _count(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], np.add.reduceat(n, np.flatnonzero(new)) if len(keys) else n


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(x) for x in arrays], "<u4").tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    counts, at, out = np.frombuffer(blob, "<u4", len(kinds)), 4 * len(kinds), []
    for n, kind in zip(counts.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _by(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(groups, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1) if len(order) else []:
        yield int(groups[part[0]]), part


_PART = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
_PART_SQL = "kind int, bucket long, n long, blob binary"


def _table(rows: list, schema: pa.Schema = _PART) -> pa.Table:
    return pa.table([list(c) for c in zip(*rows, strict=True)] or [[]] * len(schema), schema=schema)


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf = tb.LOWER[buf]
    starts, ends, before = tb.words(buf, offsets, SPACED)
    return buf, starts, ends, before, tb.span_hashes(tb.prefix_sums(buf), starts, ends)


def counts(docs: DataFrame, learn: Column, buckets: int, config: Config) -> DataFrame:
    """Packed counts of each block of training text: kind 0 symbols with their contexts, kind 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.text_bytes(tb.column(batch, "text"))
            for a, b in tb.slices(offsets, config.block_bytes):
                own, starts, ends, before, hashed = _words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                stream, at = symbols(own, starts, ends, before, config.depth)
                rows = []
                for kind, keys in ((0, grams(stream, at, config.depth)), (1, np.concatenate([hashed, np.full(b - a, END)]))):
                    keys, n = _count(keys)
                    for g, part in _by((tb.mix(keys) % _U(buckets)).astype(np.int64)):
                        rows.append((kind, g, int(n[part].sum()), _pack(keys[part], n[part].astype(np.uint32))))
                yield from _table(rows).to_batches()

    return docs.where(learn).select("text").mapInArrow(tb.lean(run), _PART_SQL)


def merge(table: pa.Table, least: dict[int, float]) -> pa.Table:
    """Add the counts of one bucket. Symbols go on by the two symbols before them (kind 0), and as counts of pairs (kind 2);
    words leave their number and the frequent ones."""
    rows = []
    for kind in (0, 1):
        blobs = [_unpack(b, "<u8", "<u4") for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == kind]
        if not blobs:
            continue
        keys, n = _count(np.concatenate([x[0] for x in blobs]), np.concatenate([x[1] for x in blobs]).astype(np.int64))
        if kind == 0:
            for g, part in _by(((keys >> _U(8)) & _U(0xFFFF)).astype(np.int64)):
                rows.append((0, g, len(part), _pack(keys[part], n[part])))
            pair, m = _count(keys & _U(0xFFFF), n)
            rows.append((2, 0, len(pair), _pack(pair, m)))
        else:
            some = n >= least[1]
            rows.append((1, 0, len(keys), _pack(keys[some], n[some])))
    return _table(rows)


def pair_counts(merged: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each symbol those that follow it and their counts: at most 256 * 256 numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in tb.column(batch, "blob").to_pylist():
                pair, n = _unpack(blob, "<u8", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

    rows = merged.where("kind = 2").select("blob").mapInArrow(tb.lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").collect()
    found: dict[int, list] = {}
    for pair, n in rows:
        found.setdefault(pair >> 8, []).append((pair & 255, n))
    return {k: (np.array([x[0] for x in v], np.int64), np.array([x[1] for x in v], np.int64)) for k, v in found.items()}


def contexts(blobs: list[bytes], total: int, pairs: dict[int, tuple[np.ndarray, np.ndarray]], config: Config) -> list[tuple[int, int, bytes]]:
    """The kept contexts of two symbols and more that end in the same two: length, context and its packed next symbols and counts."""
    parts = [_unpack(b, "<u8", "<i8") for b in blobs]
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    last = int(keys[0] >> _U(8)) & 255
    sym, count = pairs[last]
    levels = [None, (np.full(len(sym), last, _U), sym, count, _U(last << 8) | sym.astype(_U))]
    for k in range(2, config.depth + 1):  # distributions of the contexts of length k
        key, count = _count(keys & _U((1 << 8 * (k + 1)) - 1), n)
        ctx = key >> _U(8)
        order = np.argsort(ctx, kind="stable")
        levels.append((ctx[order], (key & _U(255))[order].astype(np.int64), count[order], key[order]))
    kept_below: np.ndarray = np.zeros(0, _U)
    out = []
    for k in range(config.depth, 1, -1):
        ctx, sym, count, _ = levels[k]
        new = np.ones(len(ctx), bool)
        new[1:] = ctx[1:] != ctx[:-1]
        at = np.flatnonzero(new)
        mass = np.add.reduceat(count, at)
        group = np.cumsum(new) - 1
        names = ctx[at]
        pctx, psym, pcount, pkey = levels[k - 1]
        order = np.argsort(pkey)
        parent = (ctx & _U((1 << 8 * (k - 1)) - 1)) << _U(8) | sym.astype(_U)
        same = pcount[order][np.searchsorted(pkey[order], parent)]
        psum_at = np.flatnonzero(np.concatenate([[True], pctx[1:] != pctx[:-1]]))
        psum = np.add.reduceat(pcount, psum_at)
        pmass = psum[np.searchsorted(pctx[psum_at], ctx & _U((1 << 8 * (k - 1)) - 1))]
        g = 2 * count * np.log(count / mass[group] * pmass / same)
        test = np.add.reduceat(g, at)
        freedom = np.maximum(1, np.diff(np.append(at, len(ctx))) - 1)
        keep = (mass >= config.least_share * total) & (test > freedom * math.log(max(total, 2)))
        keep |= np.isin(names, kept_below)
        kept = names[keep]
        kept_below = np.unique(kept & _U((1 << 8 * (k - 1)) - 1))
        ends = np.append(at[1:], len(ctx))
        for i in np.flatnonzero(keep).tolist():
            out.append((k, int(names[i]), _pack(sym[at[i] : ends[i]].astype(np.uint8), count[at[i] : ends[i]])))
    return out


class SuffixTree:
    """States by number; 0 is the empty context. child[state, class of the symbol before] is a longer one or 0."""

    def __init__(self, rows: list[tuple[int, int, bytes]], depth: int):
        self.depth = depth
        root = np.zeros(256, np.int64)
        found = {}
        for k, ctx, blob in rows:
            sym, n = _unpack(blob, "<u1", "<i8")
            found[k, ctx] = (sym, n)
            if k == 1:
                root[sym] += n
        seen = np.flatnonzero(root)
        self.classes = np.full(256, len(seen), np.int64)
        self.classes[seen] = np.arange(len(seen))
        width = len(seen) + 1
        base = (np.append(root[seen], 0) + 1) / (root.sum() + 256)
        states = {(0, 0): 0} | {key: i + 1 for i, key in enumerate(sorted(found))}
        self.child = np.zeros((len(states), width), np.int32)
        p = np.empty((len(states), width))
        p[0] = base
        for (k, ctx), i in states.items():
            if k:
                up = states[k - 1, ctx & ((1 << 8 * (k - 1)) - 1)]
                self.child[up, self.classes[ctx >> 8 * (k - 1)]] = i
                sym, n = found[k, ctx]
                own = np.zeros(width)
                own[self.classes[sym]] = n
                p[i] = (own + len(sym) * p[up]) / (n.sum() + len(sym))
        self.logs = np.log10(p).astype(np.float32)

    def score(self, stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each word, ends included, of the padded texts, in the order of the stream."""
        c = self.classes[stream]
        width = self.child.shape[1]
        flat, logs = self.child.reshape(-1), self.logs.reshape(-1)
        out = np.zeros(len(stream), np.float64)
        state = np.zeros(len(stream) - self.depth, np.int64)
        alive = np.ones(len(state), bool)
        for k in range(1, self.depth + 1):
            longer = flat[state * width + c[self.depth - k : len(c) - k]]
            alive &= longer > 0
            state = np.where(alive, longer, state)
        out[self.depth :] = logs[state * width + c[self.depth :]]
        pads = (offsets[:-1, None] + np.arange(self.depth)).reshape(-1)
        out[pads] = 0
        last = stream == 32
        last[pads] = False
        return np.diff(np.cumsum(out)[last], prepend=0.0)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of the mean of two probabilities given by their logarithms."""
    high = np.maximum(a, b)
    return high + np.log10(0.5 * (10.0 ** (a - high) + 10.0 ** (b - high)))


def score(docs: DataFrame, learn: Column, config: Config = Config()) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(size / (1 << 24)))
    given = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learnt"))
    parts = materialize(spark, counts(given, F.col("learnt"), buckets, config), "counts")
    totals = {r["kind"]: r["n"] for r in parts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    tokens, n_symbols = totals.get(1, 0), totals.get(0, 0)
    merged = materialize(spark, parts.groupBy("bucket").applyInArrow(lambda t: merge(t, {1: config.head_share * tokens}), _PART_SQL), "merged")
    pairs = pair_counts(merged)
    shape = pa.schema([("k", pa.int32()), ("ctx", pa.int64()), ("blob", pa.binary())])

    def keep(table: pa.Table) -> pa.Table:
        return _table(contexts(table["blob"].to_pylist(), n_symbols, pairs, config), shape)

    # the two symbols before a context's next one deal the work, so that no single frequent symbol gathers it
    longer = merged.where("kind = 0").groupBy("bucket").applyInArrow(tb.lean_group(keep), "k int, ctx long, blob binary")
    single = [(1, k, _pack(sym.astype(np.uint8), n)) for k, (sym, n) in pairs.items()]
    # at most 1 / least_share contexts of each length, and 1 / head_share frequent words
    tree = SuffixTree([*single, *(tuple(r) for r in longer.collect())], config.depth)
    words = merged.where("kind = 1").select("n", "blob").collect()
    distinct = sum(r["n"] for r in words)
    head = [_unpack(bytes(r["blob"]), "<u8", "<i8") for r in words] or [[np.zeros(0, _U), np.zeros(0, np.int64)]]
    keys, n = np.concatenate([h[0] for h in head]), np.concatenate([h[1] for h in head])
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((tree, keys[order], np.log10(n[order] + 1.0)))
    scale = math.log10(tokens + distinct + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("doc_id", None), ("learnt", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("bucket", pa.int64()), ("blob", pa.binary())]
    names = [f for f, _ in fields]
    row_sql = f"doc_id {kind}, learnt boolean, row long, n_tokens long, known long, logs double, score double, bucket long, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head_keys, head_logs = shared.value
        for batch in batches:
            buf, offsets = tb.text_bytes(tb.column(batch, "text"))
            doc, learnt, row = (tb.column(batch, c) for c in ("doc_id", "learnt", "row"))
            row_ids, train = row.to_numpy(), learnt.to_numpy(zero_copy_only=False)
            for a, b in tb.slices(offsets, config.block_bytes):
                own, starts, ends, before, hashed = _words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                stream, at = symbols(own, starts, ends, before, config.depth)
                owner = np.repeat(np.arange(b - a), np.diff(before) + 1)
                close = before[1:] + np.arange(b - a)
                words_ = np.ones(len(owner), bool)
                words_[close] = False
                token = np.full(len(owner), END)
                token[words_] = hashed
                hashed, tree_logs = token, model.score(stream, at)
                place = np.minimum(np.searchsorted(head_keys, hashed), max(0, len(head_keys) - 1))
                common = head_keys[place] == hashed if len(head_keys) else np.zeros(len(hashed), bool)
                known = np.bincount(owner[common], minlength=b - a)
                own_logs = head_logs[place[common]] if len(head_keys) else np.zeros(0)
                logs = np.bincount(owner[common], own_logs, minlength=b - a)
                value = np.bincount(owner[common], mixed(tree_logs[common], own_logs - scale), minlength=b - a)
                m = b - a
                yield pa.RecordBatch.from_arrays([doc.slice(a, m), learnt.slice(a, m), row.slice(a, m), pa.array(np.diff(before) + 1), pa.array(known.astype(np.int64)), pa.array(logs.astype(float)), pa.array(value.astype(float)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)
                rest, of, trees = hashed[~common], owner[~common], tree_logs[~common].astype(np.float32)
                sent = []
                for g, part in _by((rest % _U(buckets)).astype(np.int64)):
                    docs_, which = np.unique(of[part], return_inverse=True)
                    sent.append((g, _pack(row_ids[a:b][docs_], train[a:b][docs_], which.astype(np.uint32), rest[part], trees[part])))
                if sent:
                    m = len(sent)
                    empty = [pa.nulls(m, doc.type), *(pa.nulls(m, t) for _, t in fields[1:7])]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array([g for g, _ in sent], pa.int64()), pa.array([x for _, x in sent], pa.binary())], names)

    scored = materialize(spark, given.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tb.lean(run), row_sql), "scored")

    def rare(table: pa.Table) -> pa.Table:
        """Count the other words of a bucket and add up what each text has of them."""
        got = [_unpack(b, "<i8", "?", "<u4", "<u8", "<f4") for b in table["blob"].to_pylist()]
        row, train = (np.concatenate([g[i][g[2]] for g in got]) for i in (0, 1))
        word, trees = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got]).astype(float)
        _, which = np.unique(word, return_inverse=True)
        c = np.bincount(which, train)[which]
        rows, of = np.unique(row, return_inverse=True)
        known = np.bincount(of, c > 0).astype(np.int64)
        own = np.log10(c + 1)
        logs, value = np.bincount(of, own), np.bincount(of, mixed(trees, own - scale))
        out = [(g, _pack(rows[p], known[p], logs[p], value[p])) for g, p in _by(np.mod(tb.mix(rows.view(_U)).view(np.int64), buckets))]
        return _table(out, pa.schema([("to", pa.int64()), ("blob", pa.binary())]))

    def finish(table: pa.Table, more: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        row = table["row"].to_numpy()
        known, logs, value = (table[c].to_numpy().copy() for c in ("known", "logs", "score"))
        order = np.argsort(row)
        for blob in more["blob"].to_pylist():
            r, k, x, v = _unpack(blob, "<i8", "<i8", "<f8", "<f8")
            at = order[np.searchsorted(row[order], r)]
            known[at] += k
            logs[at] += x
            value[at] += v
        base = logs - table["n_tokens"].to_numpy() * scale
        return pa.table([table["doc_id"], table["learnt"], table["n_tokens"], pa.array(known), pa.array(np.full(len(row), tokens, np.int64)), pa.array(base), pa.array(value)], names=["doc_id", "learnt", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sums = scored.where("blob is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(tb.lean_group(rare), "to long, blob binary")
    texts = scored.where("blob is null").select("doc_id", "learnt", "row", "n_tokens", "known", "logs", "score")
    place = prepare_bucket(texts, buckets)
    return place.groupBy("to").cogroup(sums.groupBy("to")).applyInArrow(tb.lean_pair(finish), f"doc_id {kind}, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def prepare_bucket(texts: DataFrame, buckets: int) -> DataFrame:
    """Rows with the bucket in which their sums arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = np.mod(tb.mix(tb.column(batch, "row").to_numpy().view(_U)).view(np.int64), buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], [*batch.schema.names, "to"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(tb.lean(run), f"{fields}, to long")
