"""N-gram Jaccard join by chosen paths: all pairs of different word-shingle sets with a similarity of 0.8 or more.

Documents with equal sets form one class; each set gets a MinHash signature, whose coordinates are the tokens on
which sets are split. A run starts at the root: a node draws one or two coordinates, 1 / threshold on average, and a
set follows the path of its token at each, so that a pair of the threshold's similarity stays together on one path
on average. Nodes of more than ``limit`` sets are split again, small ones are compared by brute force. Runs are repeated
until a pair at the threshold is found with the target recall. A node that is still large at ``depth`` holds copies of one
text: its sets are measured against a pivot, from which the links among the close ones follow (``pivots``); the others
are compared, in blocks, with all of the node. So a class of near copies costs in proportion to its sets.

A pair that meets in several buckets is compared in the first of them only, told by the lists of buckets that its
sets carry, so links are counted without gathering the pairs. Pairs whose signatures agree enough are verified by
the exact intersection of their shingles. A bucket returns counts and a star per connected part, never its pairs.

Words are runs of ASCII letters, digits and all characters beyond ASCII; ASCII letters in lower case. A text of fewer
words than a shingle has one shingle of all its words.

Defined results: null and empty texts, and those without words, have no set, no links and class_id = doc_id. Repeated
rows are in one class. A null doc_id counts as larger than all others; class_id is null if no member has a doc_id. An
empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import pivots
from furlong.llm import textbytes as tb
from furlong.llm.components import components
from furlong.session import materialize, prepare

LETTERS = tb.byte_table("letters")
_U = np.uint64


@dataclass(frozen=True)
class Config:
    """shingle: words of a shingle. threshold: least similarity, as a fraction of whole numbers. recall: of a pair at
    the threshold. signature: coordinates. limit: sets of a bucket that is not split. depth: levels of splits.
    bunch: expected rows of a task's buckets."""

    shingle: int = 5
    threshold: tuple[int, int] = (4, 5)
    recall: float = 0.9995
    signature: int = 64
    limit: int = 300
    depth: int = 3
    bunch: int = 20_000
    seed: int = 3

    def runs(self) -> int:
        """Runs for the recall, if each run splits to the full depth."""
        s = self.threshold[0] / self.threshold[1]
        extra = 1 / s - 1
        stays = 1.0
        for _ in range(self.depth):
            stays = (1 - extra) * s * stays + extra * (1 - (1 - s * stays) ** 2)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - stays))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, ascending in each, and the n+1 offsets of the texts in them."""
    buf = tb.LOWER[buf]
    starts, ends, before = tb.words(buf, offsets, LETTERS)
    word = np.concatenate([tb.span_hashes(tb.prefix_sums(buf), starts, ends), np.zeros(n, _U)])
    count = np.diff(before)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), made)
    at = before[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
    h = np.zeros(len(doc), _U)
    for j in range(n):
        h = (h ^ np.where(at + j < before[doc + 1], word[at + j], _U(0))) * _U(0x9E3779B97F4A7C15) + _U(j + 1)
        h ^= h >> _U(29)
    key = np.unique(doc.astype(_U) << _U(32) | tb.mix(h) >> _U(32))
    return key.astype(np.uint32), np.searchsorted(key, np.arange(len(offsets)).astype(_U) << _U(32))


def _odd(seed: int, n: int) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint64) | _U(1)).astype(np.uint32)


def signatures(values: np.ndarray, offsets: np.ndarray, config: Config) -> np.ndarray:
    """MinHash coordinates of non-empty sets, one row each."""
    a, b = _odd(config.seed, config.signature), _odd(config.seed + 1, config.signature)
    out = np.empty((len(offsets) - 1, config.signature), np.uint32)
    mixed = values ^ values >> np.uint32(15)
    for j in range(config.signature):
        x = mixed * a[j] + b[j]
        x ^= x >> np.uint32(13)
        x *= np.uint32(0x5BD1E995)
        out[:, j] = np.minimum.reduceat(x, offsets[:-1])
    return out


def follow(path: np.ndarray, sig: np.ndarray, root: bool, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their child paths. A root draws the coordinates of all runs, without repeating one."""
    rows, paths = [], []
    n, extra = config.signature, config.threshold[1] / config.threshold[0] - 1
    if root:
        order = np.random.default_rng(config.seed + 2).permutation(n)
        twos = int(np.ceil(config.runs() * extra))
        chosen = order[: config.runs() + twos]
        for j in chosen.tolist():
            rows.append(np.arange(len(sig)))
            paths.append(tb.mix(sig[:, j].astype(_U) * _U(2 * n) + _U(j)))
        return np.concatenate(rows), np.concatenate(paths)
    draw = tb.mix(path)
    one = (draw % _U(n)).astype(np.int64)
    other = (one + 1 + ((draw >> _U(16)) % _U(n - 1)).astype(np.int64)) % n
    also = (draw >> _U(40)).astype(np.float64) / (1 << 24) < extra
    for which, j in ((np.arange(len(sig)), one), (np.flatnonzero(also), other[also])):
        rows.append(which)
        paths.append(tb.mix(path[which] * _U(31) + tb.mix(sig[which, j].astype(_U) * _U(2 * n) + j.astype(_U))))
    return np.concatenate(rows), np.concatenate(paths)


def _matrix(col: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def sets(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, set_id, and once for a set and block of text its signature and shingles."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.text_bytes(tb.column(batch, "text"))
            for a, b in tb.slices(offsets, 1 << 21):
                values, at = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], config.shingle)
                some = np.flatnonzero(np.diff(at))
                ids = np.zeros(b - a, np.int64)
                sig, shingles = [None] * (b - a), [None] * (b - a)
                if len(some):
                    bounds = np.append(at[some], at[-1])
                    s = tb.mix(np.add.reduceat(tb.mix(values.astype(_U) + _U(1)), at[some]) ^ np.diff(bounds).astype(_U))
                    ids[some] = s.view(np.int64)
                    first = np.unique(ids[some], return_index=True)[1]
                    own = some[first]
                    picked = np.concatenate([values[at[i] : at[i + 1]] for i in own.tolist()])
                    lengths = np.diff(at)[own]
                    made = signatures(picked, np.concatenate([[0], np.cumsum(lengths)]), config)
                    for k, i in enumerate(own.tolist()):
                        sig[i], shingles[i] = made[k].tobytes(), values[at[i] : at[i + 1]].tobytes()
                none = np.diff(at) == 0
                yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id").slice(a, b - a), pa.array(ids, mask=none), pa.array(sig, pa.binary()), pa.array(shingles, pa.binary())], ["doc_id", "set_id", "sig", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tb.lean(run), f"doc_id {kind}, set_id long, sig binary, shingles binary")


def leaves(spark, signed: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """bucket, set_id for all buckets of two sets or more, and path, set_id, size of the nodes that stay large."""

    def step(root: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                sig = _matrix(tb.column(batch, "sig"), "<u4", config.signature)
                path = np.zeros(len(sig), _U) if root else tb.column(batch, "path").to_numpy().view(_U)
                rows, child = follow(path, sig, root, config)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), tb.column(batch, "set_id").take(pa.array(rows))], ["path", "set_id"])

        return run

    out, level = [], signed.mapInArrow(tb.lean(step(True)), "path long, set_id long")
    for depth in range(1, config.depth + 1):
        level = materialize(spark, level, "paths")
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        level = materialize(spark, level.join(sizes, "path"), "nodes")
        out.append(level.where(F.col("size") <= config.limit).select(F.col("path").alias("bucket"), "set_id"))
        large = level.where(F.col("size") > config.limit)
        if depth < config.depth:
            level = large.select("path", "set_id").join(signed, "set_id").mapInArrow(tb.lean(step(False)), "path long, set_id long")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found, large


def _pairs(size: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of places within consecutive groups of the given sizes, in parts."""
    end = np.repeat(np.cumsum(size), size)
    count = end - np.arange(len(end)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        left = np.repeat(np.arange(at, stop), count[at:stop])
        yield left, left + 1 + np.arange(len(left)) - np.repeat(total[at:stop] - total[at], count[at:stop])
        at = stop


def propose(table: pa.Table, config: Config) -> pa.Table:
    """The pairs of a bunch of buckets that this bunch owns, whose signatures agree enough and which are not certain."""
    table = table.sort_by([("bucket", "ascending"), ("set_id", "ascending")]).combine_chunks()
    bucket, ids = table["bucket"].to_numpy(), table["set_id"].to_numpy()
    sig = _matrix(table["sig"], "<u4", config.signature).astype(np.uint8)
    lists = table["leaves"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    s, t = config.threshold[0] / config.threshold[1], config.signature
    least = max(1, math.floor(t * s - 4.5 * math.sqrt(t * s * (1 - s))))
    template, far, most = table["template"].to_numpy(), table["far"].to_numpy(), pivots.reach(config.threshold)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    # pairs whose lists are compared at a time: about two million entries
    step = max(1, (1 << 20) // max(1, int(np.diff(at).max(initial=1))))
    found = []
    for x, y in _pairs(np.diff(cuts)):
        near = (sig[x] == sig[y]).sum(axis=1, dtype=np.int16) >= least
        near &= ids[x] != ids[y]
        # certain links are counted already
        near &= (template[x] != template[y]) | (far[x] + far[y] > most)
        x, y = x[near], y[near]
        for a in range(0, len(x), step):
            p, q = x[a : a + step], y[a : a + step]
            # a pair belongs to the least bucket that both are in
            size_p, size_q = at[p + 1] - at[p], at[q + 1] - at[q]
            owner = np.concatenate([np.repeat(np.arange(len(p)), size_p), np.repeat(np.arange(len(p)), size_q)])
            value = flat[np.concatenate([np.repeat(at[p] - np.cumsum(size_p) + size_p, size_p) + np.arange(size_p.sum()), np.repeat(at[q] - np.cumsum(size_q) + size_q, size_q) + np.arange(size_q.sum())])]
            below = value < bucket[p][owner]
            owner, value = owner[below], value[below]
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            twice = owner[1:][(owner[1:] == owner[:-1]) & (value[1:] == value[:-1])]
            mine = np.ones(len(p), bool)
            mine[twice] = False
            found.append((p[mine].astype(np.uint32), q[mine].astype(np.uint32)))
    x, y = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint32) for i in range(2))
    if not len(x):
        return pa.table([[], [], []], schema=_PROPOSED)
    bunch = table["bunch"][0].as_py()
    blob = _packed(bucket, ids, x, y)
    used = np.zeros(len(ids), bool)
    used[x] = used[y] = True
    need = np.unique(ids[used])
    return pa.table([pa.array([bunch] * (len(need) + 1), pa.int64()), pa.array([None, *need.tolist()], pa.int64()), pa.array([blob] + [None] * len(need), pa.binary())], schema=_PROPOSED)


def _packed(bucket: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> bytes:
    """Pairs of rows: the buckets and sets of the rows that occur, then two small row numbers a pair, in order."""
    used = np.zeros(len(ids), bool)
    used[x] = used[y] = True
    place = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
    kind = "<u2" if used.sum() <= 1 << 16 else "<u4"
    return b"".join([np.array([used.sum(), len(x)], "<i8").tobytes(), bucket[used].tobytes(), ids[used].tobytes(), place[x].astype(kind).tobytes(), place[y].astype(kind).tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and sets of the rows, and the two row numbers of each pair, as given to ``_packed``."""
    n, m = np.frombuffer(blob, "<i8", 2).tolist()
    kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
    rows, at = np.frombuffer(blob, "<i8", 2 * n, 16), 16 + 16 * n
    return rows[:n], rows[n:], np.frombuffer(blob, kind, m, at), np.frombuffer(blob, kind, m, at + m * kind.itemsize)


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node of each node's connected part, by the links x, y."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


_PROPOSED = pa.schema([("bunch", pa.int64()), ("set_id", pa.int64()), ("pairs", pa.binary())])
_PROPOSED_SQL = "bunch long, set_id long, pairs binary"
_LINKS = pa.schema([("set_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
_LINKS_SQL = "set_id long, root long, links long"


def _common(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of parts[x] and parts[y]."""
    if len(x) < 3 * len(parts):
        return np.array([len(np.intersect1d(parts[i], parts[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, column, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.cumsum(np.diff(column[order], prepend=column[order][:1]) > 0)
    total = np.zeros((len(parts), len(parts)), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, top, 4096):
        lo, hi = np.searchsorted(column, (a, a + 4096))
        m = np.zeros((len(parts), 4096), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        total += m @ m.T
    return total[x, y].astype(np.int64)


def verify(have: pa.Table, proposed: pa.Table, config: Config) -> pa.Table:
    """Count the links of each set among the proposed pairs, and name the least set of its connected part."""
    blobs = proposed["pairs"].to_pylist()
    if not blobs:
        return pa.table([[], [], []], schema=_LINKS)
    ids, shingles = have["set_id"].to_numpy(), have["shingles"].to_pylist()
    order = np.argsort(ids, kind="stable")
    keys = ids[order]
    values = [np.frombuffer(shingles[i], np.uint32) for i in order.tolist()]
    size = np.array([len(v) for v in values], np.int64)
    links, stars = np.zeros(len(keys), np.int64), []
    top, bottom = config.threshold
    for blob in blobs:
        bucket, sets_, left, right = _unpacked(blob)
        node = np.searchsorted(keys, sets_)
        # rows are in order of their buckets, and pairs in that of their rows; one bucket is handled at a time
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
        cuts = np.searchsorted(left, ends.astype(left.dtype) if ends[-1] <= np.iinfo(left.dtype).max else ends)
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            own, where = np.unique(np.concatenate([left[a:b], right[a:b]]), return_inverse=True)
            if not len(own):
                continue
            own, x, y = node[own], where[: b - a], where[b - a :]
            both = _common([values[i] for i in own.tolist()], x, y)
            linked = (top + bottom) * both >= top * (size[own[x]] + size[own[y]])
            x, y = x[linked], y[linked]
            links[own] += np.bincount(x, minlength=len(own)) + np.bincount(y, minlength=len(own))
            stars.append((own, own[_least(len(own), x, y)]))
    label = _least(len(keys), *(np.concatenate([s[i] for s in stars]) for i in range(2)))
    some = np.flatnonzero(links)
    return pa.table([keys[some], keys[label[some]], links[some]], schema=_LINKS)


def join(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, set_id, class_id (least doc_id of the connected part), n_links (other sets linked to the row's), n_copies
    (rows of the same set) for every row."""
    spark = docs.sparkSession
    held = materialize(spark, sets(docs, config), "sets")
    payload = held.where("shingles is not null")
    signed = materialize(spark, payload.select("set_id", "sig").groupBy("set_id").agg(F.first("sig").alias("sig")), "signatures")
    small, large = leaves(spark, signed, config)
    most = pivots.reach(config.threshold)
    nodes = materialize(spark, pivots.named_nodes(large, signed), "templates")
    far = materialize(spark, pivots.distances(large, nodes, payload), "distances")
    leaf = materialize(spark, small.unionByName(pivots.buckets(large, nodes, far, most, config.limit)), "leaves")
    bunches = max(1, math.ceil(leaf.count() / config.bunch))
    lists = leaf.groupBy("set_id").agg(F.array_sort(F.collect_set("bucket")).alias("leaves")).join(signed, "set_id").join(far, "set_id", "left")
    # a set without a pivot is out of every reach
    lists = lists.withColumns({"template": F.coalesce("template", F.lit(0).cast("long")), "far": F.coalesce("far", F.lit(most + 1))})
    dealt = lists.select("set_id", "sig", "leaves", "template", "far", F.explode("leaves").alias("bucket")).withColumn("bunch", F.pmod(F.xxhash64("bucket"), F.lit(bunches)))
    proposed = materialize(spark, dealt.groupBy("bunch").applyInArrow(tb.lean_group(lambda t: propose(t, config)), _PROPOSED_SQL), "proposed")
    need = proposed.where("set_id is not null").select("bunch", "set_id")
    # what is needed has no fixed bound, so it is not broadcast, whatever its size
    wanted = payload.select("set_id", "shingles").join(need.select("set_id").distinct().hint("merge"), "set_id", "left_semi").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    have = need.join(wanted, "set_id").groupBy("bunch")
    pairs = proposed.where("pairs is not null").select(F.col("bunch").alias("of"), "pairs").groupBy("of")
    links = have.cogroup(pairs).applyInArrow(tb.lean_pair(lambda a, b: verify(a, b, config)), _LINKS_SQL)
    links = materialize(spark, links.unionByName(pivots.certain_links(far, most)), "all-links")
    roots = components(spark, links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    # in the order of the ids' own type, a missing one last
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))
    classes = held.where("set_id is not null").groupBy("set_id").agg(F.min(order).alias("first"), F.count("*").alias("n_copies"))
    placed = classes.join(counts, "set_id", "left").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    placed = materialize(spark, placed, "classes")
    least = placed.groupBy("root").agg(F.min("first")["id"].alias("class_id"))
    table = placed.join(least, "root").select("set_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    rows = held.select("doc_id", "set_id").join(table, "set_id", "left")
    return rows.select(
        "doc_id",
        "set_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
    )
