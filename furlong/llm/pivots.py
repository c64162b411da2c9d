"""Links of near copies by the triangle inequality, without comparing them pair by pair.

The Jaccard distance is a metric. Sets of one template, which have distances x and y from a common pivot, are linked for
certain if x + y is at most the distance of the threshold. The pivot is the set of the shingles that are held by more than
half as many sets of the template as its largest node has; it need not be a document. Distances are rounded up to whole units, so a link that is called
certain is one. How many certain links a set has follows from the counts of its template's sets by distance, of which
there are no more than units. All other pairs are left to the comparison of buckets.

A node of the join that stays large names its template by the most frequent values of its sets' first coordinates, so
the nodes in which the copies of one text meet name the same. A template that fits its sets badly costs comparisons, not
links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.session import materialize

#: Units of the distance 1.
UNITS = 10_000
#: Coordinates that name a template.
COORDINATES = 16
#: Sets of a template that share a copy of its pivot.
TOGETHER = 4096
#: Shingles that are held before they are counted.
HELD = 1 << 22


def reach(threshold: tuple[int, int]) -> int:
    """The largest distance of a link, in units."""
    return UNITS * (threshold[1] - threshold[0]) // threshold[1]


def named_nodes(large: DataFrame, signed: DataFrame) -> DataFrame:
    """path, template for the nodes of large (path, set_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(tb.column(batch, "sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
            rows = np.empty(sig.size, [("path", "<i8"), ("place", "<i4"), ("value", "<u4")])
            rows["path"] = np.repeat(tb.column(batch, "path").to_numpy(), COORDINATES)
            rows["place"] = np.tile(np.arange(COORDINATES), len(sig))
            rows["value"] = sig.reshape(-1)
            rows, n = np.unique(rows, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows["path"].copy()), pa.array(rows["place"].copy()), pa.array(rows["value"].astype(np.int64)), pa.array(n)], ["path", "place", "value", "n"])

    first = signed.select("set_id", F.substring("sig", 1, 4 * COORDINATES).alias("sig"))
    counted = large.select("path", "set_id").join(first, "set_id").select("path", "sig").mapInArrow(tb.lean(run), "path long, place int, value long, n long")
    most = counted.groupBy("path", "place", "value").agg(F.sum("n").alias("n")).groupBy("path", "place").agg(F.max(F.struct("n", "value"))["value"].alias("value"))
    return most.groupBy("path").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("place", "value")))).alias("template"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[tuple[int, int], np.ndarray]] = []
    size = 0

    def close() -> pa.RecordBatch:
        names, which = np.unique(np.array([t for t, _ in held], np.int64), axis=0, return_inverse=True)
        key = np.repeat(which.reshape(-1).astype(np.uint64), [len(v) for _, v in held]) << np.uint64(32) | np.concatenate([v for _, v in held])
        key, n = np.unique(key, return_counts=True)
        name = names[(key >> np.uint64(32)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(name[:, 0].copy()), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n), pa.array(name[:, 1].copy())], ["template", "shingle", "n", "size"])

    for batch in batches:
        names = zip(tb.column(batch, "template").to_pylist(), tb.column(batch, "size").to_pylist(), strict=True)
        for name, raw in zip(names, tb.column(batch, "shingles").to_pylist(), strict=True):
            held.append((name, np.frombuffer(raw, np.uint32)))
            size += len(raw) // 4
            if size >= HELD:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = []
        for raw, pivot in zip(tb.column(batch, "shingles").to_pylist(), tb.column(batch, "pivot").to_pylist(), strict=True):
            a, b = np.frombuffer(raw, np.uint32), np.frombuffer(pivot, "<u4")
            both = len(np.intersect1d(a, b, assume_unique=True))
            whole = len(a) + len(b) - both
            far.append(-(-UNITS * (whole - both) // whole))
        yield pa.RecordBatch.from_arrays([tb.column(batch, "set_id"), tb.column(batch, "template"), pa.array(far, pa.int32())], ["set_id", "template", "far"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pivots = [np.array(sorted(x), np.uint32).tobytes() for x in tb.column(batch, "shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([tb.column(batch, "template"), tb.column(batch, "size"), pa.array(pivots, pa.binary())], ["template", "size", "pivot"])


def distances(large: DataFrame, nodes: DataFrame, payload: DataFrame) -> DataFrame:
    """set_id, template, far (units from the template's pivot) of the sets of large (path, set_id, size).

    A set takes the template of its largest node; tasks measure about TOGETHER sets. payload: set_id, shingles, repeated rows allowed.
    """
    spark = large.sparkSession
    largest = F.max(F.struct("size", "template"))
    own = large.join(nodes, "path").groupBy("set_id").agg(largest["template"].alias("template"), largest["size"].alias("size"))
    texts = payload.select("set_id", "shingles").join(own.hint("merge"), "set_id")
    members = materialize(spark, texts.groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("template", "size", "shingles"))), "members")
    # a shingle is told by the size of its sets' largest node, so that no template's shingles meet in one task
    seen = members.select("template", "size", "shingles").mapInArrow(tb.lean(_counts), "template long, shingle long, n long, size long")
    held = seen.groupBy("template", "shingle").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    common = held.where(F.col("n") * 2 > F.col("size")).groupBy("template").agg(F.collect_list("shingle").alias("shingles"))
    sizes = members.groupBy("template").agg(F.max("size").alias("size"))
    pivots = common.join(sizes, "template").select("template", "size", "shingles").mapInArrow(tb.lean(_joined), "template long, size long, pivot binary")
    parts = (F.col("size") / TOGETHER).cast("int")
    copies = pivots.select("template", F.explode(F.sequence(F.lit(0), parts)).alias("salt"), "pivot")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("set_id"), parts + 1).cast("int"))
    measured = dealt.join(copies.hint("merge"), ["template", "salt"]).select("set_id", "template", "shingles", "pivot")
    return measured.mapInArrow(tb.lean(_measured), "set_id long, template long, far int")


def certain_links(far: DataFrame, most: int) -> DataFrame:
    """set_id, root (a set that it is linked to, or itself), links (certain ones) of the sets that have such."""
    counts = far.where(F.col("far") <= most).groupBy("template", "far").agg(F.count("*").alias("n"), F.min("set_id").alias("set_id"))
    # one entry for each distance within reach
    spread = counts.groupBy("template").agg(F.collect_list(F.struct("far", "n")).alias("spread"), F.min(F.struct("far", "set_id"))["set_id"].alias("root"))
    within = F.filter("spread", lambda x: x["far"] + F.col("far") <= most)
    number = F.aggregate(within, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]) - F.when(F.col("far") * 2 <= most, 1).otherwise(0)
    table = counts.select("template", "far").join(spread, "template").select("template", "far", "root", number.alias("links"))
    return far.join(table, ["template", "far"]).where("links > 0").select("set_id", "root", "links")


def buckets(large: DataFrame, nodes: DataFrame, far: DataFrame, most: int, limit: int) -> DataFrame:
    """bucket, set_id: the pairs of each large node that are not certain by themselves, in blocks of about limit sets.

    Sets within half the reach of the node's own pivot are linked with each other; the rest is dealt with them and with
    itself.
    """
    core = F.coalesce((F.col("template") == F.col("own")) & (F.col("far") * 2 <= most), F.lit(False))
    own = nodes.withColumnRenamed("template", "own")
    placed = materialize(large.sparkSession, large.join(own, "path").join(far, "set_id", "left").select("path", "set_id", core.alias("core")), "placed")
    number = placed.groupBy("path").agg(F.ceil(F.sum(F.col("core").cast("long")) / limit).cast("int").alias("cores"), F.ceil(F.sum((~F.col("core")).cast("long")) / limit).cast("int").alias("rests"))
    dealt = placed.join(number.where("rests > 0"), "path").withColumn("mine", F.pmod(F.xxhash64("set_id"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests"))).cast("int"))

    def over(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")

    rest = dealt.where(~F.col("core"))
    among = rest.select("path", "set_id", "mine", over("rests")).select(F.xxhash64("path", F.lit(0), F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "set_id")
    across = rest.where("cores > 0").select("path", "set_id", "mine", over("cores")).select(F.xxhash64("path", F.lit(1), "mine", "other").alias("bucket"), "set_id")
    cores = dealt.where("core").select("path", "set_id", "mine", over("rests")).select(F.xxhash64("path", F.lit(1), "other", "mine").alias("bucket"), "set_id")
    return among.unionByName(across).unionByName(cores)
