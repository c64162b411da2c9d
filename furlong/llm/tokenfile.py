"""Token-id files: one concatenated id array and Elias-Fano encoded document boundaries.

A shard is one binary value: a header, the low bits of the document ends, their high bits in unary, samples for
select, and the ids at the least width that holds them. The ends of n documents over u ids take about
n * (2 + log2(u / n)) bits; select over the high bits returns an offset without a table of 64-bit numbers.
Shards are the rows of a Parquet table in the shared folder, so Spark commits them whole and replaces lost ones.

Defined results: a null or empty text has its end id alone. Rows are ordered by doc_id, nulls first, then by text.
Repeated rows are separate documents. An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.llm.tokens import TokenizerSpec, encode_column
from furlong.session import new_path, prepare

MAGIC = b"FURLIDS1"
HEADER = struct.Struct("<8sBBHQQQQ")
EVERY = 256
_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of n numbers up to ``universe``."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(-1)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros((universe >> bits) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::EVERY].astype(np.uint32))

    def select(self, first: int, last: int) -> np.ndarray:
        """Bit positions of the ones first..last-1 of the high part, from the sample before them."""
        if first >= last:
            return np.zeros(0, np.int64)
        begin = int(self.samples[first // EVERY])
        before = first - first // EVERY * EVERY
        # no further than the sample that follows the last one asked for
        after = -(-last // EVERY)
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        counts = np.cumsum(_ONES[self.high[begin // 8 : end]]) - int(_ONES[self.high[begin // 8] & ((1 << begin % 8) - 1)])
        stop = int(np.searchsorted(counts, before + last - first)) + 1
        bits = np.unpackbits(self.high[begin // 8 : begin // 8 + stop], bitorder="little")
        bits[: begin % 8] = 0
        return np.flatnonzero(bits)[before : before + last - first] + begin // 8 * 8

    def get(self, first: int, last: int) -> np.ndarray:
        """The numbers first..last-1."""
        high = self.select(first, last) - np.arange(first, last)
        at = np.arange(first * self.bits, last * self.bits)
        low = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        low = low.reshape(-1, self.bits).astype(np.int64) << np.arange(self.bits) if self.bits else np.zeros((len(high), 1), np.int64)
        return (high << self.bits) + low.sum(axis=1)


def pack_shard(ids: np.ndarray, ends: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    ef = EliasFano.of(ends, len(ids))
    head = HEADER.pack(MAGIC, 4 if wide else 2, ef.bits, len(ef.samples) and EVERY, len(ends), len(ids), len(ef.low), len(ef.high))
    return b"".join([head, ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u4").tobytes(), ids.astype("<u4" if wide else "<u2").tobytes()])


def unpack_shard(blob: bytes) -> tuple[np.ndarray, EliasFano]:
    magic, width, bits, _, n, size, low, high = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token-id shard")
    at = HEADER.size
    lows = np.frombuffer(blob, np.uint8, low, at)
    highs = np.frombuffer(blob, np.uint8, high, at + low)
    count = -(-n // EVERY)
    samples = np.frombuffer(blob, "<u4", count, at + low + high)
    ids = np.frombuffer(blob, f"<u{width}", size, at + low + high + 4 * count)
    return ids, EliasFano(n, bits, lows, highs, samples)


def write(docs: DataFrame, spec: TokenizerSpec, end_id: int, path: str, shard_ids: int = 1 << 20, part_bytes: int = 1 << 24) -> None:
    """Write the shards of all documents in ascending doc_id order. shard_ids: a shard is closed beyond so many ids.
    part_bytes: expected text of a task's range of doc_ids."""
    spark = docs.sparkSession
    prepare(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = done = shard = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(np.concatenate([x[2] for x in held]))
            keys = pa.concat_arrays([x[0] for x in held])
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([done], pa.int64()), pa.array([len(ids)], pa.int64())]
            return pa.RecordBatch.from_arrays([*row, pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([pack_shard(ids, ends)], pa.binary())], ["part", "shard", "before", "n_ids", "doc_ids", "data"])

        part = -1
        for batch in batches:
            doc = tb.column(batch, "doc_id")
            if len(batch) and part < 0:
                part = tb.column(batch, "part")[0].as_py()
            for a, b, ids, at in encode_column(spec, tb.column(batch, "text"), end_id, 1 << 21):
                held.append((doc.slice(a, b - a), ids, np.diff(at)))
                size += len(ids)
                if size >= shard_ids:
                    yield close()
                    held, done, size, shard = [], done + size, 0, shard + 1
        if held:
            yield close()

    kept = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ranged = kept.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    numbered = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))
    numbered.mapInArrow(tb.lean(run), f"part int, shard int, before long, n_ids long, doc_ids array<{kind}>, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    prepare(spark)
    shards = spark.read.parquet(path)
    # one row for each range partition of the writer: their number is a setting and does not grow with the rows
    sizes = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist(), strict=False))
    kind = shards.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, ef = unpack_shard(tb.column(batch, "data")[i].as_py())
                at = np.concatenate([[0], ef.get(0, ef.n)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                start = before[tb.column(batch, "part")[i].as_py()] + tb.column(batch, "before")[i].as_py() + at[:-1]
                yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_ids")[i].values, pa.array(start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "doc_ids", "data").mapInArrow(tb.lean(run), f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, spec: TokenizerSpec, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, spec, end_id, path)
    return read(spark, path)
