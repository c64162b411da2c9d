"""Best-fit packing: documents into sequences of a fixed number of tokens, with as little room left as possible.

A document is its token ids and an end id. Only a document longer than a sequence is cut, into full pieces after
a first piece that takes the remainder, so that just the first piece has to be packed. Pieces are packed by
best-fit decreasing: a segment tree over the remaining capacities finds the tightest open sequence in time
logarithmic in the capacity. The pieces are dealt by a hash to groups of a fixed expected number of sequences and
the groups are packed side by side; each group leaves only its last few sequences part empty, whatever the input's size.

Defined results: a null or empty text is its end id alone. Repeated rows are separate documents. Null doc_ids are
kept. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.llm.tokens import TokenizerSpec, encode_column
from furlong.session import materialize, prepare


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.members: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.members[room].append(sequence)
        self._move(room, 1)

    def take(self, room: int) -> int:
        self._move(room, -1)
        return self.members[room].pop()

    def _move(self, room: int, by: int) -> None:
        node, count = room + self.leaves, self.count
        while node:
            count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of an open sequence that is at least ``need``; -1 without one."""
        node, count = need + self.leaves, self.count
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there."""
    sequence, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = OpenSequences(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            room, at, made = capacity, made, made + 1
        else:
            at = tree.take(room)
        sequence[i], place[i] = at, capacity - room
        if room > need:
            tree.add(room - need, at)
    return sequence, place


def pieces(docs: DataFrame, spec: TokenizerSpec, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a number of the row, for every piece of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = tb.column(batch, "row")
            doc = tb.column(batch, "doc_id")
            for a, b, ids, at in encode_column(spec, tb.column(batch, "text"), end_id):
                size = np.diff(at)
                count = -(-size // capacity)
                owner = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                head = size - (count - 1) * capacity
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[owner], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                first = 4 * (at[owner] + start)
                crc = [zlib.crc32(raw[x : x + n]) for x, n in zip(first.tolist(), (4 * length).tolist(), strict=True)]
                own = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [doc.take(own), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), row.take(own)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "row"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return kept.mapInArrow(tb.lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")


def pack(docs: DataFrame, spec: TokenizerSpec, end_id: int = 0, capacity: int = 2048, group_sequences: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    group_sequences: expected sequences of a group; a group is one task's work.
    """
    spark = docs.sparkSession
    cut = materialize(spark, pieces(docs, spec, end_id, capacity), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (capacity * group_sequences)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")]).combine_chunks()
        length = table["length"].to_numpy()
        part = length < capacity
        sequence, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        sequence[part], place[part] = best_fit_decreasing(length[part], capacity)
        made = int(sequence[part].max()) + 1 if part.any() else 0
        sequence[~part] = made + np.arange((~part).sum())
        sequence += table["bunch"].to_numpy().astype(np.int64) << 36
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(place))

    dealt = cut.withColumn("bunch", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("bunch").applyInArrow(tb.lean_group(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
