"""Suffix-array deduplication: bytes covered by a long string that an earlier document has as well.

A string of ``length`` bytes repeats if it also starts in a document with a smaller doc_id. All bytes that such
strings cover in the input go, and what is left is concatenated.

Suffixes are dealt to tasks by their anchors: the least hash among the 16-byte strings of a window of ``length``
bytes. Equal windows have equal anchors at the same place, so all suffixes that can share ``length`` bytes meet.
Consecutive windows with one anchor form a zone, and the windows of equal zones are equal one by one.

The texts are first written as blocks of whole documents. A block sends its zones' hashes, equal zones once; zones
whose anchor and the bytes on one side of it occur under two doc_ids are asked for, and only their texts travel.
Hashes choose what is compared and decide nothing: a bucket of anchors sorts the strings of its zones by the
deep-shallow method (multikey quicksort over eight-byte symbols to a shallow depth, then a blind trie for each group
that still has a common prefix), so that equal zones stand together, and then the windows of those zones of an anchor
that differ. Each block is told the least doc_id that has each of its windows, and cuts its documents.

A passage costs its bucket one row for each block that has it, however often a block has it. Nothing is collected.

Defined results: a null text is empty. Ids of any type count in the order of their type, a null doc_id after all others. Rows with equal doc_id do not
repeat each other; fully equal rows get equal results. Texts shorter than ``length`` are kept. An empty table gives
an empty result. All further columns are passed through; one that has the name of a result is replaced by it, for
which ``prefix`` gives the results other names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from furlong.llm import textbytes as tb
from furlong.llm.rowkey import with_order
from furlong.session import materialize, prepare

GRAM = 16
_U = np.uint64


@dataclass(frozen=True)
class Config:
    """length: bytes of a repeated string. shallow: depth of the multikey quicksort. block_bytes: text of a block.
    bucket_bytes: expected text whose anchors make up one bucket. part: places, or windows, that are worked on at a
    time; it bounds the working arrays and changes no result."""

    length: int = 50
    shallow: int = 32
    block_bytes: int = 1 << 23
    bucket_bytes: int = 1 << 24
    part: int = 1 << 18


# ---- sorting


class BlindTrie:
    """Orders byte strings of one length; inner nodes hold only the depth at which their children differ. A leaf holds
    all equal strings."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, text: bytes, number: int) -> None:
        if self.root is None:
            self.root = [None, text, [number]]
            return
        # down without comparing, to some leaf that shares all that the inner nodes leave open
        node = self.root
        while node[0] is not None:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == text:
            node[2].append(number)
            return
        depth = next(i for i, (a, b) in enumerate(zip(text, other, strict=True)) if a != b)
        leaf, node = [None, text, [number]], self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][text[node[0]]]
        if node[0] == depth:
            node[1][text[depth]] = leaf
        else:
            below = node.copy()
            node[:] = [depth, {other[depth]: below, text[depth]: leaf}]

    def ordered(self) -> Iterator[list[int]]:
        """The numbers of equal strings, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def multikey_quicksort(symbols: np.ndarray, order: np.ndarray, first: np.ndarray, depth: int) -> None:
    """Sort the rows of ``symbols`` named by ``order`` within their groups, by the first ``depth`` symbols, in place.

    first: marks where groups begin; afterwards, where rows begin that differ in these symbols. All groups take
    a step at a time: each is split in three by its middle row's symbol, the equal part goes on to the next symbol.
    """
    n = len(order)
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)
    level = np.zeros(len(begin), np.int64)
    while True:
        open_ = (end - begin > 1) & (level < depth)
        begin, end, level = begin[open_], end[open_], level[open_]
        if not len(begin):
            return
        size = end - begin
        start = np.cumsum(size) - size
        group = np.repeat(np.arange(len(begin)), size)
        place = np.arange(len(group)) + (begin - start)[group]
        own = order[place]
        key = symbols[own, level[group]]
        pivot = key[start + size // 2][group]
        less, more = key < pivot, key > pivot
        rank = []
        counts = []
        for side in (less, ~(less | more), more):
            seen = np.cumsum(side)
            before = seen[start] - side[start]
            rank.append(seen - 1 - before[group])
            counts.append(seen[end - begin + start - 1] - before)
        a, b = counts[0], counts[0] + counts[1]
        to = np.where(less, rank[0], np.where(more, rank[2] + b[group], rank[1] + a[group])) + begin[group]
        order[to] = own
        first[begin[a > 0] + a[a > 0]] = True
        last = counts[2] > 0
        first[begin[last] + b[last]] = True
        begin, end, level = np.concatenate([begin, begin + a, begin + b]), np.concatenate([begin + a, begin + b, end]), np.concatenate([level, level + 1, level])


def deep_shallow(symbols: np.ndarray, first: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``symbols`` (big-endian eight-byte numbers) within their groups, and where rows begin
    that differ from the one before. ``shallow``: symbols that the multikey quicksort goes down to."""
    n, width = symbols.shape
    order, first = np.arange(n), first.copy()
    if not n:
        return order, first
    shallow = min(shallow, width)
    multikey_quicksort(symbols, order, first, shallow)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    # a group whose rows are all like its first one is in order
    head = np.repeat(order[begin], size)
    unlike = np.zeros(n, bool)
    for k in range(shallow, width):
        unlike |= symbols[order, k] != symbols[head, k]
    for g in np.flatnonzero(np.logical_or.reduceat(unlike, begin)).tolist():
        a, b = int(begin[g]), int(begin[g] + size[g])
        rows = order[a:b]
        tails = symbols[rows, shallow:].astype(">u8").tobytes()
        step = 8 * (width - shallow)
        trie = BlindTrie()
        for i in range(b - a):
            trie.add(tails[i * step : (i + 1) * step], i)
        at, sorted_ = a, []
        for same in trie.ordered():
            first[at] = True
            at += len(same)
            sorted_ += same
        order[a:b] = rows[sorted_]
    return order, first


def strings(buf: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """buf[start : start + size] as rows of big-endian symbols, filled up with zeros to ``width`` bytes."""
    out = np.zeros((len(start), width), np.uint8)
    row = np.repeat(np.arange(len(start)), size)
    within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, within] = buf[start[row] + within]
    return out.view(">u8").astype(_U)


# ---- zones


@dataclass
class Zones:
    """start: of the first window, in the block. anchor: its distance from there. key: hash of all bytes. left, right:
    hashes of the bytes beside the anchor, 0 where the zone has no window with them. rep: the block's first zone
    with the same bytes."""

    start: np.ndarray
    size: np.ndarray  # windows
    anchor: np.ndarray
    h: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    rep: np.ndarray


def _part(buf: np.ndarray, offsets: np.ndarray, w0: int, w1: int, length: int) -> list[np.ndarray] | None:
    """Zones of the windows that start at w0..w1-1."""
    lo, hi = np.searchsorted(offsets, w0, side="right") - 1, np.searchsorted(offsets, w1)
    ends = offsets[lo + 1 : hi + 1]
    a = np.clip(np.maximum(ends - (length - 1), offsets[lo:hi]), w0, w1) - w0
    b = np.clip(ends, w0, w1) - w0
    mark = np.zeros(w1 - w0 + 1, np.int32)
    np.add.at(mark, a, 1)
    np.add.at(mark, b, -1)
    at = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int32) == 0)
    if not len(at):
        return None
    piece = np.concatenate([buf[w0 : w1 + length], np.zeros(2 * length + GRAM, np.uint8)])
    n = w1 - w0 + length - GRAM
    word = np.ndarray((n + 8,), "<u8", buffer=piece, strides=(1,)).astype(_U)
    h = word[:n] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h += word[8:] * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    del word
    least = (h & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least[at] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    start, anchor = at[begin], anchor[begin]
    half = (length - GRAM + 1) // 2
    sums = tb.prefix_sums(piece)
    sides = []
    for has, x in ((start <= anchor - half, anchor - half), (start + size - 1 + length >= anchor + GRAM + half, anchor + GRAM)):
        x = np.where(has, x, 0)
        sides.append(np.where(has, tb.span_hashes(sums, x, x + half) % _U(65535) + _U(1), _U(0)).astype(np.uint16))
    whole = tb.span_hashes(sums, start, start + size + length - 1)
    return [start + w0, size, anchor - start, tb.mix(h[anchor]), *sides, whole]


def zones(buf: np.ndarray, offsets: np.ndarray, config: Config) -> Zones:
    """The zones of all texts of a block."""
    parts = [p for w in range(0, len(buf), config.part) if (p := _part(buf, offsets, w, min(len(buf), w + config.part), config.length))]
    if not parts:
        none = np.zeros(0, np.int64)
        return Zones(none, none, none, none.view(_U), none.astype(np.uint16), none.astype(np.uint16), none, none)
    start, size, anchor, h, left, right, whole = (np.concatenate([p[i] for p in parts]) for i in range(7))
    _, head, which = np.unique(whole, return_index=True, return_inverse=True)
    rep = head[which]
    # a hash names a candidate, the bytes decide
    copies = np.flatnonzero(rep != np.arange(len(rep)))
    for a in range(0, len(copies), 1 << 15):
        own = copies[a : a + (1 << 15)]
        of = rep[own]
        same = size[own] == size[of]
        span = np.where(same, size[own] + config.length - 1, 0)
        row = np.repeat(np.arange(len(own)), span)
        within = np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span)
        same[row[buf[start[own][row] + within] != buf[start[of][row] + within]]] = False
        rep[own[~same]] = own[~same]
    return Zones(start, size, anchor, h, left, right, np.searchsorted(offsets, start, side="right") - 1, rep)


def first_and_last(z: Zones, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The zones that stand for themselves, and the least and largest doc_id of those like each."""
    by = np.argsort(z.rep, kind="stable")
    rep = z.rep[by]
    head = np.flatnonzero(np.append(True, rep[1:] != rep[:-1])) if len(rep) else np.zeros(0, np.int64)
    own = order[z.doc[by]]
    return rep[head], np.minimum.reduceat(own, head) if len(head) else own, np.maximum.reduceat(own, head) if len(head) else own


# ---- packed rows


def _pack(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, all first bytes, then all second ones, compressed."""
    planes = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(x) for x in arrays], "<u4").tobytes(), *planes]))


def _unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    counts = np.frombuffer(raw, "<u4", len(kinds))
    at, out = 4 * len(kinds), []
    for n, kind in zip(counts.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def _ids(*orders: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct doc_ids and each array as places among them."""
    known, where = np.unique(np.concatenate(orders), return_inverse=True)
    kind = "<u2" if len(known) <= 1 << 16 else "<u4"
    return known, np.split(where.astype(kind).astype("<u4"), np.cumsum([len(o) for o in orders])[:-1])


#: distinct doc_ids, and for each zone: number, anchor hash in two parts, sides, places of its least and largest doc_id
ZONE_KINDS = ("<i8", "<u4", "<u4", "u1", "<u2", "<u2", "<u4", "<u4")
#: as above, with the anchor's place, the number of windows and all bytes in place of the sides
TEXT_KINDS = ("<i8", "<u4", "<u4", "u1", "u1", "u1", "<u4", "<u4", "u1")
#: distinct doc_ids, and for each run of windows: zone, first window, windows, place of the doc_id
SPAN_KINDS = ("<i8", "<u4", "u1", "u1", "<u4")

_ROWS = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
_ROWS_SQL = "to long, block long, data binary"


def _table(rows: list) -> pa.Table:
    return pa.table([list(c) for c in zip(*rows, strict=True)] or [[], [], []], schema=_ROWS)


def _by(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(groups[part[0]]), part


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _block(data: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    batch = unpack_batch(data)
    buf, offsets = tb.text_bytes(tb.column(batch, "text"))
    return batch, buf, offsets, tb.column(batch, "__sd_order").to_numpy()


# ---- tasks


def send_zones(data: bytes, block: int, n: int, config: Config) -> list:
    """A row for each bucket: the hashes of the block's zones."""
    _, buf, offsets, order = _block(data)
    z = zones(buf, offsets, config)
    rep, low, high = first_and_last(z, order)
    rows = []
    for g, p in _by(((z.h[rep] >> _U(40)) % _U(n)).astype(np.int64)):
        known, (a, b) = _ids(low[p], high[p])
        h = z.h[rep[p]]
        rows.append((g, block, _pack(known, rep[p].astype(np.uint32), h.astype(np.uint32), (h >> _U(32)).astype(np.uint8), z.left[rep[p]], z.right[rep[p]], a, b)))
    return rows


def match_zones(blocks: list[int], blobs: list[bytes]) -> list:
    """In a bucket of anchors: the zones of each block that can share a window with another doc_id."""
    got = [_unpack(b, ZONE_KINDS) for b in blobs]
    size = [len(g[1]) for g in got]
    h = np.concatenate([g[2].astype(_U) | g[3].astype(_U) << _U(32) for g in got])
    low, high = (np.concatenate([g[0][g[k]] for g in got]) for k in (6, 7))
    asked = np.zeros(len(h), bool)
    for k in (4, 5):
        side = np.concatenate([g[k] for g in got])
        some = np.flatnonzero(side)
        key = h[some] << _U(16) | side[some].astype(_U)
        by = np.argsort(key)
        some, key = some[by], key[by]
        if len(key):
            new = np.append(True, key[1:] != key[:-1])
            head = np.flatnonzero(new)
            two = np.minimum.reduceat(low[some], head) < np.maximum.reduceat(high[some], head)
            asked[some[two[np.cumsum(new) - 1]]] = True
    rows = []
    for g, block, mine in zip(got, blocks, np.split(asked, np.cumsum(size)[:-1]), strict=True):
        if mine.any():
            rows.append((0, block, _pack(g[1][mine])))
    return rows


def send_texts(data: bytes, block: int, asks: list[bytes], n: int, config: Config) -> list:
    """A row for each bucket: the strings of the zones that are asked for."""
    _, buf, offsets, order = _block(data)
    z = zones(buf, offsets, config)
    rep, low, high = first_and_last(z, order)
    p = np.searchsorted(rep, np.sort(np.concatenate([_unpack(a, ("<u4",))[0] for a in asks])))
    rows = []
    for g, part in _by(((z.h[rep[p]] >> _U(40)) % _U(n)).astype(np.int64)):
        q = p[part]
        r = rep[q]
        known, (a, b) = _ids(low[q], high[q])
        span = z.size[r] + config.length - 1
        index = np.repeat(z.start[r] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        h = z.h[r]
        rows.append((g, block, _pack(known, r.astype(np.uint32), h.astype(np.uint32), (h >> _U(32)).astype(np.uint8), z.anchor[r].astype(np.uint8), z.size[r].astype(np.uint8), a, b, buf[index])))
    return rows


def match_strings(blocks: list[int], blobs: list[bytes], config: Config) -> list:
    """In a bucket of anchors: sort the zones' strings, then the windows of those that differ; tell each block the least
    doc_id of its windows."""
    got = [_unpack(b, TEXT_KINDS) for b in blobs]
    number = np.concatenate([g[1] for g in got])
    of = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
    h = np.concatenate([g[2].astype(_U) | g[3].astype(_U) << _U(32) for g in got])
    anchor, size = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (4, 5))
    low, high = (np.concatenate([g[0][g[k]] for g in got]) for k in (6, 7))
    text = np.concatenate([g[8] for g in got])
    del got
    span = size + config.length - 1
    start = np.cumsum(span) - span
    n, widest = len(h), 8 * -(-(2 * config.length - GRAM) // 8)
    # equal zones: the same anchor at the same place, as many windows, and equal strings
    by = np.lexsort((size, anchor, h))
    first = np.append(True, (h[by][1:] != h[by][:-1]) | (anchor[by][1:] != anchor[by][:-1]) | (size[by][1:] != size[by][:-1]))
    order, new = np.empty(n, np.int64), np.empty(n, bool)
    for a, b in _cuts(first, config.part >> 3):
        o, f = deep_shallow(strings(text, start[by[a:b]], span[by[a:b]], widest), first[a:b], config.shallow // 8)
        order[a:b], new[a:b] = by[a:b][o], f
    head = np.flatnonzero(new)
    kind = np.cumsum(new) - 1
    least = np.minimum.reduceat(low[order], head)
    hit = high[order] > least[kind]
    found = [(order[hit], np.zeros(hit.sum(), np.int64), size[order[hit]], least[kind[hit]])]
    # zones that differ: one of each kind, of the anchors that have two
    one = order[head]
    same = np.append(False, h[one][1:] == h[one][:-1])
    some = np.flatnonzero(same | np.append(same[1:], False))
    if len(some):
        one, ahead = one[some], least[some]
        zone = np.repeat(np.arange(len(some)), size[one])
        window = np.arange(len(zone)) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
        group = np.cumsum(np.append(True, h[one][1:] != h[one][:-1]))
        key = group[zone] << 8 | (anchor[one][zone] - window + 128)
        by = np.argsort(key, kind="stable")
        zone, window, key = zone[by], window[by], key[by]
        least_of = np.empty(len(zone), np.int64)
        width = 8 * -(-config.length // 8)
        for a, b in _cuts(np.append(True, key[1:] != key[:-1]), config.part >> 2):
            z, w = zone[a:b], window[a:b]
            first = np.append(True, key[a + 1 : b] != key[a : b - 1])
            o, f = deep_shallow(strings(text, start[one[z]] + w, np.full(b - a, config.length), width), first, config.shallow // 8)
            least_of[a + o] = np.minimum.reduceat(ahead[z[o]], np.flatnonzero(f))[np.cumsum(f) - 1]
        earlier = least_of < ahead[zone]
        zone, window, least_of = zone[earlier], window[earlier], least_of[earlier]
        by = np.lexsort((window, zone))
        zone, window, least_of = zone[by], window[by], least_of[by]
        run = np.flatnonzero(np.append(True, (zone[1:] != zone[:-1]) | (window[1:] != window[:-1] + 1) | (least_of[1:] != least_of[:-1]))) if len(zone) else np.zeros(0, np.int64)
        count = np.diff(np.append(run, len(zone)))
        zone, window, least_of = zone[run], window[run], least_of[run]
        # all zones of the kind are told
        rows = np.diff(np.append(head, n))[some[zone]]
        member = order[np.repeat(head[some[zone]] - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())]
        found.append((member, np.repeat(window, rows), np.repeat(count, rows), np.repeat(least_of, rows)))
    member, window, count, least_of = (np.concatenate([f[i] for f in found]) for i in range(4))
    rows_ = []
    for g, p in _by(of[member]):
        known, (ids,) = _ids(least_of[p])
        rows_.append((0, blocks[g], _pack(known, number[member[p]], window[p].astype(np.uint8), count[p].astype(np.uint8), ids)))
    return rows_


def _cuts(first: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` rows that end with a group."""
    head = np.append(np.flatnonzero(first), len(first))
    at = 0
    while at < len(head) - 1:
        stop = max(at + 1, int(np.searchsorted(head, head[at] + size, side="right")) - 1)
        yield int(head[at]), int(head[stop])
        at = stop


def covered(buf: np.ndarray, offsets: np.ndarray, order: np.ndarray, told: list[bytes], config: Config) -> np.ndarray:
    """Which bytes of a block go."""
    if not told:
        return np.zeros(len(buf), bool)
    z = zones(buf, offsets, config)
    by = np.argsort(z.rep, kind="stable")
    rep = z.rep[by]
    mark = np.zeros(len(buf) + 1, np.int32)
    for blob in told:
        known, number, window, count, place = _unpack(blob, SPAN_KINDS)
        lo, hi = np.searchsorted(rep, number), np.searchsorted(rep, number, side="right")
        rows = hi - lo
        zone = by[np.repeat(lo - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())]
        own = np.repeat(np.arange(len(number)), rows)
        goes = known[place][own] < order[z.doc[zone]]
        zone, own = zone[goes], own[goes]
        begin = z.start[zone] + window[own]
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + count[own] + config.length - 1, -1)
    return np.cumsum(mark[:-1], dtype=np.int32) > 0


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def cut(batch: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, gone: np.ndarray, result: str) -> list[pa.Array]:
    """n_bytes, n_removed, n_spans and the result of each document."""
    removed = _before(gone)[offsets]
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    edge[begin] = gone[begin]
    spans = _before(edge)[offsets]
    left = buf[~gone].tobytes()
    del edge
    at = (offsets - removed).tolist()
    if result == "kept_sha256":
        last = pa.array([hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
    elif result == "kept":
        last = pa.array([left[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    else:
        # a cut can split a character; what is left of it goes
        last = pa.array([left[a:b].decode("utf-8", "ignore") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
    return [pa.array(np.diff(offsets)), pa.array(np.diff(removed).astype(np.int64)), pa.array(np.diff(spans).astype(np.int64)), last]


def repeats(docs: DataFrame, result: str = "kept", prefix: str = "", config: Config = Config()) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans and what is left: as ``kept`` (binary), ``kept_text`` (without
    characters that a cut has split) or ``kept_sha256``; with the last, ``text`` is left out."""
    spark = docs.sparkSession
    prepare(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // config.bucket_bytes))
    names = [prefix + x for x in ("n_bytes", "n_removed", "n_spans", result)]
    given = [c for c in docs.columns if c not in names]
    made = with_order(docs, "__sd_order")

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = tb.text_bytes(tb.column(batch, "text"))
            for a, b in tb.slices(offsets, config.block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack_batch(batch.slice(a, b - a))], pa.binary())], ["block", "data"])
                number += 1

    def zone_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from _table(send_zones(batch["data"][i].as_py(), batch["block"][i].as_py(), n, config)).to_batches()

    def ask(table: pa.Table) -> pa.Table:
        return _table(match_zones(table["block"].to_pylist(), table["data"].to_pylist()))

    def answer(blocks: pa.Table, asks: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return _table([])
        return _table(send_texts(blocks["data"][0].as_py(), blocks["block"][0].as_py(), asks["data"].to_pylist(), n, config))

    def sort(table: pa.Table) -> pa.Table:
        return _table(match_strings(table["block"].to_pylist(), table["data"].to_pylist(), config))

    keep = [c for c in given if not (result == "kept_sha256" and c == "text")]
    out = StructType([*(docs.schema[c] for c in keep), *(StructField(x, k) for x, k in zip(names, [LongType(), LongType(), LongType(), BinaryType() if result == "kept" else StringType()], strict=True))])
    shape = to_arrow_schema(out)

    def settle(blocks: pa.Table, told: pa.Table) -> pa.Table:
        batch, buf, offsets, order = _block(blocks["data"][0].as_py())
        gone = covered(buf, offsets, order, told["data"].to_pylist(), config)
        return pa.table([*(tb.column(batch, c) for c in keep), *cut(batch, buf, offsets, gone, result)], names=[*keep, *names]).cast(shape)

    blocks = materialize(spark, made.mapInArrow(tb.lean(block_rows), "block long, data binary"), "blocks")
    hashed = blocks.mapInArrow(tb.lean(zone_rows), _ROWS_SQL)
    asks = hashed.groupBy("to").applyInArrow(tb.lean_group(ask), _ROWS_SQL)
    texts = blocks.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(tb.lean_pair(answer), _ROWS_SQL)
    told = texts.groupBy("to").applyInArrow(tb.lean_group(sort), _ROWS_SQL)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tb.lean_pair(settle), out)
