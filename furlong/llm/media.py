"""Media columns: MPEG transport streams as binary values.

A payload is cut into access units, each goes into one packetized elementary stream (PES) packet with a
presentation time, and these are carried in 188-byte transport packets after the program tables. Reading parses
the program association and map tables with their checksums, checks the continuity counters of every PID,
reassembles the PES packets and returns payload, timestamps and random-access points.

Defined results: a null text is empty and has a payload of 64 zero bytes. Equal texts have equal values. Repeated
rows and null doc_ids are kept, an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furlong.llm import textbytes as tb
from furlong.session import materialize, prepare

# Fixed values of the transport stream format and of the streams written here.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
PMT_PID = 0x1000
MEDIA_PID = 0x100
NULL_PID = 0x1FFF
STREAM_TYPE = 0x06
STREAM_ID = 0xBD
CLOCK = 90_000
UNIT_BYTES = 16_384
UNIT_TICKS = 3_600
KEY_UNITS = 4


def _crc_table() -> list[int]:
    table = []
    for x in range(256):
        c = x << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of program tables: 0 over a section with its checksum."""
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _table_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    section = bytes([table, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, 0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])) + _table_packet(
    PMT_PID, 2, 1, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0])
)


def _time(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(k * UNIT_TICKS) + unit
        key = k % KEY_UNITS == 0
        # the first packet has the clock or just the flags in its adaptation field, the last is filled up there
        clock = (k * UNIT_TICKS << 15 | 0x7E00).to_bytes(6, "big") if key else b""
        front = bytes([0x50 if key else 0]) + clock
        first = min(len(pes), PACKET - 5 - len(front))
        front += b"\xff" * (PACKET - 5 - len(front) - first)
        n = 1 + -(-(len(pes) - first) // 184)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = MEDIA_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = MEDIA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        packets[0, 3] |= 0x20
        packets[0, 4] = len(front)
        packets[0, 5:] = np.frombuffer(front + pes[:first], np.uint8)
        body = np.frombuffer(pes, np.uint8)[first:]
        full = len(body) // 184
        packets[1 : 1 + full, 4:] = body[: full * 184].reshape(full, 184)
        rest = len(body) - full * 184
        if rest:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - rest
            if rest < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - rest :] = body[full * 184 :]
        counter += n
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    stream_type: int = -1
    times: list[int] = field(default_factory=list)
    access: list[int] = field(default_factory=list)  # indices of the units at which decoding can start
    packets: int = 0
    lost: int = 0  # breaks of a continuity counter
    repeated: int = 0  # packets sent twice, which count once
    damaged: list[int] = field(default_factory=list)  # units that a break has fallen into


def _sections(packets: np.ndarray, start: np.ndarray, pid: np.ndarray, unit: np.ndarray, which: int) -> Iterator[bytes]:
    """The program tables of a PID; a table can go on in the packets that follow."""
    mine = np.flatnonzero(pid == which).tolist()
    for k, i in enumerate(mine):
        if not unit[i]:
            continue
        own = packets[i, int(start[i]) :].tobytes()
        held = own[1 + own[0] :]
        size = 3 + int.from_bytes(held[1:3], "big") % 4096 if len(held) >= 3 else 4096
        for j in mine[k + 1 :]:
            if len(held) >= size or unit[j]:
                break
            held += packets[j, int(start[j]) :].tobytes()
        if len(held) < size or section_crc(held[:size]):
            raise ValueError("damaged program table")
        yield held[:size]


def demux(data: bytes) -> Stream:
    """Read the first elementary stream of the first program. Raises ValueError for what is no such stream."""
    if len(data) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    unit, adapted, filled = (p[:, 1] & 0x40) > 0, (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    start = 4 + np.where(adapted, 1 + p[:, 4].astype(np.int64), 0)
    out = Stream(packets=len(p))
    # the format lets a packet be sent twice, with the same counter; the second one goes
    again, broken = np.zeros(len(p), bool), np.zeros(len(p), bool)
    for which in np.unique(pid[pid != NULL_PID]).tolist():
        at = np.flatnonzero((pid == which) & filled)
        step = np.diff((p[at, 3] & 0x0F).astype(np.int64)) % 16
        same = (step == 0) & (p[at[1:], 4:] == p[at[:-1], 4:]).all(axis=1)
        again[at[1:][same]] = True
        broken[at[1:][(step != 1) & ~same]] = True
    out.lost, out.repeated = int(broken.sum()), int(again.sum())
    p, pid, unit, adapted, filled, start, broken = (x[~again] for x in (p, pid, unit, adapted, filled, start, broken))
    programs = [int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for s in _sections(p, start, pid, unit, PAT_PID) for i in range(8, len(s) - 4, 4) if s[i] or s[i + 1]]
    media = -1
    for s in (x for which in programs[:1] for x in _sections(p, start, pid, unit, which)):
        at = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
        out.stream_type, media = s[at], int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
        break
    mine = np.flatnonzero((pid == media) & filled)
    if not len(mine):
        return out
    own, begin = p[mine], start[mine]
    content = own[np.arange(PACKET)[None] >= begin[:, None]]
    size = PACKET - begin
    where = np.cumsum(size) - size
    firsts = np.flatnonzero(unit[mine])
    # what is missing before a unit's first packet is missing at the end of the unit before it too
    hit = np.flatnonzero(broken[mine])
    units = np.searchsorted(firsts, hit, side="right") - 1
    out.damaged = sorted({k for k in [*units.tolist(), *(units - 1)[np.isin(hit, firsts)].tolist()] if k >= 0})
    random = adapted[mine] & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    raw, parts = content.tobytes(), []
    for k, i in enumerate(firsts.tolist()):
        at = int(where[i])
        stop = int(where[firsts[k + 1]]) if k + 1 < len(firsts) else len(raw)
        if raw[at : at + 3] != b"\0\0\1":
            raise ValueError("not a PES packet")
        length = int.from_bytes(raw[at + 4 : at + 6], "big")
        stop = min(stop, at + 6 + length) if length else stop
        if raw[at + 7] & 0x80:
            a, b, c, d, e = raw[at + 9 : at + 14]
            out.times.append((a & 0x0E) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1)
        if random[i]:
            out.access.append(k)
        parts.append(raw[at + 9 + raw[at + 8] : stop])
    out.payload = b"".join(parts)
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text as a transport stream."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.text_bytes(tb.column(batch, "text"))
            for a, b in tb.slices(offsets, 1 << 24):
                made, sizes = [], []
                for i in range(a, b):
                    text = buf[offsets[i] : offsets[i + 1]].tobytes()
                    sizes.append(len(text))
                    made.append(mux(text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")))
                yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tb.lean(run), f"doc_id {kind}, n_bytes long, media binary")


def digest(stored: DataFrame) -> DataFrame:
    """What the stored streams hold, by reading them. A stream that cannot be read, and a null one, has nulls and the reason
    in ``error``; units that packets are missing from are listed in ``damaged``."""
    prepare(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in tb.column(batch, "media"):
                data = media.as_py()
                try:
                    if data is None:
                        raise ValueError("no stream")
                    s = demux(data)
                except (ValueError, IndexError) as e:
                    # a packet that points beyond its end is read past it
                    rows.append((*[None] * 3, *((len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)), None, None, None, None, str(e) or type(e).__name__))
                    continue
                last = s.times[-1] / CLOCK if s.times else 0.0
                feature = f"type={s.stream_type};packets={s.packets};units={len(s.times)};access={len(s.access)};lost={s.lost};last={last:.3f}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.times, s.access, s.damaged, None))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), tb.column(batch, "n_bytes"), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "damaged", "error"]
    return stored.mapInArrow(tb.lean(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>, damaged array<int>, error string")


def media_table(docs: DataFrame) -> DataFrame:
    return materialize(docs.sparkSession, store(docs), "media")
