"""Ids that are no numbers, and transport streams as others write and damage them."""

import hashlib

import pytest
from conftest import PASSAGE, WORDS

from furlong.llm import jaccardjoin, media, suffixdedup


def test_text_ids(spark):
    rows = [("b", PASSAGE + "one"), ("a", PASSAGE + "two, longer"), (None, PASSAGE + "three"), ("c", WORDS), ("d", WORDS)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffixdedup.repeats(docs).collect()}
    assert got["a"] == 0 and got["b"] >= len(PASSAGE) and got[None] >= len(PASSAGE) and got["c"] == 0 and got["d"] == len(WORDS)
    classes = {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in jaccardjoin.join(docs).collect()}
    assert classes["d"] == classes["c"] == ("c", 2) and classes["a"][0] == "a"


def packets(data):
    return [data[i : i + 188] for i in range(0, len(data), 188)]


def test_a_packet_sent_twice_counts_once():
    payload = bytes(i * 11 % 251 for i in range(40_000))
    sent = packets(media.mux(payload))
    for k in (1, 2, 7, len(sent) - 1):
        s = media.demux(b"".join([*sent[: k + 1], sent[k], *sent[k + 1 :]]))
        assert (s.payload, s.lost, s.repeated, s.damaged) == (payload, 0, 1, [])
    # the same counter with other bytes is no repetition
    other = sent[5][:-1] + bytes([sent[5][-1] ^ 1])
    assert media.demux(b"".join([*sent[:6], other, *sent[6:]])).lost == 1


def test_lost_packets_name_the_damaged_units():
    sent = packets(media.mux(bytes(60_000)))
    first = [i for i, p in enumerate(sent) if p[1] & 0x40 and (p[1] & 0x1F) << 8 | p[2] == media.MEDIA_PID]
    for gone, want in ((first[1] + 3, [1]), (first[2] - 1, [1, 2]), (first[0] + 1, [0])):
        s = media.demux(b"".join([*sent[:gone], *sent[gone + 1 :]]))
        assert s.lost == 1 and s.damaged == want


def test_program_tables_of_several_packets():
    """A table with long descriptors goes on in the next packets."""
    sent = packets(media.mux(bytes(64)))
    body = bytes([0xE0 | media.MEDIA_PID >> 8, media.MEDIA_PID & 0xFF, 0xF1, 0x2C]) + bytes(300) + bytes([media.STREAM_TYPE, 0xE0 | media.MEDIA_PID >> 8, media.MEDIA_PID & 0xFF, 0xF0, 0])
    section = bytes([2, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, 0, 1, 0xC1, 0, 0]) + body
    section = b"\0" + section + media.section_crc(section).to_bytes(4, "big")
    made = []
    for k in range(0, len(section), 184):
        made.append((bytes([0x47, (0x40 if not k else 0) | media.PMT_PID >> 8, media.PMT_PID & 0xFF, 0x10 | k // 184]) + section[k : k + 184]).ljust(188, b"\xff"))
    s = media.demux(b"".join([sent[0], *made, *sent[2:]]))
    assert len(made) == 2 and (s.payload, s.lost, s.stream_type) == (bytes(64), 0, media.STREAM_TYPE)


@pytest.mark.parametrize("broken", [b"", b"x" * 188, b"short"])
def test_streams_that_cannot_be_read(spark, broken):
    whole = media.mux(b"a" * 64)
    torn = bytearray(whole)
    torn[40 - 30] ^= 0xFF  # in the first table
    rows = [(1, 64, whole), (2, 0, broken), (3, 0, None), (4, 64, bytes(torn))]
    got = {r["doc_id"]: r for r in media.digest(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["payload_sha256"] == hashlib.sha256(b"a" * 64).hexdigest()
    assert got[3]["error"] and got[3]["media_sha256"] is None and got[4]["error"] == "damaged program table" and got[4]["payload_sha256"] is None
    assert (got[2]["payload_bytes"] == 0 and broken == b"") or (got[2]["error"] and got[2]["media_bytes"] == len(broken))
