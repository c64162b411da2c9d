"""Token ids of whole texts, with every distinct piece between white space encoded once per worker.

A text is cut only where the tokenizer's own pre-tokenization always cuts: at single spaces and line feeds
between characters that are not white space. The ids of a text are those of its pieces, one after the other. The
strings of special tokens hold no white space, so they stay whole in a piece and get the ids that the library gives them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from furlong.llm import textbytes as tb

#: First bytes of the characters beyond ASCII that can be white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = ~tb.byte_table("spaced")


@dataclass(frozen=True)
class TokenizerSpec:
    """path: a tokenizer file. keeps_space: a space belongs to the word after it (byte-level kinds); else white
    space is dropped. mark: a text that always is one token of its own, between the pieces of one call.
    known: pieces that a worker keeps; beyond that it starts anew."""

    path: str
    keeps_space: bool
    mark: str
    known: int = 1_500_000


class PieceEncoder:
    def __init__(self, spec: TokenizerSpec):
        from tokenizers import Tokenizer

        self.spec = spec
        self.tokenizer = Tokenizer.from_file(spec.path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        joint = self._ids(f"a{spec.mark} a")
        self.mark = int(joint[1]) if len(joint) == 3 else None
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.count = np.zeros(0, np.uint32)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pieces."""
        n = len(buf)
        space = _SPACE[buf]
        if self.spec.keeps_space:
            cut = (buf == 32) | (buf == 10)
        else:
            cut = space.copy()
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        where = np.flatnonzero(cut)
        where = where[~edge[where] & ~edge[where + 1]]
        before, after = buf[where - 1], buf[where + 1]
        wide = (before >= 0x80) & (_WIDE[buf[np.maximum(where - 2, 0)]] | _WIDE[buf[np.maximum(where - 3, 0)]])
        where = where[~(_SPACE[before] | _SPACE[after] | wide | _WIDE[after])]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        first[where] = True
        if self.spec.keeps_space:
            first[where[buf[where] == 10] + 1] = True
            starts = np.flatnonzero(first)
            return starts, np.append(starts[1:], n)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        drop = np.zeros(n + 1, bool)
        drop[where] = True
        return starts + drop[starts], ends

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n+1 offsets of the texts in them."""
        if len(buf) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = self._cut(buf, offsets)
        hashes = tb.span_hashes(tb.prefix_sums(buf), starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        if not known.all():
            if len(self.keys) > self.spec.known:
                self._reset()
                known[:] = False
            new = first[~known]
            self._learn(distinct[~known], buf, starts[new], ends[new])
            place = np.searchsorted(self.keys, distinct)
        at, count = self.at[place][inverse].astype(np.int64), self.count[place][inverse].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def _learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found: list[np.ndarray | None] = [None] * len(texts)
        mark = self.spec.mark
        # a special token ends the text before it, so its piece is not joined with others
        plain = [not any(x in t for x in self.special) for t in texts]
        joint = [i for i, t in enumerate(texts) if t and plain[i] and mark.strip(" ") not in t and (not self.spec.keeps_space or t[0] == " ")] if self.mark is not None else []
        for a in range(0, len(joint), 512):
            part = joint[a : a + 512]
            glue = mark if self.spec.keeps_space else f" {mark} "
            ids = self._ids(glue.join(texts[i] for i in part))
            stops = np.flatnonzero(ids == self.mark)
            if len(stops) == len(part) - 1:
                for i, piece in zip(part, np.split(ids, stops), strict=True):
                    found[i] = piece[1:] if i != part[0] else piece
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, np.uint32)
        self._keep(keys, found)

    def _keep(self, keys: np.ndarray, found: list[np.ndarray]) -> None:
        """Adds sorted new keys. The ids grow where they are and the columns one after the other, so the table never stands
        twice in a worker's memory."""
        count = np.array([len(x) for x in found], np.int64)
        used = len(self.flat)
        place = np.searchsorted(self.keys, keys)
        self.flat.resize(used + int(count.sum()), refcheck=False)
        np.concatenate(found, out=self.flat[used:])
        self.at = np.insert(self.at, place, (used + np.cumsum(count) - count).astype(np.uint32))
        self.count = np.insert(self.count, place, count.astype(np.uint32))
        self.keys = np.insert(self.keys, place, keys)


_encoders: dict[TokenizerSpec, PieceEncoder] = {}


def encoder(spec: TokenizerSpec) -> PieceEncoder:
    """The worker's encoder of this file."""
    if spec not in _encoders:
        _encoders[spec] = PieceEncoder(spec)
    return _encoders[spec]


def encode_column(spec: TokenizerSpec, arr: pa.Array, end_id: int, slice_bytes: int = 1 << 20):
    """Yields (first row, last row, ids, offsets) for slices of a string column; each text has end_id appended."""
    buf, offsets = tb.text_bytes(arr)
    one = encoder(spec)
    for a, b in tb.slices(offsets, slice_bytes):
        ids, at = one.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = b - a
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
        yield a, b, out, at + np.arange(n + 1)
