"""The table of known pieces is compact and gives the tokenizer's ids, however often it grows or starts anew."""

import dataclasses

import numpy as np
import pyarrow as pa
import pytest

from furlong.llm import registry, tokens


@pytest.mark.parametrize("known", [1_500_000, 300])
def test_table_of_pieces(known):
    spec = dataclasses.replace(registry.tokenizer("byte_bpe_50k.json"), known=known)
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(200)) for _ in range(20)] + ["", None, "\n\n a"]
    one = tokens.PieceEncoder(spec)
    tokens._encoders[spec] = one
    got = [ids[at[i] : at[i + 1]].tolist() for _, _, ids, at in tokens.encode_column(spec, pa.array(texts), 0, slice_bytes=1500) for i in range(len(at) - 1)]
    assert got == [[*one.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert np.all(one.keys[1:] > one.keys[:-1]) and one.at.itemsize + one.count.itemsize == 8
