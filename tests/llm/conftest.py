import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, bucket string, item_id string"


def make(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    full = [(i, t, "en", "s", len(t or ""), "r", "h", "b", "i") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


PASSAGE = "one shared passage that is quite a bit longer than fifty bytes, so that it repeats across texts. "
WORDS = " ".join(f"w{i}" for i in range(60))
EDGE = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "a"), (4, PASSAGE + WORDS), (5, "before it " + PASSAGE + "and after"), (5, "before it " + PASSAGE + "and after"),
    (None, PASSAGE + WORDS), (6, WORDS), (7, WORDS.replace("w30", "other")), (8, "é" * 300), (9, "x" * 200), (10, "x" * 199), (11, " ".join(f"v{i}" for i in range(9000))), (12, "ünï çödé " * 40),
]


@pytest.fixture
def edge(spark):
    return make(spark, EDGE)


@pytest.fixture
def empty(spark):
    return make(spark, [])


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
