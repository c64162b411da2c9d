"""Exact dedup, the manifest and spelling variants against slow versions, on edge cases and on the tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import oracle
import pytest
from conftest import EDGE, SCHEMA, make
from pyspark.sql import functions as F

from furlong.llm import exactdedup, manifest, registry, spelling

SF = "/root/testdata/sf0.001"
SPACED = [(100, "a b"), (101, "a\tb "), (102, "ab"), (103, "a b"), (104, None), (105, " "), (106, "\x0b\x0c"), (107, "é é"), (108, "éé\n"), (108, "éé\n"), (None, "ab      ")]


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_manifest"])
def test_sql(spark, name):
    assert oracle.differences(registry.queries()[name](spark, SF), oracle.connection(SF), registry.oracle_sql()[name], 0) == []


def slow_groups(rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    of = collections.defaultdict(list)
    for i, t in rows:
        of[bare(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        first = min(of[bare(t)])
        mine = (-len(t or ""), i is None, i or 0)
        out.append((i, None if first[1] else first[2], len(of[bare(t)]), mine == first, hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("salts", [1, 5])
def test_exact_groups(spark, salts):
    rows = EDGE + SPACED
    docs = make(spark, rows).repartition(7)
    got = sorted((tuple(r) for r in exactdedup.groups(docs, salts=salts).collect()), key=str)
    assert got == slow_groups(rows)


def test_exact_groups_of_one_digest(spark):
    """A digest that many contents share changes nothing but the digest."""
    rows = EDGE + SPACED
    docs = make(spark, rows).repartition(5)
    got = exactdedup.groups(docs, lambda body: F.substring(F.sha2(body, 256), 1, 1)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in slow_groups(rows)), key=str)


def test_exact_deduplicate(spark, empty):
    rows = EDGE + SPACED
    docs = make(spark, rows)
    kept = exactdedup.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {(r[0], r[4]) for r in slow_groups(rows) if r[3]}
    bare = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()
    got = [(r["doc_id"], bare(r["text"])) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exactdedup.groups(empty).count() == 0 and exactdedup.deduplicate(empty).count() == 0


def test_large_groups_are_looked_up(spark):
    """Groups of more and of fewer rows than one LARGEth part, and no Python on the way."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1700).cast("string")).alias("text"))
    found = exactdedup.groups(docs)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    sizes = {r["group_size"]: r["n"] for r in found.groupBy("group_size").agg(F.count("*").alias("n")).collect()}
    want = collections.Counter("hot" if i % 3 == 0 else str(i % 1700) for i in range(5000))
    assert sizes == {n: n * sum(1 for v in want.values() if v == n) for n in set(want.values())}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(hashes):
    """The root, and of each leaf the siblings left and right of it level by level."""
    at = [[i] for i in range(len(hashes))]
    steps = [[] for _ in hashes]
    while len(hashes) > 1:
        up, group = [], []
        for i in range(0, len(hashes), 3):
            run = hashes[i : i + 3]
            for k in range(len(run)):
                for leaf in at[i + k]:
                    steps[leaf].append((run[:k], run[k + 1 :]))
            up.append(h(*run))
            group.append([x for k in range(len(run)) for x in at[i + k]])
        hashes, at = up, group
    return hashes[0], steps


def slow_manifest(rows):
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    of = collections.defaultdict(list)
    for r in rows:
        of[r[1]].append(r)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[s] = slow_tree([leaf(r) for r in of[s]])
    root, over = slow_tree([inner[s][0] for s in names])
    out = []
    for s, up in zip(names, over, strict=True):
        for r, steps in zip(of[s], inner[s][1], strict=True):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = leaf((*r[:4], r[4].replace("\n", ""))) if changed else leaf(r)
            for left, right in steps + up:
                fold = h(*left, fold, *right)
            proof = h(*(x for left, right in steps + up for x in (*left, *right)))
            out.append((r[0], leaf(r), inner[s][0], root, proof, fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest(spark, empty, depth):
    rows = [(i, ["a", "b", None, "é", ""][i % 7 % 5] if i % 11 else "hot", None if i % 5 == 0 else "en", None if i % 6 == 0 else i, None if i % 13 == 0 else f"x\n{i}" if i % 4 else "x") for i in range(150)]
    rows += [(7, "hot", "en", 1, "x"), (7, "hot", "en", 1, "x"), (None, "hot", "en", 1, "x\n"), (-5, "only", None, None, None)]
    docs = spark.createDataFrame([(*r, "k", "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, pos string").repartition(5)
    assert sorted((tuple(r) for r in manifest.manifest(docs, depth).collect()), key=str) == slow_manifest(rows)
    assert manifest.manifest(empty).count() == 0


def slow_words(rows):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            if i is not None and (k := zlib.crc32(f"{i}:{w}".encode())) % 199 == 0:
                w = w[: k % len(w)] + w[k % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(n):
    form, count = {}, collections.Counter()
    best = {}
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for size, words in by_length.items():
        for a, b in itertools.chain(itertools.combinations(words, 2), itertools.product(words, by_length.get(size + 1, []))):
            if near(a, b):
                for x, y in ((a, b), (b, a)):
                    count[x] += 1
                    best[x] = min(best.get(x, (0, "")), (-n[y], y))
    for w in n:
        form[w] = best[w][1] if w in best and -best[w][0] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_on_documents(spark):
    docs = registry.table(spark, SF, "documents")
    n = slow_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = sorted(tuple(r) for r in registry.op13_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert len(n) > 500 and got == slow_variants(n)


@pytest.mark.parametrize("most", [2, 10_000])
def test_spelling_variants(spark, empty, most):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice([*"abé"], k)) for k in (6, 6, 6, 7, 7, 8, 9) for _ in range(60)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "prefix" * 30, "prefix" * 30 + "x", "y" + "prefix" * 30, "short"}
    counts = {w: int(5 * 3 ** rng.integers(0, 6)) for w in sorted(words)}
    rows = [(None, " ".join([w.upper() if i % 2 and w.isascii() else w] * c)) for i, (w, c) in enumerate(counts.items())]
    docs = make(spark, rows + [(1, None), (2, ""), (3, "1 2 3"), (4, "rarely rarely")]).repartition(3)
    n = slow_words(rows)
    got = sorted(tuple(r) for r in spelling.variants(docs, most).collect())
    assert got == slow_variants(n)
    assert max(r[4] for r in got) > 3 and any(r[1] and r[1] != r[2] for r in got)
    assert spelling.variants(empty).count() == 0


def test_one_edit_pairs_are_found_once():
    rng = np.random.default_rng(7)
    for alphabet, size in (("ab", 40), ("abc", 60), ("abcdefgh", 80)):
        for free in (1, 2, 3, 5):
            parts = sorted({"".join(rng.choice([*alphabet], k)) for k in (free, free, free - 1) for _ in range(size)})
            got = sorted(tuple(sorted(p)) for p in spelling.one_edit_pairs(spelling.trie(parts, free)))
            want = [(a, b) for a, b in itertools.combinations(range(len(parts)), 2) if near(parts[a], parts[b]) and max(len(parts[a]), len(parts[b])) == free]
            assert got == want


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "same text"), ("a", "same  text"), (None, "x"), ("c", "x")], "doc_id string, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exactdedup.groups(docs).collect()}
    assert got == {"b": ("a", 2, False), "a": ("a", 2, True), None: ("c", 2, False), "c": ("c", 2, True)}
    assert SCHEMA.startswith("doc_id long")
