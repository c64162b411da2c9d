"""Spelling variants: words one edit apart, found by merging the light subtrees of tries, and the form that each stands for.

Words that share all but one edit agree before it and after it. A cell (L, lo, hi, prefix, suffix) holds the words of L or
L - 1 code points that share the first lo and the last hi of them; it answers for the pairs of longest length L whose first
difference is at lo to L - 1 - hi. Every word starts in the cells of its length and the next one; a cell is halved at the
middle of what is free, into one of a longer prefix and one of a longer suffix, and again while it has more than
``CELL_WORDS`` words, down to one free place. So each pair is in exactly one cell, and no cell grows with the vocabulary.

In a cell the free parts form a trie. At each node the light subtrees are copied into one tree with their first character
skipped or replaced: where their terminals coincide, the words differ by a replacement; walked along the heavy child or the
node itself, coinciding terminals differ by a replacement or by a deletion. A word is copied once for each light edge above
it, so n words of length m take O(n m log n) steps.

Defined results: a null text has no words, a row without doc_id has none changed. Of nears with the same count the least in
code-point order is the form. Repeated rows count each. An empty table gives an empty result. Other columns are never
looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.session import materialize, prepare

LEAST_POINTS = 6
LEAST_COUNT = 5
#: A form has at least so many times the count of its variant.
FORM_TIMES = 5
#: One run of a document in so many, by its hash, loses a character.
TYPO_EVERY = 199
#: A task counts so many distinct words before it hands them on.
HELD_WORDS = 200_000
CELL_WORDS = 20_000
DEAL_ROWS = 40_000

# shorter runs cannot give a word; the regular expression takes maximal runs of lower-cased text
_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_POINTS)


def words_of(doc_id: str | None, text: str | None) -> Counter:
    """Words of a text and how often they occur; only A-Z are lower-cased."""
    runs = Counter(_RUNS.findall(text.encode().lower().decode())) if text else Counter()
    if doc_id is None:
        return runs
    begin = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for word, times in runs.items():
        h = zlib.crc32(word.encode(), begin)
        if h % TYPO_EVERY == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
        if len(word) >= LEAST_POINTS:
            out[word] += times
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word and n of every word of LEAST_POINTS code points that occurs LEAST_COUNT times."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(tb.column(batch, "key").to_pylist(), tb.column(batch, "text"), strict=True):
                held.update(words_of(key, text.as_py()))
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    found = docs.select(F.col("doc_id").cast("string").alias("key"), "text").mapInArrow(tb.lean(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Node:
    __slots__ = ("kids", "long", "short", "size")

    def __init__(self) -> None:
        self.kids: dict[str, Node] = {}
        self.long: list = []
        self.short: int | None = None
        self.size = 0


def trie(parts: list[str], free: int) -> Node:
    """The trie of the free parts; those of ``free`` characters are long words, those of one less short ones."""
    root = Node()
    for i, part in enumerate(parts):
        node = root
        node.size += 1
        for c in part:
            node = node.kids.setdefault(c, Node())
            node.size += 1
        if len(part) == free:
            node.long.append(i)
        else:
            node.short = i
    return root


def _graft(into: Node, tree: Node, mark: str) -> None:
    """Copy the long words of a subtree into another tree, with the character that was left out."""
    stack = [(into, tree)]
    while stack:
        to, at = stack.pop()
        to.long.extend((i, mark) for i in at.long)
        for c, kid in at.kids.items():
            stack.append((to.kids.setdefault(c, Node()), kid))


def _along(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """The nodes that two trees have in common."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        yield x, y
        few, many = (x.kids, y.kids) if len(x.kids) <= len(y.kids) else (y.kids, x.kids)
        stack.extend((x.kids[c], y.kids[c]) for c in few if c in many)


def one_edit_pairs(root: Node, after: str = "") -> Iterator[tuple[int, int]]:
    """Pairs of a long word with a long one by a replacement, or with a short one by a deletion, each once: at the node where
    the two part. after: the character that follows all free parts; a short word that ends where a long one goes on with that
    character has not parted from it."""
    stack = [root]
    while stack:
        v = stack.pop()
        if not v.kids:
            continue
        stack.extend(v.kids.values())
        first = max(v.kids, key=lambda c: v.kids[c].size)
        heavy = v.kids[first]
        # the shorter word takes a light edge or ends here, the longer one has the heavy edge before it
        if v.short is not None and first != after:
            yield from ((i, v.short) for i in heavy.long)
        for c, kid in v.kids.items():
            if c != first and c in heavy.kids:
                for x, y in _along(kid, heavy.kids[c]):
                    if x.short is not None:
                        yield from ((i, x.short) for i in y.long)
        if len(v.kids) == 1:
            continue
        light = Node()
        for c, kid in v.kids.items():
            if c != first:
                _graft(light, kid, c)
        # first character replaced: by another light one, or by the heavy one
        for x, y in _along(light, light):
            ids = [i for i, _ in x.long]
            yield from ((ids[a], ids[b]) for a in range(len(ids)) for b in range(a))
        for x, y in _along(light, heavy):
            if x.long and y.long:
                yield from ((i, j) for i, _ in x.long for j in y.long)
        # first character skipped: the rest is a short word below this node, by another edge than the skipped one
        if v.short is not None:
            yield from ((i, v.short) for i, mark in light.long if mark != after)
        for c, kid in light.kids.items():
            if c in v.kids:
                for x, y in _along(kid, v.kids[c]):
                    if y.short is not None:
                        yield from ((i, y.short) for i, mark in x.long if mark != c)


class _Nears:
    """Of each word the number of its nears and the best of them."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts, self.near, self.best = words, counts, Counter(), {}

    def add(self, i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            self.near[a] += 1
            key = (-self.counts[b], self.words[b])
            if a not in self.best or key < self.best[a]:
                self.best[a] = key

    def rows(self) -> list[tuple[str, int, str, int]]:
        return [(self.words[i], n, self.best[i][1], -self.best[i][0]) for i, n in self.near.items()]


CELL = ["L", "lo", "hi", "prefix", "suffix"]


def _cells(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    made = df.select("word", "n", "L", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    # what a word shares with its cell; right() of no characters is empty
    return made.withColumns({"prefix": F.substring(F.col("word"), F.lit(1), F.col("lo")), "suffix": F.right("word", F.col("hi"))})


def _halved(df: DataFrame) -> DataFrame:
    """Cells of a longer prefix and of a longer suffix, cut at the middle of what is free."""
    half = F.floor((F.col("L") - F.col("lo") - F.col("hi")) / 2)
    return _cells(df, F.col("lo") + half, F.col("hi")).unionByName(_cells(df, F.col("lo"), F.col("L") - F.col("lo") - half))


def cells(words: DataFrame, most: int = CELL_WORDS) -> DataFrame:
    """word, n and the cells it is in; no cell of more than one free place has more than ``most`` words."""
    spark = words.sparkSession
    size = F.char_length("word")
    begin = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("L"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    out = materialize(spark, _halved(begin), "spelling-cells")
    while True:
        full = out.groupBy(*CELL).count().where((F.col("count") > most) & (F.col("L") - F.col("lo") - F.col("hi") > 1)).drop("count")
        full = materialize(spark, full, "spelling-full")
        if full.isEmpty():
            return out
        rest = out.join(full, CELL, "left_anti").select(*out.columns)
        out = materialize(spark, rest.unionByName(_halved(out.join(full, CELL, "left_semi")).select(*out.columns)), "spelling-cells")


def nears(words: DataFrame, most: int = CELL_WORDS) -> DataFrame:
    """word, n_near, near and near_n (the near word of the largest n) of every word that has near ones."""
    found = cells(words, most)
    deals = max(1, -(-found.count() // DEAL_ROWS))

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        groups: dict[tuple, list[int]] = {}
        data = table.to_pydict()
        for i, key in enumerate(zip(*(data[c] for c in CELL), strict=True)):
            groups.setdefault(key, []).append(i)
        for (length, lo, hi, _, suffix), at in groups.items():
            if len(at) > 1:
                own = [data["word"][i] for i in at]
                seen = _Nears(own, [data["n"][i] for i in at])
                for i, j in one_edit_pairs(trie([w[lo : len(w) - hi] for w in own], length - lo - hi), suffix[:1]):
                    seen.add(i, j)
                out.extend(seen.rows())
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["word", "n_near", "near", "near_n"])

    dealt = found.withColumn("deal", F.pmod(F.xxhash64(*CELL), F.lit(deals)))
    each = dealt.groupBy("deal").applyInArrow(tb.lean_group(run), "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and root of links word -> form without circles. Every round doubles the steps taken; a form has a multiple of the
    count of its variant, so there are only as many rounds as the counts allow."""
    spark = links.sparkSession
    out = materialize(spark, links.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(spark, out.join(on, "root", "left"), "spelling-links")
        out = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.where("next is not null").isEmpty():
            return out


def variants(docs: DataFrame, most: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    spark = docs.sparkSession
    words = materialize(spark, count_words(docs), "spelling-words")
    near = words.join(nears(words, most), "word", "left")
    is_form = F.col("near_n") >= FORM_TIMES * F.col("n")
    formed = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    formed = materialize(spark, formed, "spelling-forms")
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
