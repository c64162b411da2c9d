"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Short test items are looked for inside documents that are often a thousand times longer, where a MinHash of the
document says little about an item. So the sketch is taken from the item: for each of several hash functions the
shingle with the least value. If a document contains a share c of an item's shingles, it holds each of these least
shingles with probability c. Items are partitioned by their number of shingles into powers of two; an item of a
partition whose size is at most the number of hash functions is sketched by all its shingles, of which a candidate needs
the threshold's share; a larger one by ``hashes`` of them, of which a candidate needs two, so that an item contained to
the threshold 0.8 is missed with probability 2e-7 at most. Candidates are then verified by counting the item's distinct
shingles in the document.

An item of fewer words than a shingle is one shingle of all its words, looked for among the runs of as many words.

Only DataFrame functions are used. Words are maximal runs of letters and digits, in lower case.

Defined results: null or empty texts, and those without words, contain nothing and are found nowhere.
For ``search``, rows with the same doc_id count as one document, rows whose doc_id is null likewise; ``clean`` decides
on each row by itself. Items with the same
item_id count as one item. Empty tables give an empty result. Further columns are ignored by ``search`` and kept by
``clean``, which reserves ``__dc_key``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.rowkey import row_key
from furlong.session import materialize


@dataclass(frozen=True)
class Config:
    """shingle: words of a shingle. threshold: least containment. hashes: least shingles of a large item. least_hits: how many of those a candidate has.
    broadcast_rows: a side of more rows than this is not broadcast but joined by a shuffle."""

    shingle: int = 5
    threshold: float = 0.8
    hashes: int = 12
    least_hits: int = 2
    broadcast_rows: int = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(w[i + j] for j in range(n))))


def exploded(rows: DataFrame, key: list[str], config: Config, short: tuple[int, ...] = ()) -> DataFrame:
    """The key and ``h`` for every shingle of ``text``, and for every run of ``short`` words."""
    split = rows.where("text is not null").select(*key, words(F.col("text")).alias("w"))
    runs = [shingles(F.col("w"), n) for n in (config.shingle, *short)]
    return split.select(*key, F.explode(F.concat(*runs) if short else runs[0]).alias("h"))


def items_of(benchmark: DataFrame, config: Config) -> DataFrame:
    """item_id, h and the words of a run, for every shingle of an item, or the one of a short item."""
    split = benchmark.where("text is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = shingles(F.col("w"), config.shingle)
    for n in range(1, config.shingle):
        own = F.when(F.size("w") == n, shingles(F.col("w"), n)).otherwise(own)
    return split.select("item_id", F.least(F.size("w"), F.lit(config.shingle)).alias("run"), F.explode(own).alias("h")).distinct()


def small(df: DataFrame, rows: int, config: Config) -> DataFrame:
    return F.broadcast(df) if rows <= config.broadcast_rows else df


def sketches(items: DataFrame, config: Config) -> DataFrame:
    """item_id, need (how many of its sketch a candidate has, by its size partition) and h, a sampled shingle."""
    sets = items.groupBy("item_id").agg(F.collect_set("h").alias("set"))
    sized = sets.select("item_id", "set", F.size("set").alias("n")).withColumn("part", F.ceil(F.log2("n")).cast("int"))
    whole = F.pow(F.lit(2), F.col("part")) <= config.hashes
    least = [F.array_min(F.transform("set", lambda s, k=k: F.struct(F.xxhash64(s, F.lit(k)).alias("v"), s.alias("h"))))["h"] for k in range(config.hashes)]
    # functions that agree on a shingle give one row; further ones follow until the item has enough distinct shingles
    ordered = F.transform(F.array_sort(F.transform("set", lambda s: F.struct(F.xxhash64(s, F.lit(-1)).alias("v"), s.alias("h")))), lambda x: x["h"])
    drawn = F.array_distinct(F.array(*least))
    filled = F.slice(F.concat(drawn, F.array_except(ordered, drawn)), 1, config.hashes)
    need = F.when(whole, F.ceil(config.threshold * F.col("n") - 1e-9)).otherwise(config.least_hits)
    return sized.select("item_id", need.alias("need"), F.explode(F.when(whole, F.col("set")).otherwise(filled)).alias("h"))


def search(docs: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found for every document that contains an item to the threshold."""
    spark = docs.sparkSession
    items = materialize(spark, items_of(benchmark, config), "items")
    n_items = items.count()
    # at most as many as a shingle has words
    short = tuple(sorted(r["run"] for r in items.select("run").distinct().collect() if r["run"] < config.shingle))
    items = items.select("item_id", "h")
    sketch = materialize(spark, sketches(items, config), "sketches")
    near = exploded(docs.select("doc_id", "text"), ["doc_id"], config, short).join(small(sketch, sketch.count(), config), "h")
    hits = near.groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("hits")).where("hits >= need")
    candidates = materialize(spark, hits.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")), "candidates")
    mine = candidates.select(F.col("doc_id").alias("_of"), "items")
    texts = docs.select("doc_id", "text").join(small(mine, candidates.count(), config), F.col("doc_id").eqNullSafe(F.col("_of")), "inner").drop("_of")
    found = exploded(texts, ["doc_id", "items"], config, short).join(small(items, n_items, config), "h")
    found = found.where(F.array_contains("items", F.col("item_id"))).groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("n_found"))
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    return found.join(small(sizes, n_items, config), "item_id").where(F.col("n_found") >= config.threshold * F.col("n_shingles")).select("doc_id", "item_id", "n_shingles", "n_found")


def clean(docs: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows that contain no item, each looked at by itself, whatever its doc_id."""
    keyed = docs.withColumn("__dc_key", row_key())
    hit = search(keyed.select(F.col("__dc_key").alias("doc_id"), "text"), benchmark, config).select(F.col("doc_id").alias("__dc_key")).distinct()
    return keyed.join(hit, "__dc_key", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> ''] AS w FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> ''] AS w FROM benchmark WHERE text IS NOT NULL
), k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)
), bs AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY 1, 2, 3 HAVING count(*) >= 0.8 * n_shingles
"""
