"""Exact duplicates by combining in three stages, with the full content as part of the key at each of them.

1. Every task combines its own rows: the partial aggregation by digest and content.
2. The tasks' groups meet in salted groups of the same digest and content. The salt is the task's number, so a text that
   every task has is spread over ``salts`` reducers, each of which gets one row for each task of its salt.
3. The winners of the salts are combined for each digest and content.

Groups have a content each, never a digest alone: two texts of one digest stay two groups. The rows then learn their
group's winner by digest, those of the few largest groups from a table of at most ``LARGE`` rows. Only built-in functions
are used.

Defined results: a null text counts as an empty one. A null doc_id comes after all others. Rows that share the doc_id and
the length of the winner are the same document and all of them are marked as kept; ``deduplicate`` keeps one of them. An
empty table gives an empty result. Columns other than doc_id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.session import materialize

#: Texts are equal if they are the same without these characters.
IGNORED = r"[\x20\x09-\x0D]+"
#: Groups of at least this part of all rows are looked up in a broadcast table: there are no more of them than this.
LARGE = 1024

ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS size FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def body() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), IGNORED, "")


def rank() -> Column:
    """The least is the row that stays: the longest text, then the least doc_id."""
    return F.struct((-F.char_length(F.coalesce("text", F.lit("")))).alias("size"), F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select("doc_id", rank().alias("rank"), body().alias("body")).withColumn("digest", digest(F.col("body")))


def contents(rows: DataFrame, salts: int) -> DataFrame:
    """digest, body, first, n of every distinct content; rows of a digest are in one partition."""
    total = [F.min("first").alias("first"), F.sum("n").alias("n")]
    task = rows.select("digest", "body", F.col("rank").alias("first"), F.lit(1).cast("long").alias("n"), (F.spark_partition_id() % salts).alias("salt"))
    salted = task.groupBy("digest", "body", "salt").agg(*total)
    return salted.repartition("digest").groupBy("digest", "body").agg(*total)


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row of docs."""
    spark = docs.sparkSession
    rows = _rows(docs, digest)
    found = contents(rows, salts).groupBy("digest").agg(F.count("*").alias("bodies"), F.min("first").alias("first"), F.sum("n").alias("n"))
    found = materialize(spark, found, "exact-groups")
    total, most = found.agg(F.sum("n"), F.max("bodies")).first()
    single = found.where("bodies = 1").drop("bodies")

    # at most LARGE groups can have so many rows
    least = (total or 0) // LARGE + 1
    large = F.broadcast(single.where(F.col("n") >= least).select("digest", F.struct("first", "n").alias("known")))
    thin = materialize(spark, rows.drop("body").join(large, "digest", "left"), "exact-rows")
    rest = thin.where("known is null").drop("known").join(single.where(F.col("n") < least), "digest")
    done = thin.where("known is not null").select("digest", "doc_id", "rank", "known.first", "known.n").unionByName(rest)
    if (most or 0) > 1:
        # several contents of one digest: their rows are told apart by the content itself
        shared = rows.join(found.where("bodies > 1").select("digest"), "digest", "left_semi")
        done = done.unionByName(shared.join(contents(shared, salts), ["digest", "body"]).drop("body"))
    return done.select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("rank").eqNullSafe(F.col("first")).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 64) -> DataFrame:
    """One row of docs for each distinct content, with all of its columns. Of rows that share doc_id, content and length
    any one stays."""
    rows = docs.withColumns({"__ed_rank": rank(), "__ed_body": body()})
    first = contents(_rows(docs, digest), salts).select(F.col("first").alias("__ed_rank"), F.col("digest").alias("__ed_digest"), F.col("body").alias("__ed_body"))
    keyed = rows.withColumn("__ed_digest", digest(F.col("__ed_body")))
    same = ["__ed_rank", "__ed_digest", "__ed_body"]
    on = (F.col("a.__ed_digest") == F.col("b.__ed_digest")) & F.col("a.__ed_rank").eqNullSafe(F.col("b.__ed_rank")) & (F.col("a.__ed_body") == F.col("b.__ed_body"))
    kept = keyed.alias("a").join(first.alias("b"), on, "left_semi")
    return kept.dropDuplicates(same).select(*docs.columns)
