"""The corpus pipeline: raw documents to packed training sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet to the
shared folder and hands the reread table to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import decontaminate, jaccardjoin, packing, registry, suffixdedup, toxicity
from furlong.llm.rowkey import row_key
from furlong.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold of their language go."""
    return toxicity.reject(spark, docs, registry.table(spark, sf_dir, "labels"), registry.remainder(4) != 2)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate rows that with the least doc_id stays, of those with the same doc_id, or none, the one with the
    least key. Of rows with the same doc_id and text one stays. Other rows stay, with or without a doc_id."""
    keyed = docs.withColumn("_key", row_key())
    classes = jaccardjoin.join(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "class_id").distinct()
    ids = keyed.select("_key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).getField("_key")
    stays = classes.join(ids, "_key").groupBy("class_id").agg(first.alias("_key")).select("_key")
    kept = keyed.join(stays, "_key", "left_semi").select(*docs.columns)
    repeated = keyed.groupBy("_key").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out, with what is left of a character that a
    cut has split. A document of which nothing is left goes."""
    found = suffixdedup.repeats(docs, "kept_text", "__sd_")
    cut = F.col("__sd_n_removed") > 0
    left = F.when(cut, F.col("__sd_kept_text")).otherwise(F.col("text"))
    size = F.when(cut, F.length("__sd_kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~cut | (F.col("__sd_kept_text") != "")).withColumns({"text": left, "n_chars": size}).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go."""
    return decontaminate.clean(docs, registry.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, registry.tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_of_each_class),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, byte cuts and tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
