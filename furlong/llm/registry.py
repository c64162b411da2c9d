"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import decontaminate, exactdedup, jaccardjoin, langid, licences, manifest, media, packing, spelling, suffixdedup, suffixtree, tokenfile, toxicity
from furlong.llm.tokens import TokenizerSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def tokenizer(name: str) -> TokenizerSpec:
    import public_tokenizers

    kinds = {"byte_bpe_50k.json": (True, "\n"), "word_bpe_49k.json": (False, "\x00")}
    return TokenizerSpec(public_tokenizers.path(name), *kinds[name])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    at = toxicity.thresholds(model)
    return toxicity.score(docs, model).select(
        "doc_id",
        held.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        at.alias("lang_threshold"),
        F.when(F.col("score") >= at, 1).otherwise(0).alias("flagged"),
    )


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixtree.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    held = F.coalesce(remainder(7) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.join(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(5) != 0)
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    families = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["family"])))
    best = F.array_max(F.transform("hits", lambda x: x["probability"]))
    return licences.scan(docs, licences.train()).select(
        "doc_id", F.size("hits").cast("long").alias("n_paragraphs"), F.array_join(families, ",").alias("licences"), F.round(F.coalesce(best, F.lit(0.0)), 6).alias("probability")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.digest(media.media_table(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_suffix_tree": op2_suffix_tree,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_langid": op4_langid,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_token_ids": op6_token_ids,
        "op7_licences": op7_licences,
        "op8_decontaminate": op8_decontaminate,
        "op9_media": op9_media,
        "op10_packing": op10_packing,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_manifest": op12_manifest,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": decontaminate.ORACLE, "op11_exact_dedup": exactdedup.ORACLE, "op12_manifest": manifest.ORACLE}
