"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, divergence, fingerprint, forest, langid, mixing, oracles, packing, pii, quality, secrets, spelling, toxicity
from plumbline.session import ship, table


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ship(spark), sf_dir, "documents")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = langid.predict(docs, langid.fit(docs, usable=~langid.held_out("doc_id")))
    return out.select("doc_id", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), langid.held_out("doc_id").alias("held_out"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(_documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.edits(_documents(spark, sf_dir))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "held_edited", "held_next", "n_shingles",
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), *_tokenizer("byte_bpe_multi_50k.tiktoken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), *_tokenizer("byte_bpe_50k.tiktoken"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held)
    return toxicity.score(docs, model).withColumn("held_out", held)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(_documents(spark, sf_dir), threshold=0.8).drop("text_hash", "class_hash")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(_documents(spark, sf_dir)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
