"""The operators as catalogue queries over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarates.llm import (
    bpe,
    chat,
    lines,
    manifest,
    near,
    packing,
    pages,
    pii,
    postings,
    scratch,
    toxicity,
    warc,
    whitening,
    windows,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of an installed public tokenizer."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.summary(_table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archives = warc.write(pages, scratch.folder(spark, "warc"))
    return warc.read(archives, with_payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.labelled(_table(spark, sf_dir, "documents"), width=3, threshold=(85, 100))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.verdicts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "n_removed_lines")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    decoded = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"), tampered=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_html": op2_html,
    "op3_chat": op3_chat,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_minhash": op7_minhash,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_decontamination": op10_decontamination,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_manifest": op13_manifest,
}
