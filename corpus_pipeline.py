"""From raw documents to token ids: five stages over the whole table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  A stage's
result is written as Parquet and read again before the next, so a lost executor costs at
most one stage's tasks.

1. quality_rules: documents that the rules reject go, lines over the limit are removed;
2. near_duplicates: one document of each group stays (five-word shingles, similarity 0.8);
3. decontamination: documents that hold a benchmark passage go;
4. personal_data: found spans are replaced by their kind;
5. tokens: the ids of every text, and whether decoding them gives the text again.

Stages 1 to 4 return the columns of their input; ``n_chars`` follows the text.  Null texts
fail the quality rules, so none comes further.  Rows with a null key are filtered like
others; near-duplicate removal keeps one only if its group has no row with a key.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarates.llm import bpe, lines, near, pii, postings, scratch
from stratarates.llm.queries import vocabulary


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(lines.filtered(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.representatives(docs, width=5, threshold=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = F.xxhash64("doc_id", "text")
    found = postings.contamination(docs.select(row.alias("row"), "text"), benchmark, key="row")
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, row == F.col("__gone"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii.redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    decoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL expresses neither boosted trees nor BPE; tests/llm compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.workers_find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = scratch.staged()
        made = stage(spark, docs, sf_dir)
        working = scratch.staged() - before
        docs = scratch.stage(made, name)
        scratch.release(only=working)  # the stage's own tables: its result is written
    return STAGES[-1][1](spark, docs, sf_dir)
