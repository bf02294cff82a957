"""The training-corpus pipeline: five stages, each written as Parquet and read again by the next.

quality -> exact -> near -> decontaminate -> encode

All stages but the last take and return the columns of ``documents``; a stage works on
every row that its predecessor kept, and what it rejects is gone. The last returns each
remaining document's token ids. Rows are told apart by doc_id and text together, so a
doc_id may carry several texts. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece_codec
from evalkit.llm.common import Scratch
from evalkit.session import ship


#: What the near stage takes for a near copy; the query op9 has its own numbers.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keeps one row: that with the largest doc_id."""
    ship(spark)
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join on 5-word shingles at 0.8, keeps the document with the smallest doc_id."""
    ship(spark)
    return jaccard_join.keep_one(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    ship(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes, decoded_sha256, round_trip."""
    ship(spark)
    out = sentencepiece_codec.encode(docs)
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "n_bytes", "decoded_sha256", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact", exact_copies),
    ("near", near_copies),
    ("decontaminate", benchmark_free),
    ("encode", token_ids),
]

#: The classifier, edit distances and the encoding are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if hasattr(before, "scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
