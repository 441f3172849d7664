"""A corpus pipeline: quality, lines, near-duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``.  ``run`` writes what a stage returns as Parquet
in the shared folder and hands it, read again, to the next.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, any
other columns whatever their names, and an empty table, which gives an empty one.  All but the
last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwalk.llm import line_dedup, near_dedup, packing, quality, secret_scan
from bandwalk.llm.common import cut
from bandwalk.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null or empty text is judged by its counts and its site. Repeated rows share a fate."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; a document of which no word is left goes with them, one that had none stays. Null ids come last in the order."""
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id. Rows that repeat an id stay or go together; null ids and texts without words stay."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null texts as they are."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokeniser are not expressible in SQL; ``tests/llm/test_pipeline.py`` holds stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
