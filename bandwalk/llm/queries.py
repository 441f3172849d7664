"""The ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, filter_audit, license_scan, line_dedup, media, merkle, near_dedup, packing, quality, secret_scan, sentencepiece, suffix_dedup, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    out = sentencepiece.encode(_table(spark, sf_dir, "documents"), model)
    out = out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))
    out = sentencepiece.decode(out, model, ("n_ids", "ids_sha256"))
    return out.select("doc_id", "n_ids", "ids_sha256", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(_table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("th")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("places")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents").select(columns)
    tampered = [(F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c)) for c in columns]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = docs.withColumn("claimed", F.when(hit, merkle.leaf_hash(*tampered)))
    proofs = merkle.manifest(docs, columns, keep=("claimed",)).withColumn("claimed", F.coalesce("claimed", "leaf"))
    return merkle.verify(proofs, "claimed").select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest_tokens(token_files.write_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_sentencepiece,
        op3_secret_scan,
        op4_minhash_near_dedup,
        op5_packing,
        op6_embedding_near_dedup,
        op7_media_columns,
        op8_quality_classifier,
        op9_suffix_array_dedup,
        op10_license_scan,
        op11_filter_audit,
        op12_merkle_manifest,
        op13_token_files,
        pipeline,
    )
}
