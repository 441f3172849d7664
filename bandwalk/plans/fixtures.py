"""The tables that the queries run on, all derived from ``embeddings`` without randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwalk.functions.kernels import squared_l2
from bandwalk.operators import exact, graph

K = 16


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return exact.label_order(v).withColumn("x", F.col("label")).withColumn("y", F.col("vec_id") * 7919 % 1009)


def queries(v: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 20, as a query on all rows."""
    return v.where(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), (F.col("vec_id") % 6).alias("ql"), (F.col("vec_id") % 6 + 3).alias("qr"), F.lit(100).cast("long").alias("ly"), F.lit(700).cast("long").alias("ry")
    )


def knn(v: DataFrame, k: int = K) -> DataFrame:
    return exact.knn_graph(v, k)


def edges(v: DataFrame) -> DataFrame:
    return graph.strict_rng(knn(v), v)


def scored(v: DataFrame) -> DataFrame:
    """``pos, label, d``: squared distance to the centroid, whose means are rounded to 9 places."""
    c = exact.centroid(v).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", F.round("mean", 9).alias("m")))), lambda x: x["m"]).alias("c"))
    mean = c.first()["c"]
    return v.select("pos", "label", squared_l2("embedding", F.array(*[F.lit(m) for m in mean])).alias("d"))
